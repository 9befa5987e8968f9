"""Filtered top-k search for many queries in one job.

Queries are (query_id, ...); an optional ``tags`` array restricts a query to documents whose
``tag`` is among them, and is applied before any ranking. A null tag is never among them; '' is a
tag like any other. Scores are rounded before ranking and ties go to the smaller id, so the result
does not depend on the order of summation. Sparse scores are rounded half up, as by ``F.round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.grouping import small, spread_join, top_k
from wayfare.operators.tfidf import term_counts, tfidf_weights
from wayfare.session import cut

DIGITS = 6
# Query rows held by each task, and the block sizes of the shuffled form beyond that.
MAX_QUERIES = 4096
DOC_BLOCK = 8192
# Cells of documents for a larger set, and the documents their pivots are chosen from.
MAX_CELLS = 1024
PIVOT_ROWS = 4096
# Hits broadcast to the payload.
MAX_HITS = 1_000_000
# Query weights held by each task at a time.
MAX_QUERY_TERMS = 1_000_000
# Postings of one term handled by one task in the join by term.
HOT_POSTINGS = 1_000_000


def tag_condition(tags: Column, tag: Column) -> Column:
    """No tags: everything passes. One or more: the document's tag must be among them."""
    return (
        F.coalesce(F.size(tags), F.lit(0)).isin(0, -1)
        | F.coalesce(F.array_contains(tags, tag), F.lit(False))
    )


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """Top k of (query_id, doc_id, score)."""
    return top_k(scores, "query_id", [F.col("score").desc(), F.col("doc_id")], k)


def query_weights(
    queries: DataFrame, vocabulary: DataFrame, analyzer: str = "word", **options
) -> DataFrame:
    """(query_id, [tags,] term_id, weight) with the vocabulary frozen at ingest."""
    carry = tuple(c for c in ("tags",) if c in queries.columns)
    docs = queries.withColumnRenamed("query_id", "doc_id")
    counts = term_counts(docs, analyzer, carry=carry, **options)
    weights = tfidf_weights(counts, vocabulary, carry=carry)
    return weights.withColumnRenamed("doc_id", "query_id")


def sparse_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top k of (doc_id, [tag,] sparse) by dot product with (query_id, [tags,] term_id, weight).

    A document that shares no term with a query is no hit. Queries are held by every task in blocks of
    about ``MAX_QUERY_TERMS`` weights, and documents are scored where they lie, once for each block:
    no join rows, no shuffle of documents, at most k rows per query leave a task.
    """
    blocks = max(1, -(-queries.count() // MAX_QUERY_TERMS))
    found = None
    for block in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _scan_sparse(vectors, some, k)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def _query_blocks(table, tagged: bool, size: int = 256):
    """Query weights of an Arrow table, cut into blocks of whole queries."""
    import numpy as np

    all_ids, code = np.unique(_ids(table.column("query_id").combine_chunks()), return_inverse=True)
    term = table.column("term_id").to_numpy()
    weight = table.column("weight").to_numpy()
    tags = [None] * len(all_ids)
    if tagged:
        for c, t in zip(code.tolist(), table.column("tags").to_pylist()):
            tags[c] = set(t) if t else None
    blocks = []
    for at in range(0, len(all_ids), size):
        own = (code >= at) & (code < at + size)
        terms, place = np.unique(term[own], return_inverse=True)
        ids = all_ids[at : at + size]
        blocks.append((ids, tags[at : at + size], terms, place, code[own] - at, weight[own]))
    return blocks


def _scan_sparse(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Sparse scores as products of small dense matrices over the terms the queries use."""
    tagged = "tag" in vectors.columns and "tags" in queries.columns
    held = vectors.sparkSession.sparkContext.broadcast(_query_blocks(queries.toArrow(), tagged))
    docs = vectors.select("doc_id", *(["tag"] if tagged else []), "sparse")

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        blocks = held.value
        best = [None] * len(blocks)
        for batch in batches:
            indices = pc.struct_field(batch.column("sparse"), "indices")
            sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
            term = indices.flatten().to_numpy(zero_copy_only=False)
            weight = pc.struct_field(batch.column("sparse"), "values").flatten()
            weight = weight.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            ids = _ids(batch.column("doc_id"))
            doc_tags = batch.column("tag").to_pylist() if tagged else None
            for b, (q_ids, q_tags, terms, place, column, q_weight) in enumerate(blocks):
                q_matrix = np.zeros((len(terms), len(q_ids)))
                q_matrix[place, column] = q_weight
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                known = terms[at] == term
                r, c, w = row[known], at[known], weight[known]
                step = max(16, (1 << 22) // len(terms))
                for start in range(0, batch.num_rows, step):
                    lo, hi = np.searchsorted(r, (start, start + step))
                    rows = np.zeros((min(step, batch.num_rows - start), len(terms)))
                    rows[r[lo:hi] - start, c[lo:hi]] = w[lo:hi]
                    s = rows @ q_matrix
                    s = np.where(s > 0, _half_up(s), -np.inf)
                    if tagged:
                        s = _mask_tags(s, doc_tags[start : start + step], q_tags)
                    found = _best_rows(q_ids, s, ids[start : start + step], k)
                    if best[b] is not None:
                        found = _first_k(*[np.r_[x, y] for x, y in zip(best[b], found)], k)
                    best[b] = found
        for found in best:
            if found is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in found], names=["query_id", "doc_id", "score"]
                )

    return docs.mapInArrow(score, _hit_schema(docs, queries))


def sparse_scores(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot products of query and document weights that share a term, as a join by term.

    When ``weights`` keeps the by-document partitioning of ``tfidf_weights``, grouping by
    (doc_id, query_id) needs no further exchange.
    """
    q = queries.withColumnRenamed("weight", "_qw")
    if small(q, MAX_QUERY_TERMS):
        hits = weights.join(F.broadcast(q), "term_id")
    else:
        # Terms with long posting lists are split over tasks.
        postings = weights.groupBy("term_id").agg(F.count(F.lit(1)).alias("_n"))
        q = q.join(postings, "term_id")
        hits = spread_join(weights, q, "term_id", "doc_id", "_n", HOT_POSTINGS)
    if "tags" in q.columns and "tag" in weights.columns:
        hits = hits.filter(tag_condition(F.col("tags"), F.col("tag")))
    dots = hits.groupBy("doc_id", "query_id").agg(F.sum(F.col("weight") * F.col("_qw")).alias("s"))
    return dots.select("query_id", "doc_id", F.round("s", DIGITS).alias("score"))


def _half_up(scores):
    """Scores rounded like ``F.round`` rounds them: half up by their shortest decimal digits."""
    import numpy as np
    from decimal import ROUND_HALF_UP, Decimal

    out = np.round(scores, DIGITS)
    scaled = scores * 10.0**DIGITS
    # Only what lies next to a half can go another way than by the nearest digit.
    unit = Decimal(1).scaleb(-DIGITS)
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(scores[at]))).quantize(unit, ROUND_HALF_UP))
    return out


def _best_rows(q_ids, scores, d_ids, k):
    """(query, doc, score) triples of the k best per query column, ties by smaller doc id."""
    import numpy as np

    n = scores.shape[0]
    if n > k:
        floor = np.partition(scores, n - k, axis=0)[n - k]
        row, col = np.nonzero((scores >= floor) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    return _first_k(q_ids[col], d_ids[row], scores[row, col], k)


def _first_k(qs, ds, ss, k):
    import numpy as np

    # Ids may be numbers or strings; sorting goes by their codes.
    q_code = np.unique(qs, return_inverse=True)[1]
    order = np.lexsort((np.unique(ds, return_inverse=True)[1], -ss, q_code))
    qs, ds, ss = qs[order], ds[order], ss[order]
    starts = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]]) if len(qs) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(qs)])
    place = np.arange(len(qs)) - np.repeat(starts, sizes)
    keep = place < k
    return qs[keep], ds[keep], ss[keep]


def _cosines(batch_vectors, q_matrix):
    """Rounded cosines of a slice of document vectors (rows) and query vectors (columns)."""
    import numpy as np

    size = np.linalg.norm(batch_vectors, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = (batch_vectors @ q_matrix.T) / size[:, None]
    return np.where(np.isfinite(scores), np.round(scores, DIGITS), -np.inf)


def _matrix(column, width):
    """An Arrow list column as a 2-d double array."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def dense_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    max_queries: int = MAX_QUERIES,
    doc_block: int = DOC_BLOCK,
) -> DataFrame:
    """Exact cosine top-k of (doc_id, embedding[, tag]) for (query_id, embedding[, tags]).

    A checked small query set is held by every task, and documents are scored where they are
    scanned: at most k rows per query leave a task. A larger set goes to cells around pivots: a
    query's hits in its own cell bound the rest, and it visits only cells that can hold better ones.
    """
    tagged = "tag" in docs.columns and "tags" in queries.columns
    d = docs.select(
        "doc_id",
        "embedding",
        (F.col("tag") if tagged else F.lit(None)).cast("string").alias("tag"),
    )
    q = queries.select(
        "query_id",
        "embedding",
        (F.col("tags") if tagged else F.lit(None)).cast("array<string>").alias("tags"),
    )
    # Null vectors are dropped inside the tasks: a filter here would compute vectors twice.
    if small(q, max_queries):
        best = _scan_topk(d, q, k)
    else:
        best = _cells_topk(d, q, k, max_queries, doc_block)
    return ranked(best, k)


def _with_vector(rows):
    """Rows of an Arrow batch or table that have a vector."""
    import pyarrow.compute as pc

    return rows.filter(pc.is_valid(rows.column("embedding")))


def _prepare_queries(table):
    """Ids, unit vectors and tag sets of an Arrow table of queries."""
    import numpy as np

    table = _with_vector(table)
    ids = _ids(table.column("query_id").combine_chunks())
    width = len(table.column("embedding")[0].as_py()) if len(ids) else 1
    matrix = _matrix(table.column("embedding").combine_chunks(), width)
    size = np.linalg.norm(matrix, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = matrix / size[:, None]
    tags = [set(t) if t else None for t in table.column("tags").to_pylist()]
    return ids, matrix, tags


def _mask_tags(scores, doc_tags, q_tags):
    import numpy as np

    if not any(q_tags):
        return scores
    values = {v: i for i, v in enumerate(dict.fromkeys(doc_tags))}
    code = np.array([values[t] for t in doc_tags], int)
    allowed = np.array([[t is None or (v is not None and v in t) for v in values] for t in q_tags])
    return np.where(allowed[:, code].T, scores, -np.inf)


def _hit_schema(docs: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _ids(column):
    return column.to_numpy(zero_copy_only=False)


def _scan_topk(docs: DataFrame, queries: DataFrame, k: int, step: int = 1024) -> DataFrame:
    """Documents stay in their scan partitions; each keeps its best k per query."""
    held = docs.sparkSession.sparkContext.broadcast(_prepare_queries(queries.toArrow()))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        q_ids, q_matrix, q_tags = held.value
        best = None
        for batch in batches:
            batch = _with_vector(batch)
            if not batch.num_rows or not len(q_ids):
                continue
            ids = _ids(batch.column("doc_id"))
            vectors = _matrix(batch.column("embedding"), q_matrix.shape[1])
            tags = batch.column("tag").to_pylist() if any(q_tags) else None
            for at in range(0, len(ids), step):
                cut = slice(at, at + step)
                s = _cosines(vectors[cut], q_matrix)
                if tags is not None:
                    s = _mask_tags(s, tags[cut], q_tags)
                found = _best_rows(q_ids, s, ids[cut], k)
                if best is not None:
                    found = _first_k(*[np.r_[a, b] for a, b in zip(best, found)], k)
                best = found
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in best], names=["query_id", "doc_id", "score"]
            )

    return docs.mapInArrow(score, _hit_schema(docs, queries))


def _unit_rows(matrix):
    import numpy as np

    size = np.linalg.norm(matrix, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / size[:, None]


def _far_apart(units, count):
    """Rows of ``units`` picked one by one, each farthest from those before it."""
    import numpy as np

    picked, near = [0], units @ units[0]
    while len(picked) < count:
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        picked.append(far)
        near = np.maximum(near, units @ units[far])
    return units[picked]


def _distances(cosines):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def _in_cells(rows: DataFrame, pivots, ranges=None) -> DataFrame:
    """``rows`` with cell and apart, the nearest pivot and the distance to it; zero vectors are dropped.

    With ``ranges``, the (least, most) distance of each cell's documents, a row with a ``reach``
    is given once for each other cell that could hold a document within it.
    """
    fields = [f for f in rows.schema if f.name not in ("reach", "cell", "apart")]
    held = rows.sparkSession.sparkContext.broadcast((pivots, ranges))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        centers, known = held.value
        gaps = _distances(centers @ centers.T)
        for batch in batches:
            batch = _with_vector(batch)
            if not batch.num_rows:
                continue
            units = _unit_rows(_matrix(batch.column("embedding"), centers.shape[1]))
            usable = np.isfinite(units).all(axis=1)
            batch, units = batch.filter(pa.array(usable)), units[usable]
            near = units @ centers.T
            apart = _distances(near)
            if known is None:
                row, cell = np.arange(len(units)), np.argmax(near, axis=1)
            else:
                home = np.argmax(near, axis=1)
                reach = batch.column("reach").to_numpy()[:, None] + 1e-9
                beyond = near[np.arange(len(home)), home][:, None] - near
                within = (beyond <= reach * gaps[home]) & (apart >= known[0] - reach) & (apart <= known[1] + reach)
                within[np.arange(len(home)), batch.column("cell").to_numpy()] = False
                row, cell = np.nonzero(within)
            taken = batch.select([f.name for f in fields]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cell.astype("int32")), pa.array(apart[row, cell])],
                names=[*taken.schema.names, "cell", "apart"],
            )

    more = [T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType())]
    return rows.mapInArrow(place, T.StructType([*fields, *more]))


def _cell_hits(docs: DataFrame, queries: DataFrame, k: int, q_block: int, d_block: int) -> DataFrame:
    """Best k of each query among the documents of each cell it is in, in groups of bounded size."""

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    # One row per pivot at most.
    sizes = F.broadcast(parts(docs, d_block, "n_d").join(parts(queries, q_block, "n_q"), "cell"))

    def spread(rows: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rows = rows.join(sizes, "cell")
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("n_d", "n_q", "apart")

    def score(left, right):
        import pyarrow as pa

        names = ["query_id", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            types = [right.schema.field("query_id").type, left.schema.field("doc_id").type]
            empty = [pa.array([], t) for t in (*types, pa.float64())]
            return pa.Table.from_arrays(empty, names=names)
        q_ids, q_matrix, q_tags = _prepare_queries(right)
        vectors = _matrix(left.column("embedding").combine_chunks(), q_matrix.shape[1])
        s = _mask_tags(_cosines(vectors, q_matrix), left.column("tag").to_pylist(), q_tags)
        found = _best_rows(q_ids, s, _ids(left.column("doc_id").combine_chunks()), k)
        return pa.Table.from_arrays([pa.array(a) for a in found], names=names)

    key = ["cell", "d_block", "q_block"]
    d = spread(docs, "doc_id", "d_block", "n_d", "q_block", "n_q")
    q = spread(queries, "query_id", "q_block", "n_q", "d_block", "n_d")
    return d.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(score, _hit_schema(docs, queries))


def _pivots(docs: DataFrame, d_block: int):
    """Unit vectors of documents far apart, several for each block of documents; None without any."""
    import numpy as np

    sample = docs.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id")
    column = sample.limit(PIVOT_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(column):
        return None
    units = _unit_rows(_matrix(column, len(column[0])))
    units = units[np.isfinite(units).all(axis=1)]
    count = max(1, min(MAX_CELLS, 4 * docs.count() // d_block))
    # Rows without a direction only: any pivot will do, as no row is placed.
    return _far_apart(units, count) if len(units) else np.eye(1, len(column[0]))


def cells_to_visit(
    docs: DataFrame, queries: DataFrame, pivots, k: int, q_block: int, d_block: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in cells, hits in each query's own cell, queries in all other cells they have to visit).

    The k-th hit of a query in its own cell bounds how far any better one can be; by the triangle
    inequality most cells hold none so near. A query with fewer hits there visits every cell.
    """
    import numpy as np

    placed = cut(_in_cells(docs, pivots))
    # One row per pivot at most.
    known = placed.groupBy("cell").agg(F.min("apart").alias("lo"), F.max("apart").alias("hi")).collect()
    least, most = np.full(len(pivots), 9.0), np.full(len(pivots), -9.0)
    for cell, lo, hi in known:
        least[cell], most[cell] = lo, hi
    own = cut(_in_cells(queries, pivots))
    first = cut(ranked(_cell_hits(placed, own, k, q_block, d_block), k))
    bound = first.filter(F.col("rank") == k).select("query_id", "score")
    # Half a unit of the last digit, and equal scores with smaller ids, stay within reach.
    reach = F.sqrt(F.greatest(2 - 2 * (F.col("score") - 10.0**-DIGITS), F.lit(0.0)))
    asked = own.drop("apart").join(bound, "query_id", "left")
    asked = asked.withColumn("reach", F.when(F.col("score").isNull(), 3.0).otherwise(reach)).drop("score")
    return placed, first.drop("rank"), cut(_in_cells(asked, pivots, (least, most)))


def _cells_topk(docs: DataFrame, queries: DataFrame, k: int, q_block: int, d_block: int) -> DataFrame:
    """Queries visit the cells of documents that can hold a hit; documents move once, to their cell."""
    pivots = _pivots(docs, d_block)
    if pivots is None:
        return docs.sparkSession.createDataFrame([], _hit_schema(docs, queries))
    placed, first, visits = cells_to_visit(docs, queries, pivots, k, q_block, d_block)
    return first.unionByName(_cell_hits(placed, visits, k, q_block, d_block))


def payload_for(
    hits: DataFrame, payload: DataFrame, at_most: int, key: str = "doc_id"
) -> DataFrame:
    """Payload columns for ranked hits, joined after top-k.

    ``at_most`` is the proven number of hits (k times the number of queries). Up to MAX_HITS
    the hits are broadcast and the payload is not shuffled.
    """
    return payload.join(F.broadcast(hits) if at_most <= MAX_HITS else hits, key)


def district_filter(column: str, districts: list[str] | None) -> Column:
    """Driver-side filter: none, equals, or any-of."""
    if not districts:
        return F.lit(True)
    if len(districts) == 1:
        return F.col(column) == districts[0]
    return F.col(column).isin(*districts)
