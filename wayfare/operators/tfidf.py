"""TF-IDF: term counts, a frozen vocabulary, sublinear L2-normalised weights.

Documents are shuffled once, by id, before tokens are exploded. Every later step groups by
(doc_id, ...), which that partitioning already satisfies, so no second exchange follows; only
the small per-term totals are shuffled by term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.grams import gram_counts
from wayfare.functions.text import WORD, tokens, words
from wayfare.schema import VOCABULARY
from wayfare.session import cut

# Up to this size a vocabulary is ranked in one task and broadcast; beyond it by range partitions, and joined.
SMALL_VOCABULARY = 1_000_000
PARTITIONS = "spark.sql.shuffle.partitions"
# Text of one task where it is taken apart.
TASK_BYTES = 4 << 20


def spread_by_id(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, ...) spread by ``doc_id`` over as many tasks as their texts need.

    Each task gets about ``TASK_BYTES`` of text, so what a task holds does not grow with the table; there are never
    fewer tasks than ``spark.sql.shuffle.partitions``, or twice the cores where nobody set it. With the
    number given, adaptive execution does not merge partitions that look small but hold texts
    about to be exploded into many rows.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get(PARTITIONS))
    if PARTITIONS not in spark.conf.getAll:
        tasks = 2 * spark.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(tasks, -(-size // TASK_BYTES)), "doc_id")


def term_counts(
    docs: DataFrame,
    analyzer: str = "word",
    pattern: str = WORD,
    grams: tuple[int, int] = (2, 4),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *carry, term, tf) from (doc_id, text).

    ``char_wb`` makes grams of the distinct words of many documents at a time.
    """
    keys = ["doc_id", *carry]
    if analyzer == "word":
        spread = spread_by_id(docs.select(*keys, "text").filter(F.col("text").isNotNull()))
        pieces = spread.select(*keys, F.explode(tokens("text", pattern)).alias("term"))
        return pieces.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    if analyzer != "char_wb":
        raise ValueError(f"unknown analyzer: {analyzer}")
    return unpacked(packed_grams(docs, grams, carry))


def word_lists(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(doc_id, *carry, ws) of texts' whitespace-separated words, one row per text; whether keys repeat."""
    keys = ["doc_id", *carry]
    docs = docs.select(*keys, "text").filter(F.col("text").isNotNull())
    repeated = not docs.groupBy(*keys).count().filter("count > 1").isEmpty()
    return spread_by_id(docs).select(*keys, words("text").alias("ws")), repeated


def packed_grams(docs: DataFrame, grams: tuple[int, int] = (2, 4), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, counted): the grams of a document as one array of (term, tf)."""
    keys = ["doc_id", *carry]
    listed, repeated = word_lists(docs, carry)
    packed = listed.select(*keys, gram_counts(F.col("ws"), *grams).alias("counted"))
    if not repeated:
        return packed
    summed = unpacked(packed).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    return summed.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("counted"))


def unpacked(counts: DataFrame) -> DataFrame:
    """(doc_id, *carry, term, tf) of packed counts; other counts stay."""
    if "counted" not in counts.columns:
        return counts
    keys = [c for c in counts.columns if c != "counted"]
    return counts.select(*keys, F.explode("counted").alias("g")).select(*keys, "g.term", "g.tf")


def term_totals(counts: DataFrame, n_docs: int) -> DataFrame:
    """Per term: document frequency, corpus count, smooth idf. Map-side sums absorb hot terms."""
    totals = unpacked(counts).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf")
    )
    return totals.withColumn("idf", smooth_idf(F.col("df"), n_docs))


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(1 + n_docs)) / (df + 1)) + 1.0


def fit_vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = 2, max_features: int = 100_000
) -> DataFrame:
    """The ``max_features`` most frequent terms seen in ``min_df`` documents, ids by alphabet.

    Equal counts are ordered by term. The fit runs once, here: the result is checkpointed and no
    later step repeats the pass over the corpus. The least count that is kept comes from histograms;
    only terms tied at it are sorted to choose among them, and ids come from range partitions, so
    vocabularies of any size take the same way.
    """
    if max_features < 1:
        raise ValueError("max_features must be at least 1")
    kept = cut(term_totals(counts, n_docs).filter(F.col("df") >= min_df))
    least, above = count_at_rank(kept, "cf", max_features)
    if least is not None:
        tied = numbered(kept.filter(F.col("cf") == least), [F.col("term")], "_rank")
        tied = tied.filter(F.col("_rank") < max_features - above).drop("_rank")
        kept = kept.filter(F.col("cf") > least).unionByName(tied)
    ranked = numbered(kept, [F.col("term")], "term_id")
    return cut(ranked.select(*[F.col(f.name).cast(f.dataType) for f in VOCABULARY]))


def count_at_rank(df: DataFrame, count: str, rank: int, bins: int = 4096) -> tuple[int | None, int]:
    """(v, n): the ``rank``-th largest value of a column of whole numbers, and how many are larger.

    (None, 0) if there are at most ``rank`` rows. Each round counts rows in equal bins of the values still in
    question, after map-side sums, and goes on inside one bin; the driver sees at most ``bins`` + 1 rows.
    """
    low, high, n = df.agg(F.min(count), F.max(count), F.count(F.lit(1))).first()
    if n <= rank:
        return None, 0
    above = 0
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = df.filter(F.col(count).between(low, high))
        at = F.expr(f"({count} - {low}L) div {width}L").alias("bin")
        for row in sorted(inside.groupBy(at).count().collect(), reverse=True):
            if above + row["count"] >= rank:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            above += row["count"]
    return low, above


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``out``: the place of each row in the order, from 0, without a single task for all rows.

    Rows are range-partitioned and kept so; the driver adds up one count per partition.
    """
    tasks = int(df.sparkSession.conf.get(PARTITIONS))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sums, before = {}, 0
    for row in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():
        sums[row["p"]], before = before, before + row["count"]
    first = F.create_map(*[F.lit(x) for p, n in sums.items() for x in (p, n)]) if sums else F.lit(0)
    first = F.element_at(first, part) if sums else first
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(out, first + local).drop("_at")


def tfidf_weights(
    counts: DataFrame, vocabulary: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, *carry, term_id, weight); terms outside the vocabulary are dropped."""
    raw = _raw_weights(counts, vocabulary)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", *carry, "term_id", (F.col("w") / norm).alias("weight"))


def _is_small(vocabulary: DataFrame) -> bool:
    return vocabulary.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY


def _raw_weights(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of known terms with ``w``, the weight before normalisation."""
    side = vocabulary.select("term", "term_id", "idf")
    known = unpacked(counts).join(F.broadcast(side) if _is_small(vocabulary) else side, "term")
    return known.withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))


def sparse_vectors(
    counts: DataFrame, vocabulary: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The same weights, one row per document: ``sparse`` holds parallel index and value arrays.

    Arrays are ordered by index. Packing and norm share one aggregation; packed counts are weighed where they
    lie if the vocabulary is small.
    """
    if "counted" in counts.columns and _is_small(vocabulary):
        weighed = counts.select("doc_id", *carry, _weighed(vocabulary)(F.col("counted")).alias("sparse"))
        return weighed.filter(F.col("sparse").isNotNull())
    w = F.col("w")
    packed = _raw_weights(counts, vocabulary).groupBy("doc_id", *carry).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("p"),
        F.sqrt(F.sum(w * w)).alias("norm"),
    )
    values = F.transform("p.w", lambda x: x / F.col("norm"))
    sparse = F.struct(F.col("p.term_id").alias("indices"), values.alias("values"))
    return packed.select("doc_id", *carry, sparse.alias("sparse"))


def _weighed(vocabulary: DataFrame):
    """A function from an array of (term, tf) to a sparse vector; null without a known term."""
    held = vocabulary.sparkSession.sparkContext.broadcast(vocabulary.select("term", "term_id", "idf").toArrow())

    def weigh(lists: pa.Array) -> pa.Array:

        table = held.value.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        pairs = lists.flatten()
        terms = table.column("term").combine_chunks() if table.num_rows else pa.array([], pa.string())
        at = pc.index_in(pc.struct_field(pairs, "term"), value_set=terms)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.drop_null().to_numpy()
        row = np.repeat(np.arange(len(lists)), sizes)[known]
        tf = pc.struct_field(pairs, "tf").to_numpy(zero_copy_only=False)[known]
        index = table.column("term_id").to_numpy()[at]
        w = (1.0 + np.log(tf)) * table.column("idf").to_numpy()[at]
        order = np.lexsort((index, row))
        row, index, w = row[order], index[order], w[order]
        w = w / np.sqrt(np.bincount(row, w * w, len(lists)))[row]
        many = np.bincount(row, minlength=len(lists))
        offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), w)]
        return pa.StructArray.from_arrays(arrays, names=["indices", "values"], mask=pa.array(many == 0))

    kind = vocabulary.schema["term_id"].dataType.simpleString()
    # Not deterministic by name alone: a filter on the vectors shall not compute them twice.
    weigh.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, f"struct<indices:array<{kind}>,values:array<double>>").asNondeterministic()


def unpack_sparse(vectors: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Back from stored sparse vectors to (doc_id, *carry, term_id, weight)."""
    pair = F.explode(F.arrays_zip("sparse.indices", "sparse.values"))
    return vectors.select("doc_id", *carry, pair.alias("p")).select(
        "doc_id", *carry, F.col("p.indices").alias("term_id"), F.col("p.values").alias("weight")
    )
