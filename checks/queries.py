"""One Spark query per operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import table
from wayfare.functions import parse, text, vectors
from wayfare.operators import (
    context,
    curate,
    encode,
    extract,
    fusion,
    gazetteer,
    neardup,
    search,
    similarity,
    tfidf,
)
from wayfare.functions.places_hk import HONG_KONG
from wayfare.operators.gazetteer import Alias, places
from wayfare.operators.grouping import top_k
from wayfare.plans import answer, ingest, retrieve
from wayfare.session import shared_folder
from wayfare.schema import VENUE_HEADERS
from wayfare.sources import files, store
from wayfare.streaming.history import stream_history as history_stream
from wayfare.streaming.ingest import stream_points as points_stream

QUERIES = {}

# Cosine that gives a useful number of pairs on the given vectors.
PAIR_COSINE = 0.377
MIN_DF, VOCABULARY_SIZE = 2, 10_000
PIECE = 500
HASH_DIMENSIONS = 256

# Names to look up in the given texts; they overlap on purpose.
ALIASES = [
    Alias("the", ("D1", "D2", "D3")),
    Alias("of the", ("D4",)),
    Alias("that", ("D2", "D5")),
    Alias("in", ("D6",)),
    Alias("on the", ("D7", "D1")),
    Alias("was", ("D8",)),
    Alias("tion", ("D9", "D2"), whole_word=False),
    Alias("The", ("D10",), whole_word=False),
]
BRAND_ALIASES = [
    Alias("red", ("Brand#1", "Brand#2", "Brand#3")),
    Alias("small", ("Brand#4", "Brand#5")),
    Alias("blue", ("Brand#6",)),
    Alias("bolt", ("Brand#7", "Brand#8", "Brand#9", "Brand#2")),
]


def query(f):
    QUERIES[f.__name__] = f
    return f


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def dec(c, digits: int = 6):
    return F.round(c, digits)


def documents(spark, sf, tag: str | None = None) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", *([F.col(tag).alias("tag")] if tag else []), "text")


def questions(spark, sf, tagged: bool = False) -> DataFrame:
    """Benchmark texts; with tags a third each is free, English only, French or German."""
    tags = F.expr(
        "case item_id % 3 when 0 then array() when 1 then array('en') else array('fr', 'de') end"
    )
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        *([tags.cast("array<string>").alias("tags")] if tagged else []),
        "text",
    )


def dense_docs(spark, sf, tag: str | None = None) -> DataFrame:
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    if tag is None:
        return vec
    docs = table(spark, sf, "documents").select("doc_id", F.col(tag).alias("tag"))
    return vec.join(docs, "doc_id", "left")


def dense_questions(spark, sf, tagged: bool = False) -> DataFrame:
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf, tagged).join(vec, "query_id")


def word_model(spark, sf, tag: str | None = None, analyzer: str = "word"):
    """(counts, vocabulary) of all documents."""
    docs = documents(spark, sf, tag)
    carry = ("tag",) if tag else ()
    counts = tfidf.term_counts(docs, carry=carry) if analyzer == "word" else tfidf.packed_grams(docs, carry=carry)
    size = VOCABULARY_SIZE if analyzer == "word" else 100_000
    return counts, tfidf.fit_vocabulary(counts, docs.count(), MIN_DF, size)


def sparse_sides(spark, sf, tag: str | None = None, analyzer: str = "word"):
    """(sparse document vectors, question weights)."""
    counts, vocabulary = word_model(spark, sf, tag, analyzer)
    carry = ("tag",) if tag else ()
    vectors = tfidf.sparse_vectors(counts, vocabulary, carry)
    asked = search.query_weights(questions(spark, sf, tag is not None), vocabulary, analyzer)
    return vectors, asked


def hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", big("rank").alias("rank"), "doc_id", dec("score").alias("score"))


# Sources, projections, filters


@query
def payload_projection(spark: SparkSession, sf: str) -> DataFrame:
    return curate.venue_payload(curate.venue_columns(inputs.venues(spark, sf)))


@query
def csv_venues(spark, sf):
    """Venues written as CSV files of two layouts and read back by their headers; the last of a name stays.

    An empty cell is null, as in every CSV table.
    """
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    rows = inputs.venues(spark, sf).selectExpr("ord", *[f"`{n}` as `{h}`" for h, n in VENUE_HEADERS.items()])
    middle = (rows.agg(F.max("ord")).first()[0] or 0) // 2
    plain = dict(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    layouts = {"a": list(VENUE_HEADERS), "b": [*reversed(VENUE_HEADERS), "備註"]}
    for folder, columns in layouts.items():
        some = rows.filter(F.col("ord") <= middle if folder == "a" else F.col("ord") > middle)
        some = some.withColumn("備註", F.lit("not\tread")).repartitionByRange("ord").sortWithinPartitions("ord")
        some.select(*[F.col(f"`{c}`") for c in columns]).write.options(**plain).csv(f"{root}/{folder}")
    kept, _ = curate.dedup_keep_last(files.read_venues(spark, f"{root}/*"), ("name",))
    return kept.select(*VENUE_HEADERS.values())


@query
def record_payload(spark, sf):
    return curate.record_payload(inputs.records(spark, sf), "ord").select(
        "ord",
        F.col("`Cost Estimate`").alias("cost"),
        F.col("`Parsed Cost`").alias("parsed"),
        F.col("`Why Recommended`").alias("why"),
        F.col("Source").alias("source"),
    )


@query
def index_text(spark, sf):
    return inputs.venues(spark, sf).select("ord", curate.venue_text().alias("text"))


@query
def record_text(spark, sf):
    return inputs.records(spark, sf).select("ord", curate.record_text().alias("text"))


@query
def sentence_template(spark, sf):
    return inputs.records(spark, sf).select("ord", curate.record_sentence().alias("sentence"))


@query
def token_validation(spark, sf):
    kept, _ = curate.split_valid(inputs.records(spark, sf))
    return kept.select("ord", F.col("Name").alias("name"))


@query
def validation_rejects(spark, sf):
    _, bad = curate.split_valid(inputs.records(spark, sf))
    return bad.select("ord", F.array_join("reasons", "; ").alias("reasons"))


@query
def document_validation(spark, sf):
    docs = documents(spark, sf)
    kept, _ = curate.split_valid(docs, {"text": (5, 300)})
    return kept.select("doc_id", big(text.token_count("text")).alias("n"))


@query
def drop_empty(spark, sf):
    """Texts of white space only count as empty once cleaned."""
    docs = documents(spark, sf).withColumn("text", text.strip("text"))
    filled, empty = curate.split_filled(docs, "text")
    return curate.stage_counts({"filled": filled, "empty": empty}).select(
        "stage", big("rows").alias("n")
    )


@query
def url_mark(spark, sf):
    """URLs that carry the page parameter, with its value."""
    pages = table(spark, sf, "pages")
    return pages.filter(F.contains("url", F.lit("page="))).select(
        "page_id", text.url_parameter("url", "page").alias("value")
    )


@query
def url_param_top10(spark, sf):
    """First 10 of the first 20 results that carry the mark, whatever lies behind them."""
    found = extract.watch_ids(table(spark, sf, "pages"), "page_id", mark="/en/", parameter="page")
    return found.select("page_id", F.col("video_id").alias("value"))


@query
def stage_counts(spark, sf):
    """Counts of all stages from one run of one plan."""
    counter = curate.StageCounter()
    part = inputs.venues(spark, sf)
    fields = [F.expr(e).alias(n) for n, e in inputs.RECORD.items() if n != "ord"]
    reasons = F.size(curate.violations())
    # Record fields are counted as they pass; names differ from them in case alone.
    rows = part.select("ord", F.col("name").alias("venue"), *fields)
    rows = counter.mark(
        rows, read=F.lit(True), unnamed=F.col("venue").isNull(), valid=reasons == 0, bad=reasons > 0
    )
    named, _ = curate.dedup_keep_last(rows.select("ord", F.col("venue").alias("name")))
    named = counter.mark(named, deduplicated=F.lit(True))
    named.select("ord").write.format("noop").mode("overwrite").save()
    order = F.array_position(F.array(*map(F.lit, ["read", "deduplicated", "unnamed", "valid", "bad"])), F.col("stage"))
    return counter.table(spark).select((order - 1).alias("step"), "stage", big("rows").alias("n"))


@query
def query_text(spark, sf):
    asked = questions(spark, sf)
    district = F.when(F.col("query_id") % 2 == 0, F.lit("北區")).otherwise(F.lit(""))
    budget = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("HKD "), F.col("query_id")))
    return asked.select("query_id", text.query_text("text", district, budget).alias("text"))


@query
def query_source(spark, sf):
    return questions(spark, sf).select("query_id", F.length("text").cast("bigint").alias("n"))


@query
def payload_without_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", big("label").alias("label"))


@query
def attach_vectors(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", "source", big("quality").alias("quality"), big("toxic").alias("toxic")
    )


@query
def district_filter(spark, sf):
    """Driver-side filter forms: any-of, one, none."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    forms = {"any": ["src1", "src3", "src5"], "one": ["src2"], "none": []}
    out = None
    for name, wanted in forms.items():
        part = docs.filter(search.district_filter("source", wanted)).select(
            F.lit(name).alias("form"), "doc_id"
        )
        out = part if out is None else out.unionByName(part)
    return out


# Scalar functions


@query
def cost_lenient(spark, sf):
    venues = inputs.venues(spark, sf)
    return venues.select(
        "ord",
        *[
            parse.lenient_cost(f"cost_estimate_{m}").alias(m)
            for m in ("breakfast", "lunch", "dinner")
        ],
    )


@query
def cost_strict(spark, sf):
    venues = inputs.venues(spark, sf)
    return venues.select(
        "ord",
        *[
            parse.strict_cost(f"cost_estimate_{m}").alias(m)
            for m in ("breakfast", "lunch", "dinner")
        ],
    )


@query
def coordinates(spark, sf):
    return inputs.venues(spark, sf).select("ord", parse.coordinates("coordinates").alias("c")).select(
        "ord", "c.latitude", "c.longitude"
    )


@query
def stable_id(spark, sf):
    return inputs.venues(spark, sf).select("ord", parse.stable_id("name", "district").alias("id"))


@query
def random_id(spark, sf):
    return inputs.venues(spark, sf).select("ord", parse.random_id().alias("id"))


@query
def normal_key(spark, sf):
    return inputs.venues(spark, sf).select("ord", text.normal_key("name").alias("key"))


@query
def accent_fold(spark, sf):
    """Folded texts of all documents; empty keys are skipped."""
    folded = documents(spark, sf).select("doc_id", text.fold_accents("text").alias("folded"))
    return folded.filter("folded != ''")


@query
def word_tokens(spark, sf):
    """Token statistics of every document."""
    spread = documents(spark, sf).select("doc_id", F.explode(text.tokens("text")).alias("t"))
    return spread.groupBy("doc_id").agg(
        big(F.count("t")).alias("n"),
        big(F.countDistinct("t")).alias("kinds"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
    )


@query
def char_ngrams(spark, sf):
    """Every padded 2- to 4-gram of all documents with its frequencies."""
    counts = tfidf.term_counts(documents(spark, sf), "char_wb")
    return counts.groupBy("term").agg(
        big(F.count(F.lit(1))).alias("df"), big(F.sum("tf")).alias("cf")
    )


@query
def clean_captions(spark, sf):
    return inputs.captions(spark, sf).select("doc_id", text.clean_captions("value").alias("text"))


@query
def clean_captions_strict(spark, sf):
    return inputs.captions(spark, sf).select(
        "doc_id", text.clean_captions("value", strict=True).alias("text")
    )


@query
def snippets(spark, sf):
    return documents(spark, sf).select("doc_id", text.snippet("text").alias("snippet"))


@query
def unit_vectors(spark, sf):
    """Unit vectors of the given vectors stretched by their label, as one row per component."""
    stretched = F.expr("transform(embedding, x -> cast(x as double) * (1 + label))")
    v = table(spark, sf, "embeddings").select("vec_id", vectors.unit(stretched).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("pos", "x")).select(
        "vec_id", big("pos").alias("pos"), dec("x").alias("x")
    )


@query
def cosine_neighbours(spark, sf):
    """Cosine of every vector and the one with the next id."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(
        "vec_id", dec(vectors.cosine("embedding", "other")).alias("score")
    )


@query
def vector_lengths(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", dec(vectors.length("embedding")).alias("length"))


# Dedup, upsert, near-duplicates


@query
def dedup_keep_last(spark, sf):
    kept, _ = curate.dedup_keep_last(inputs.venues(spark, sf))
    return kept.select("ord", "name", "district")


@query
def dedup_name_district(spark, sf):
    kept, _ = curate.dedup_keep_last(inputs.venues(spark, sf), ("name", "district"))
    return kept.select("ord", "name", "district")


@query
def upsert_merge(spark, sf):
    """Parts re-sent with another address, in three batches written to a point table; the last one wins."""
    venues = inputs.venues(spark, sf)
    ident = parse.stable_id("name", "district").alias("id")
    old = curate.dedup_keep_last(venues, ("name", "district"))[0]
    new = venues.filter("address is not null").select(
        ident, "ord", F.concat(F.lit("moved to "), "address").alias("address")
    )
    root = f"{shared_folder(spark)}/points-{uuid.uuid4()}"
    store.upsert(root, old.select(ident, "address"), buckets=16)
    last = venues.agg(F.max("ord")).first()[0] or 0
    for n in range(3):
        sent = new.filter(F.floor(F.col("ord") * 3 / (last + 1)) == n)
        store.upsert(root, sent, order="ord", buckets=16)
    return store.read(spark, root)


@query
def similar_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.similar_pairs(e, e, PAIR_COSINE).select("a", "b", dec("score").alias("score"))


@query
def similar_pairs_default(spark, sf):
    """The default threshold over vectors and shifted copies of them."""
    e = _with_copies(spark, sf)
    return similarity.similar_pairs(e, e, neardup.THRESHOLD).select("a", "b")


def _with_copies(spark, sf) -> DataFrame:
    """All vectors, and a copy of each under a later id with its first component moved."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    moved = F.expr("transform(embedding, (x, i) -> if(i = 0, cast(x + 0.5 as float), x))")
    return e.unionByName(e.select((F.col("id") + 1_000_000).alias("id"), moved.alias("embedding")))


def _near_groups(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e, neardup.near_duplicate_groups(e, PAIR_COSINE)


def _row_sizes(spark, sf) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), text.token_count("text").alias("size")
    )


@query
def near_dup_groups(spark, sf):
    return _near_groups(spark, sf)[1]


@query
def near_dup_leaders(spark, sf):
    _, groups = _near_groups(spark, sf)
    return groups.groupBy("leader").agg(big(F.count(F.lit(1))).alias("n"))


@query
def near_dup_best(spark, sf):
    _, groups = _near_groups(spark, sf)
    return neardup.best_of_groups(groups, _row_sizes(spark, sf))


@query
def near_dup_keep(spark, sf):
    e, groups = _near_groups(spark, sf)
    return neardup.rows_to_keep(e, groups, _row_sizes(spark, sf)).orderBy("id")


@query
def ungrouped_rows(spark, sf):
    e, groups = _near_groups(spark, sf)
    return e.select("id").join(groups.select("id").distinct(), "id", "left_anti")


@query
def text_copy_groups(spark, sf):
    """Near-duplicate groups of hashed text vectors: copied and nearly copied documents."""
    v = encode.hashed_vectors(documents(spark, sf), HASH_DIMENSIONS).select(
        F.col("doc_id").alias("id"), "embedding"
    )
    return neardup.near_duplicate_groups(v, 0.995)


# TF-IDF and search


@query
def doc_frequency(spark, sf):
    docs = documents(spark, sf)
    totals = tfidf.term_totals(tfidf.term_counts(docs), docs.count())
    return totals.select("term", "df", "cf", dec("idf").alias("idf"))


@query
def vocabulary(spark, sf):
    _, terms = word_model(spark, sf)
    return terms.select("term", big("term_id").alias("term_id"), "df", dec("idf").alias("idf"))


@query
def tfidf_weights(spark, sf):
    counts, terms = word_model(spark, sf)
    weights = tfidf.tfidf_weights(counts, terms)
    return weights.select("doc_id", big("term_id").alias("term_id"), dec("weight").alias("weight"))


@query
def sparse_vectors(spark, sf):
    """Stored form of the weights: sizes and ends of the parallel arrays."""
    counts, terms = word_model(spark, sf)
    packed = tfidf.sparse_vectors(counts, terms)
    return packed.select(
        "doc_id",
        big(F.size("sparse.indices")).alias("n"),
        big(F.element_at("sparse.indices", 1)).alias("first_id"),
        big(F.element_at("sparse.indices", -1)).alias("last_id"),
        dec(F.element_at("sparse.values", 1)).alias("first_weight"),
    )


@query
def sparse_topk(spark, sf):
    docs, asked = sparse_sides(spark, sf)
    return hits(search.sparse_topk(docs, asked, 10))


@query
def sparse_join_topk(spark, sf):
    """The same ranking by a join on terms, the way of query sets too large to hold."""
    docs, asked = sparse_sides(spark, sf)
    return hits(search.ranked(search.sparse_scores(tfidf.unpack_sparse(docs), asked), 10))


@query
def char_sparse_topk(spark, sf):
    docs, asked = sparse_sides(spark, sf, analyzer="char_wb")
    return hits(search.sparse_topk(docs, asked, 10))


@query
def dense_topk(spark, sf):
    return hits(search.dense_topk(dense_docs(spark, sf), dense_questions(spark, sf), 10))


@query
def dense_filtered_topk(spark, sf):
    docs, asked = dense_docs(spark, sf, "lang"), dense_questions(spark, sf, True)
    return hits(search.dense_topk(docs, asked, 10))


@query
def filtered_topk(spark, sf):
    docs, asked = sparse_sides(spark, sf, "lang")
    return hits(search.sparse_topk(docs, asked, 10))


def _candidates(spark, sf, k: int, tag: str | None = None) -> DataFrame:
    vectors, asked = sparse_sides(spark, sf, tag)
    docs, dense_asked = dense_docs(spark, sf, tag), dense_questions(spark, sf, tag is not None)
    return fusion.lists_together(
        sparse=search.sparse_topk(vectors, asked, k * fusion.PREFETCH),
        dense=search.dense_topk(docs, dense_asked, k * fusion.PREFETCH),
    )


@query
def candidate_lists(spark, sf):
    return _candidates(spark, sf, 10).select(
        "list", "query_id", "doc_id", big("rank").alias("rank"), dec("score").alias("score")
    )


@query
def list_statistics(spark, sf):
    stats = fusion.list_statistics(_candidates(spark, sf, 10))
    return stats.select(
        "list", "query_id", dec("mean").alias("mean"), dec("deviation").alias("deviation")
    ).distinct()


@query
def hybrid_rrf(spark, sf):
    return hits(fusion.fuse(_candidates(spark, sf, 10), 10, "RRF"))


@query
def hybrid_dbsf(spark, sf):
    return hits(fusion.fuse(_candidates(spark, sf, 10), 10, "DBSF"))


@query
def filtered_hybrid(spark, sf):
    return hits(fusion.fuse(_candidates(spark, sf, 3, "lang"), 3, "RRF"))


@query
def sparse_fused(spark, sf):
    docs, asked = sparse_sides(spark, sf, "lang")
    return hits(fusion.sparse_fused_topk(docs, asked, 3))


@query
def display_rows(spark, sf):
    """The live search path: filtered sparse candidates, fused, first three shown."""
    docs, asked = sparse_sides(spark, sf, "lang")
    best = fusion.sparse_fused_topk(docs, asked, 3)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    shown = curate.display_rows(search.payload_for(best, docs, 3 * table(spark, sf, "benchmark").count()), ["lang", "source"], "text")
    return shown.withColumn("rank", big("rank"))


@query
def source_topk(spark, sf):
    """Three longest documents of every source: top-k with one key that may be hot."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    best = top_k(docs, "source", [F.col("n_chars").desc(), F.col("doc_id")], 3)
    return best.withColumn("rank", big("rank"))


@query
def alias_lookup(spark, sf):
    asked = questions(spark, sf)
    return asked.select("query_id", F.array_join(places("text", ALIASES), ",").alias("places"))


@query
def alias_lookup_documents(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", F.array_join(places("text", ALIASES), ",").alias("places"))


def planted(spark, sf) -> DataFrame:
    """Documents with a name of the Hong Kong list at their end, each name in its turn."""
    names = F.array(*[F.lit(a.text) for a in HONG_KONG])
    name = F.element_at(names, (F.pmod(F.col("doc_id"), F.lit(len(HONG_KONG))) + 1).cast("int"))
    return documents(spark, sf).withColumn("text", F.concat("text", F.lit(" "), name))


@query
def alias_lookup_table(spark, sf):
    """All names of the Hong Kong list by the automaton, in documents that have one planted."""
    table_of = gazetteer.alias_table(spark, HONG_KONG)
    found = gazetteer.places_joined(planted(spark, sf), "doc_id", "text", table_of)
    return found.select("doc_id", F.array_join("places", ",").alias("places"))


@query
def venue_search(spark, sf):
    """Names of parts asked as questions over the venue index, filtered by brands named."""
    venues, _ = curate.dedup_keep_last(inputs.venues(spark, sf), ("name", "district"))
    texts = ingest.index_texts(venues)
    terms = ingest.fit(texts, **ingest.VENUE_MODEL)
    asked = table(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(
        F.min("p_partkey").alias("query_id")
    )
    found = retrieve.search_venues(
        ingest.points(venues, terms), asked, terms, k=3, aliases=BRAND_ALIASES
    )
    return found.select(
        "query_id", big("rank").alias("rank"), "id", dec("score").alias("score"), "name", "district"
    )


# Extraction


@query
def json_records(spark, sf):
    parsed, _ = extract.parse_outputs(inputs.answers(spark, sf), "answer")
    rows = extract.flatten_records(parsed, ["doc_id"])
    return rows.select(
        "doc_id",
        big("pos").alias("pos"),
        F.col("Name").alias("name"),
        F.col("Location").alias("location"),
        F.col("`Cost Estimate`").alias("cost"),
        F.col("`Description/Highlights`").alias("highlights"),
    )


@query
def parse_rejects(spark, sf):
    _, bad = extract.parse_outputs(inputs.answers(spark, sf), "answer")
    return bad.select("doc_id", "answer")


@query
def event_properties(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query
def chunks(spark, sf):
    pieces = context.split_oversize(documents(spark, sf), ["doc_id"], "text", PIECE)
    return pieces.select("doc_id", big("pos").alias("pos"), "piece")


@query
def chunk_rejoin(spark, sf):
    pieces = context.split_oversize(documents(spark, sf), ["doc_id"], "text", PIECE)
    return context.rejoin(pieces, ["doc_id"])


# Encoders, contexts, histories


@query
def hashed_buckets(spark, sf):
    return encode.hashed_buckets(documents(spark, sf), HASH_DIMENSIONS).select(
        "doc_id", big("bucket").alias("bucket"), "n"
    )


@query
def hashed_encoder(spark, sf):
    """Hashed vectors of all questions, as one row per component."""
    asked = questions(spark, sf).withColumnRenamed("query_id", "doc_id")
    v = encode.hashed_vectors(asked, HASH_DIMENSIONS)
    return v.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select(
        "doc_id", big("pos").alias("pos"), dec(F.col("x").cast("double"), 5).alias("x")
    )


@query
def hashed_search(spark, sf):
    """Questions and documents through the hashed encoder, dense top 5."""
    asked = questions(spark, sf).withColumnRenamed("query_id", "doc_id")
    docs = encode.hashed_vectors(documents(spark, sf), HASH_DIMENSIONS)
    q = encode.hashed_vectors(asked, HASH_DIMENSIONS).withColumnRenamed("doc_id", "query_id")
    return search.dense_topk(docs, q, 5).select(
        "query_id", big("rank").alias("rank"), dec("score", 4).alias("score")
    )


@query
def context_prompt(spark, sf):
    docs = documents(spark, sf).join(dense_docs(spark, sf), "doc_id")
    return answer.dense_prompts(docs, dense_questions(spark, sf), template=PROMPT)


PROMPT = "Wanted: {query}\nPassages:\n{context}\nAnswer:"


@query
def history_prefix(spark, sf):
    h = context.whole_history(table(spark, sf, "conversations"))
    return h.select("conv_id", "turn", context.render("messages").alias("messages"))


@query
def history_small_blocks(spark, sf):
    """Histories stored in blocks of three turns are the same."""
    h = context.whole_history(table(spark, sf, "conversations"), block=3)
    return h.select("conv_id", "turn", context.render("messages").alias("messages"))


@query
def history_blocks(spark, sf):
    b = context.history_blocks(table(spark, sf, "conversations"), block=4)
    return b.select("conv_id", "block", "first_turn", context.render("messages").alias("messages"))


def _stop():
    """An assistant turn of fewer than 120 characters stands in for the end word."""
    return (F.col("role") == "assistant") & (F.length("text") < 120)


@query
def stop_marker(spark, sf):
    turns = context.until_stop(table(spark, sf, "conversations"), _stop(), block=2)
    return turns.select("conv_id", "turn", "role")


@query
def system_first(spark, sf):
    turns = context.with_system_turn(table(spark, sf, "conversations"), "Be brief.")
    return turns.select("conv_id", "turn", "role", "text")


@query
def chat_requests(spark, sf):
    turns = table(spark, sf, "conversations")
    requests = answer.chat_requests(turns, "Be brief.", block=4)
    return requests.select("conv_id", "turn", context.render("messages").alias("messages"))


# Streams over the given tables, run to their end


def _stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: streams take single files by patterns only."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{{{name}.parquet}}")


@query
def stream_history(spark, sf):
    """Running history as a keyed state; equals the batch history."""
    # The stream ends with its input: no batches for timers alone.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    (
        history_stream(_stream(spark, sf, "conversations"), block=4)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
        .awaitTermination()
    )
    turns = spark.read.parquet(f"{root}/out")
    whole = context.with_earlier(turns, context.latest_blocks(turns))
    return whole.select("conv_id", "turn", context.render("messages").alias("messages"), "late")


@query
def stream_points(spark, sf):
    """Venues streamed into the point table in three micro-batches, with a frozen vocabulary."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    terms = ingest.fit(ingest.index_texts(inputs.venues(spark, sf)), **ingest.VENUE_MODEL)
    # Three files, one after the other, so that the stream has three micro-batches.
    part = table(spark, sf, "part")
    last = part.agg(F.max("p_partkey")).first()[0] or 0
    for n in range(3):
        some = part.filter(F.floor(F.col("p_partkey") * 3 / (last + 1)) == n)
        some.coalesce(1).write.mode("append").parquet(f"{root}/part")
    incoming = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/part")
    incoming = incoming.selectExpr(*[f"{e} as `{n}`" for n, e in inputs.VENUE.items()])
    points_stream(
        incoming, terms, f"{root}/points", f"{root}/checkpoint", keys=("name", "district"), buckets=16
    ).awaitTermination()
    stored = store.read(spark, f"{root}/points")
    return stored.select("id", "name", "address", big(F.size("sparse.indices")).alias("n_terms"))
