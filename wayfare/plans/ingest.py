"""Venue rows to points: dedup, index text, TF-IDF, payload, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.parse import random_id, stable_id
from wayfare.operators import curate, tfidf
from wayfare.schema import EXTRACTED_FIELDS, require_columns
from wayfare.session import cut
from wayfare.sources import store
from wayfare.sources.files import write_rejects

# The venue index uses padded character grams, the record index whole words.
VENUE_MODEL = dict(analyzer="char_wb", min_df=2, max_features=100_000)
RECORD_MODEL = dict(analyzer="word", min_df=2, max_features=10_000)


def fit(texts: DataFrame, analyzer: str, min_df: int, max_features: int) -> DataFrame:
    """Vocabulary of (doc_id, text)."""
    counts = tfidf.term_counts(texts, analyzer)
    return tfidf.fit_vocabulary(counts, texts.count(), min_df, max_features)


def fit_or_load(texts: DataFrame, path: str, model: dict = VENUE_MODEL) -> DataFrame:
    """The vocabulary frozen at ``path``; fitted and saved there on first use."""
    spark = texts.sparkSession
    if store.load_model(spark, path) is None:
        store.save_model(fit(texts, **model), path)
    return store.load_model(spark, path)


def index_texts(venues: DataFrame) -> DataFrame:
    """(doc_id = stable id, text) of deduplicated venues."""
    return venues.select(
        stable_id("name", "district").alias("doc_id"), curate.venue_text().alias("text")
    )


def points(
    venues: DataFrame, vocabulary: DataFrame, analyzer: str = "char_wb", encoder=None
) -> DataFrame:
    """One row per venue: payload, ``sparse`` and, with an encoder, ``embedding``.

    ``encoder`` maps (doc_id, text) to (doc_id, embedding). A venue whose text has no known
    term gets an empty sparse vector.
    """
    texts = index_texts(venues)
    vectors = tfidf.sparse_vectors(tfidf.term_counts(texts, analyzer), vocabulary)
    vectors = vectors.withColumnRenamed("doc_id", "id")
    out = curate.venue_payload(venues).join(vectors, "id", "left")
    empty = F.struct(
        F.array().cast("array<int>").alias("indices"),
        F.array().cast("array<double>").alias("values"),
    )
    out = out.withColumn("sparse", F.coalesce("sparse", empty))
    if encoder is not None:
        out = out.join(encoder(texts).withColumnRenamed("doc_id", "id"), "id", "left")
    return out


def rejects_of(root: str) -> str:
    """Where rows without a key go when the caller names no place."""
    return f"{root.rstrip('/')}_rejects"


def ingest(
    raw: DataFrame,
    root: str,
    model_path: str,
    encoder=None,
    keys: tuple[str, ...] = ("name",),
    version: int | None = None,
    rejects: str | None = None,
    buckets: int = store.BUCKETS,
) -> int:
    """Curate, index and upsert a venue table; returns the version written.

    Dedup is by name by default although ids use name and district; pass
    ``keys=("name", "district")`` to keep branches apart. Rows without a key are written to
    ``rejects`` (default: ``root`` with ``_rejects`` added), one folder per batch, which running the
    batch again overwrites.
    """
    if version is None:
        version = store.next_version(raw.sparkSession, root)
    venues = curate.venue_columns(raw)
    kept, bad = curate.dedup_keep_last(venues, keys)
    write_rejects(bad, f"{rejects or rejects_of(root)}/batch={version}", mode="overwrite")
    # Read by the vocabulary, the points and the size check: computed once.
    kept = cut(kept)
    vocabulary = fit_or_load(index_texts(kept), model_path)
    rows = points(kept, vocabulary, encoder=encoder)
    return store.upsert(root, rows, version=version, sort_by=["district", "id"], buckets=buckets)


def record_points(
    records: DataFrame, vocabulary: DataFrame, encoder=None
) -> tuple[DataFrame, DataFrame]:
    """(points of valid records with random ids, rejected records with reasons).

    The vocabulary is fitted by the caller on all records, rejected ones included.
    ``records`` carries ``ord``, a unique row number.
    """
    require_columns(records.columns, [*EXTRACTED_FIELDS, "ord"])
    kept, bad = curate.split_valid(records)
    texts = kept.select(F.col("ord").alias("doc_id"), curate.record_text().alias("text"))
    counts = tfidf.term_counts(texts, RECORD_MODEL["analyzer"])
    vectors = tfidf.sparse_vectors(counts, vocabulary).withColumnRenamed("doc_id", "ord")
    out = curate.record_payload(kept, "ord").join(vectors, "ord", "left")
    if encoder is not None:
        out = out.join(encoder(texts).withColumnRenamed("doc_id", "ord"), "ord", "left")
    return out.withColumn("id", random_id()), bad
