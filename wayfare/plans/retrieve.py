"""Questions to ranked venues: place lookup, filter, candidates, fusion, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.places_hk import HONG_KONG
from wayfare.functions.text import query_text
from wayfare.operators import fusion, search
from wayfare.operators.gazetteer import Alias, places


def asked(questions: DataFrame, aliases: list[Alias] = HONG_KONG) -> DataFrame:
    """(query_id, text, tags) from (query_id, text): tags are the districts named."""
    return questions.select(
        "query_id", query_text("text").alias("text"), places("text", aliases).alias("tags")
    )


def search_venues(
    points: DataFrame,
    questions: DataFrame,
    vocabulary: DataFrame | None,
    k: int = 3,
    prefetch: int = fusion.PREFETCH,
    method: str = "RRF",
    analyzer: str = "char_wb",
    encoder=None,
    aliases: list[Alias] = HONG_KONG,
) -> DataFrame:
    """(query_id, rank, score, payload...) of the top k venues per question.

    With a vocabulary and no encoder: one sparse list. With both: sparse and dense lists fused.
    Without a vocabulary: dense only. All questions run in one job.
    """
    if vocabulary is None and encoder is None:
        raise ValueError("neither a vocabulary nor an encoder was given")
    wanted = asked(questions, aliases)
    lists = {}
    if vocabulary is not None:
        stored = points.select(
            F.col("id").alias("doc_id"), F.col("district").alias("tag"), "sparse"
        )
        q = search.query_weights(wanted, vocabulary, analyzer)
        lists["sparse"] = search.sparse_topk(stored, q, k * prefetch)
    if encoder is not None:
        vectors = encoder(wanted.select(F.col("query_id").alias("doc_id"), "text"))
        q = wanted.join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id")
        lists["dense"] = search.dense_topk(
            points.select(F.col("id").alias("doc_id"), "embedding", F.col("district").alias("tag")),
            q,
            k if vocabulary is None else k * prefetch,
        )
    if vocabulary is None:
        best = lists["dense"]
    else:
        best = fusion.fuse(fusion.lists_together(**lists), k, method)
    payload = points.drop("sparse", "embedding").withColumnRenamed("id", "doc_id")
    hits = search.payload_for(best, payload, k * questions.count())
    return hits.withColumnRenamed("doc_id", "id")
