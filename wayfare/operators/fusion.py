"""Fusion of ranked candidate lists: reciprocal ranks or scaled scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.search import DIGITS, dense_topk, ranked, sparse_topk

RRF_K = 60
PREFETCH = 3


def lists_together(**lists: DataFrame) -> DataFrame:
    """(list, query_id, doc_id, score, rank) of all candidate lists."""
    out = None
    for name, hits in lists.items():
        part = hits.select(F.lit(name).alias("list"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(candidates: DataFrame, constant: int = RRF_K) -> DataFrame:
    """Sum over lists of 1 / (constant + rank), ranks from 1."""
    share = 1.0 / (F.col("rank") + constant)
    return candidates.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(share), DIGITS).alias("score")
    )


def list_statistics(candidates: DataFrame) -> DataFrame:
    """Mean and sample deviation of the scores of each list; a list is a bounded prefetch."""
    whole = Window.partitionBy("query_id", "list")
    return candidates.withColumn("mean", F.avg("score").over(whole)).withColumn(
        "deviation", F.stddev_samp("score").over(whole)
    )


def dbsf(candidates: DataFrame) -> DataFrame:
    """Sum over lists of the score scaled so that mean -/+ 3 deviations map to 0 and 1."""
    spread = F.nullif(F.col("deviation"), F.lit(0.0)) * 6
    low = F.col("mean") - 3 * F.col("deviation")
    scaled = F.coalesce((F.col("score") - low) / spread, F.lit(0.5))
    return (
        list_statistics(candidates)
        .withColumn("scaled", scaled)
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("scaled"), DIGITS).alias("score"))
    )


def fuse(candidates: DataFrame, k: int, method: str = "RRF") -> DataFrame:
    """Top k of the fused lists; any method but RRF means DBSF."""
    return ranked(rrf(candidates) if method.upper() == "RRF" else dbsf(candidates), k)


def hybrid_topk(
    docs_dense: DataFrame,
    queries_dense: DataFrame,
    vectors: DataFrame | None,
    query_weights: DataFrame | None,
    k: int = 10,
    prefetch: int = PREFETCH,
    method: str = "RRF",
) -> DataFrame:
    """Sparse and dense candidates (k * prefetch each), fused.

    Without a sparse model the result is the plain dense top-k.
    """
    if vectors is None or query_weights is None:
        return dense_topk(docs_dense, queries_dense, k)
    return fuse(
        lists_together(
            sparse=sparse_topk(vectors, query_weights, k * prefetch),
            dense=dense_topk(docs_dense, queries_dense, k * prefetch),
        ),
        k,
        method,
    )


def sparse_fused_topk(
    vectors: DataFrame, query_weights: DataFrame, k: int = 3, prefetch: int = PREFETCH
) -> DataFrame:
    """One filtered sparse list put through reciprocal rank fusion."""
    return fuse(lists_together(sparse=sparse_topk(vectors, query_weights, k * prefetch)), k)
