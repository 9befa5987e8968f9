"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import (
    bpe,
    debruijn,
    decontam,
    importance,
    itq,
    lines,
    pii,
    quality,
    secretscan,
    shards,
    tokens,
    weighted,
    whitening,
)
from wayfare.llm.common import table
from wayfare.session import shared_folder


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.drop_frequent_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _equal_to(number: int):
    """Marks elements that are ``number``, null for all others."""
    return lambda x: F.when(x == number, x)


def op2_boosted_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _equal_to(k)))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(pii.KINDS)
    ]
    digest = F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.spelled(F.col("spans")).alias("spans"))


def op3_de_bruijn_spans(spark: SparkSession, sf: str) -> DataFrame:
    out = debruijn.drop_repeated_spans(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_itq_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    return itq.linked_vectors(table(spark, sf, "embeddings"))


def op5_rans_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/op5-{uuid.uuid4().hex}"
    tokens.write(table(spark, sf, "documents"), path)
    crc = F.crc32("ids").alias("ids_crc32")
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", crc)


def op6_prefix_join_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", predicted)


def op8_duckdb_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf, "documents").select("doc_id", "text"))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.shard_rows(table(spark, sf, "documents").select("doc_id", "text"))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_weighted_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return weighted.near_duplicates(table(spark, sf, "documents"))


def op11_bit_sliced_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = importance.importance_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spectrum_sliced_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf, "embeddings"))


def op13_randomness_battery_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secretscan.secrets(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _equal_to(k)))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(secretscan.KINDS[:3])
    ]
    digest = F.sha2(secretscan.spelled(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secretscan.spelled(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_boosted_personal_data": op2_boosted_personal_data,
    "op3_de_bruijn_spans": op3_de_bruijn_spans,
    "op4_itq_embedding_links": op4_itq_embedding_links,
    "op5_rans_token_blocks": op5_rans_token_blocks,
    "op6_prefix_join_decontamination": op6_prefix_join_decontamination,
    "op7_compression_quality": op7_compression_quality,
    "op8_duckdb_bpe": op8_duckdb_bpe,
    "op9_hypergeometric_shards": op9_hypergeometric_shards,
    "op10_weighted_near_duplicates": op10_weighted_near_duplicates,
    "op11_bit_sliced_resampling": op11_bit_sliced_resampling,
    "op12_spectrum_sliced_whitening": op12_spectrum_sliced_whitening,
    "op13_randomness_battery_secrets": op13_randomness_battery_secrets,
}
