"""The corpus pipeline: stages applied one after the other to documents.

Each stage reads all that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, decontam, lines, quality, weighted
from wayfare.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold."""
    docs = docs.select(COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least ten documents share; n_chars follows."""
    out = lines.drop_frequent_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near-duplicates; of rows equal in id and text one.

    Rows that link with nothing, those of a null id or without words, all stay.
    """
    docs = docs.select(COLUMNS)
    kept = weighted.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    keys = docs.filter(linked).groupBy("doc_id", F.xxhash64("text").alias("th")).count()
    repeated = not keys.filter("count > 1").isEmpty()
    docs = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    if repeated:
        # The least row of each id and text: which one stays does not depend on the order of tasks.
        rest = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")])
        alone = docs.withColumn("alone", F.when(~linked, F.monotonically_increasing_id()))
        one = alone.groupBy("doc_id", "text", "alone").agg(F.min(rest).alias("rest"))
        docs = one.select("doc_id", "text", "rest.*").select(COLUMNS)
    return docs


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, decided for each row by itself."""
    docs = docs.select(COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = found.select(F.col("d").alias("hit_d"), F.col("th").alias("hit_th")).distinct()
    d, th = decontam.row_keys()
    return docs.join(hit, (d == F.col("hit_d")) & (th == F.col("hit_th")), "left_anti")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; the text is what the ids decode to."""
    coded = bpe.encode_and_decode(docs.select(COLUMNS))
    text = F.decode("decoded", "UTF-8").alias("text")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return coded.select("doc_id", text, *rest, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good_quality),
    ("line_dedup", drop_frequent_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", keep_clean_of_benchmark),
    ("tokens", encode_and_decode),
]

#: SQL can express neither the classifier nor the sampled near-duplicates nor BPE; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
