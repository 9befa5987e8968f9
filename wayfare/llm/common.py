"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once to the shared checkpoint folder and read it back.

    This cuts lineage and survives lost executors; Parquet keeps it smaller than a checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One long that stands for a row's id and text; equal rows share it, null ids are fine."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of single bytes take the fast way; others go by character."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def kept_by_worker(key: tuple, make):
    """What ``make`` returns, made once per Python process and key.

    Functions of this package travel to workers by value, so its globals end with each task; a
    module of its own in the worker's list of modules outlives them.
    """
    name = "wayfare_kept_by_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
