"""A point table in hash buckets of its key, on any Hadoop file system.

Rows lie in folders ``rows/bucket=n`` by the hash of their key. A batch touches only the buckets of its own
keys: these are read, merged and overwritten as partitions, all other files stay as they are.
The merged buckets are written aside before any is replaced, and a batch counts once its number
is noted, so a batch that broke off is finished, or begun anew, by running it again, and one that
ended changes nothing when it is run again. One writer at a time; a reader that started before a
batch may have to start again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.grouping import broadcast_if_small, keep_last
from wayfare.session import cut

MAX_NEW_IDS = 5_000_000
BUCKETS = 64


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm = _file_system(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, jvm = _file_system(spark, folder)
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that ended, ascending."""
    return _numbers(spark, f"{root}/batches")


def next_version(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root), default=-1) + 1


def _note(spark: SparkSession, root: str, version: int) -> None:
    fs, jvm = _file_system(spark, root)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/batches/{version:012d}"), True).close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, jvm = _file_system(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def _pending(root: str, version: int) -> str:
    return f"{root}/pending/{version:012d}"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    # Later batches may have brought columns that untouched buckets lack.
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/rows")


def read(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    """All rows, or None when there is no table."""
    if not versions(spark, root):
        return None
    return _rows(spark, root, schema).drop("bucket")


def create(spark: SparkSession, root: str, schema: T.StructType, recreate: bool = False) -> None:
    """An empty table; an existing one is left alone unless ``recreate``, which empties it."""
    if versions(spark, root) and not recreate:
        return
    version = next_version(spark, root)
    if recreate:
        _delete(spark, f"{root}/rows")
        _delete(spark, f"{root}/pending")
    # A file without rows holds the schema until there are rows.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/rows/bucket=0")
    _note(spark, root, version)


def merged(
    old: DataFrame | None, new: DataFrame, key: str = "id", order: str | None = None
) -> DataFrame:
    """Rows of ``old`` not in ``new``, and all of ``new``; with ``order`` the last row per key.

    The old table is not shuffled when the new ids pass the broadcast check.
    """
    if order is not None:
        new = keep_last(new, F.col(key), order).drop(order)
    if old is None:
        return new
    ids = broadcast_if_small(new.select(key).distinct(), MAX_NEW_IDS)
    return old.join(ids, key, "left_anti").unionByName(new, allowMissingColumns=True)


def _publish(spark: SparkSession, root: str, version: int, sort_by: list[str]) -> None:
    """Replace the buckets of a merged batch by its rows, and note it."""
    rows = spark.read.parquet(_pending(root, version))
    order = ["bucket", *sort_by]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(f"{root}/rows")
    )
    _note(spark, root, version)
    _delete(spark, _pending(root, version))


def upsert(
    root: str,
    new: DataFrame,
    key: str = "id",
    order: str | None = None,
    version: int | None = None,
    sort_by: list[str] | None = None,
    buckets: int = BUCKETS,
) -> int:
    """Merge ``new`` into the buckets of its keys as batch ``version``; returns that number.

    Keys must not be null; of several rows of a key the last by ``order`` stays. A batch that has ended
    is not run again. ``sort_by`` clusters each file on filter columns, so row-group statistics
    prune scans. ``buckets`` must be the same for all batches of a table; choose it for buckets of
    some hundred megabytes. The driver holds the numbers of the touched buckets.
    """
    spark = new.sparkSession
    known, sort_by = versions(spark, root), sort_by or [key]
    left = [n for n in _numbers(spark, f"{root}/pending") if exists(spark, f"{_pending(root, n)}/_SUCCESS")]
    for number in left:
        # Merged before a break, perhaps replaced in part: its rows hold whole buckets.
        _publish(spark, root, number, sort_by)
        known = sorted({*known, number})
    if version is None:
        version = max(known, default=-1) + 1
    if version in known:
        return version
    if order is not None:
        new = keep_last(new, F.col(key), order).drop(order)
    if not exists(spark, f"{root}/rows"):
        spark.createDataFrame([], new.schema).write.parquet(f"{root}/rows/bucket=0")
    new = cut(new.withColumn("bucket", bucket_of(key, buckets)))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if touched:
        old = _rows(spark, root).filter(F.col("bucket").isin(touched))
        same = F.assert_true(
            F.col("bucket") == bucket_of(key, buckets), F.lit("the table has another number of buckets")
        )
        old = old.filter(same.isNull())
        merged(old, new, key).write.mode("overwrite").parquet(_pending(root, version))
        _publish(spark, root, version, sort_by)
    else:
        _note(spark, root, version)
    return version


def save_model(vocabulary: DataFrame, path: str) -> None:
    """Freeze a fitted vocabulary; an existing one is never refitted."""
    vocabulary.coalesce(1).write.mode("ignore").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame | None:
    """The frozen vocabulary, or None when there is none."""
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None
