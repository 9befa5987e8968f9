"""Skew-safe helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this k Spark plans no partial group limit (its windowGroupLimitThreshold default).
GROUP_LIMIT = 1000


def names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def top_k(df: DataFrame, by, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group with their rank from 1.

    Spark cuts each map task's rows to k per group before the shuffle, so a hot group costs
    no more than the others. Past Spark's threshold a hashed sub-group is cut first instead.
    """
    keys = names(by)
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64))
        inner = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_r", F.row_number().over(inner))
            .filter(F.col("_r") <= k)
            .drop("_r", "_part")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def keep_last(df: DataFrame, key: Column, order) -> DataFrame:
    """Last row per key. Null keys are not a group: filter them out first."""
    keyed = df.withColumn("_key", key)
    last = top_k(keyed, "_key", [F.col(c).desc() for c in names(order)], 1, "_rank")
    return last.drop("_key", "_rank")


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether a DataFrame has at most ``max_rows`` rows, reading no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast after a size check; otherwise leave the join to a (skew-split) shuffle."""
    return F.broadcast(df) if small(df, max_rows) else df


def spread_join(
    rows: DataFrame, dims: DataFrame, keys, row_id: str, count: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Inner join of many ``rows`` to ``dims`` whose ``count`` says how many rows a key has.

    Keys above ``hot_rows`` are split over several tasks by a salt and their dims rows are
    repeated per salt. There are at most (all rows / hot_rows) such keys, so their list is a
    safe broadcast.
    """
    keys = names(keys)
    salts = F.ceil(F.col(count) / F.lit(hot_rows)).cast("int")
    hot = dims.filter(F.col(count) > hot_rows).groupBy(*keys).agg(F.max(salts).alias("_salts"))
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    repeated = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
