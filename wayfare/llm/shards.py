"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are counted per input partition. A row of the matrix says how many rows a partition sends to
each block of each shard; the draws are without replacement, so every block gets exactly its size.
No one holds the matrix: it is split along a binary tree over the partitions with seeded draws,
and each task walks down to its own row. A split is itself made along a binary tree over the blocks, all nodes
of a level at once. Each partition deals its rows out at random in these numbers, rows are exchanged
by block, and each block is permuted again. All orders of all rows are equally likely (Sanders
1998), no sort of the whole table happens, and equal texts are rows like others, so groups of
copies cause no skew. Draws from more rows than numpy's generator takes are made here by
rejection, with the law's logarithm by saddle points (Loader 2000), so there is no largest table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# numpy draws from fewer rows than this.
NUMPY_LIMIT = 10**9


def blocks_of(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of every block; shards differ by one row at most, and so do the
    blocks of a shard."""
    shard, first, size = [], [], []
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        count = max(1, -(-own // block_rows))
        sizes = np.full(count, own // count, np.int64)
        sizes[: own % count] += 1
        shard.append(np.full(count, s, np.int32))
        first.append(np.cumsum(sizes) - sizes)
        size.append(sizes)
    return np.concatenate(shard), np.concatenate(first), np.concatenate(size)


def _rest(n: np.ndarray) -> np.ndarray:
    """log(n!) less Stirling's formula for it."""
    n = np.asarray(n, float)
    m = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m**2) / m**2) / m**2) / m
    table = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 17)])
    small = n < 16
    return np.where(small, table[np.where(small, n, 0).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without loss where x is near the mean."""
    d = (x - mean) / np.maximum(mean, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    # mean * ((1 + d) log(1 + d) - d) by its series
    near = mean * d * d * (1 / 2 - d * (1 / 6 - d * (1 / 12 - d * (1 / 20 - d * (1 / 30 - d / 42)))))
    return np.where(np.abs(d) < 0.01, near, far)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the binomial law, for 0 < p < 1, to double precision at any size."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    inner = (x > 0) & (x < n)
    xi, ni = np.where(inner, x, 1.0), np.where(inner, n, 2.0)
    rest = _rest(ni) - _rest(xi) - _rest(ni - xi)
    log = rest - _deviance(xi, ni * p) - _deviance(ni - xi, ni * (1 - p)) - 0.5 * np.log(2 * math.pi * xi * (1 - xi / ni))
    return np.where(inner, log, np.where(x == 0, n * np.log1p(-p), n * np.log(p)))


def _log_law(x: np.ndarray, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Logarithm of the hypergeometric law, up to a constant of ``good``, ``bad`` and ``drawn``."""
    p = drawn / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(drawn - x, bad, p)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """How many of ``drawn`` rows, taken without replacement, are among ``good``; element by element.

    Beyond the totals that numpy takes: rejection from the ratio of uniforms (Stadlober 1990).
    """
    good, bad, drawn = (np.asarray(v, np.int64) for v in (good, bad, drawn))
    out = np.zeros(len(good), np.int64)
    total = good + bad
    plain = total < NUMPY_LIMIT
    out[plain] = rng.hypergeometric(good[plain], bad[plain], drawn[plain])
    # Without chance: nothing or everything is drawn, or all rows are of one kind.
    sure = ~plain & ((drawn == 0) | (drawn == total) | (good == 0) | (bad == 0))
    out[sure] = np.where(bad[sure] == 0, drawn[sure], np.where(drawn[sure] == total[sure], good[sure], 0))
    left = np.flatnonzero(~plain & ~sure)
    g, b, d = (v[left].astype(float) for v in (good, bad, drawn))
    n = g + b
    mean = d * (g / n)
    spread = np.sqrt(mean * (b / n) * ((n - d) / np.maximum(n - 1, 1)) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    mode = np.clip(np.floor((d + 1) * ((g + 1) / (n + 2))), np.maximum(0, d - b), np.minimum(g, d))
    top = _log_law(mode, g, b, d)
    while len(left):
        u, v = 1 - rng.random(len(left)), rng.random(len(left))
        x = np.floor(mean + 0.5 + width * (v - 0.5) / u)
        inside = (x >= np.maximum(0, d - b)) & (x <= np.minimum(g, d))
        law = _log_law(np.where(inside, x, mode), g, b, d)
        taken = inside & (2 * np.log(u) <= law - top)
        out[left[taken]] = x[taken].astype(np.int64)
        keep = ~taken
        left, g, b, d, mean, width, mode, top = (a[keep] for a in (left, g, b, d, mean, width, mode, top))
    return out


def dealt(rng: np.random.Generator, sizes: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` rows, taken from all blocks without replacement, come from each block."""
    levels = [np.asarray(sizes, np.int64)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append(np.pad(last, (0, len(last) % 2)).reshape(-1, 2).sum(1))
    taken = np.array([rows], np.int64)
    for below in reversed(levels[:-1]):
        pairs = np.pad(below, (0, len(below) % 2)).reshape(-1, 2)
        first = hypergeometric(rng, pairs[:, 0], pairs[:, 1], taken)
        taken = np.stack([first, taken - first], 1).ravel()[: len(below)]
    return taken


def matrix_row(counts: np.ndarray, sizes: np.ndarray, row: int, seed: int) -> np.ndarray:
    """Rows that partition ``row`` sends to each block: row sums are ``counts``, column sums ``sizes``.

    The draw of a tree node depends on the seed and the node alone, so all tasks agree on it.
    """
    low, high, left = 0, len(counts), np.asarray(sizes, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        lower = dealt(rng, left, int(counts[low:middle].sum()))
        if row < middle:
            high, left = middle, lower
        else:
            low, left = middle, left - lower
    return left.copy()


def shard_rows(
    docs: DataFrame, shards: int = 8, block_rows: int = 4096, seed: int = 7
) -> DataFrame:
    """``docs`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by at most one row; shard and slot are uniformly random given ``seed``.
    ``docs`` must give the same partitions each time it is computed, as scans of files do; stage
    other inputs first. A partition that changes size between counting and dealing raises instead
    of losing rows. Nulls, repeated rows and long texts are rows like others. Columns already named
    shard or slot are replaced; the others pass unchanged. An empty table gives an empty table.
    The driver holds one count per partition, a task one number per block and per row of its own
    partition. Blocks are of about ``block_rows`` rows, or larger where there would be more than
    eight for each partition, so their number follows the partitions, not the rows.
    """
    docs = docs.drop("shard", "slot")
    counted = docs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    parts = {r["p"]: i for i, r in enumerate(sorted(counted, key=lambda r: r["p"]))}
    counts = np.array([r["count"] for r in sorted(counted, key=lambda r: r["p"])], np.int64)
    block_rows = max(block_rows, -(-int(counts.sum()) // (8 * max(1, len(counts)))))
    sent = docs.sparkSession.sparkContext.broadcast((parts, counts))

    def deal(batches):
        part = TaskContext.get().partitionId()
        rows, numbers = sent.value
        shard, first, sizes = blocks_of(int(numbers.sum()), shards, block_rows)
        known = part in rows
        own = matrix_row(numbers, sizes, rows[part], seed) if known else np.zeros_like(sizes)
        ends, rng, done = np.cumsum(own), np.random.default_rng([seed, part]), 0
        # Row i of the partition takes place order[i] of those that the matrix gives it.
        order = rng.permutation(int(ends[-1]))
        for batch in batches:
            n = batch.num_rows
            if done + n > len(order):
                raise ValueError("a partition grew between counting and dealing: stage the input")
            block = np.searchsorted(ends, order[done : done + n], side="right")
            done += n
            place = rng.integers(-(2**63), 2**63, n, np.int64)
            added = [pa.array(shard[block]), pa.array(first[block]), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])
        if done < len(order):
            raise ValueError("a partition shrank between counting and dealing: stage the input")

    names = ["shard", "__first", "__place"]
    types = [T.IntegerType(), T.LongType(), T.LongType()]
    fields = [T.StructField(n, t) for n, t in zip(names, types, strict=True)]
    dealt = docs.mapInArrow(deal, T.StructType([*docs.schema.fields, *fields]))
    order = Window.partitionBy("shard", "__first").orderBy("__place")
    slot = F.col("__first") + F.row_number().over(order) - 1
    return dealt.select(*docs.columns, "shard", slot.cast("long").alias("slot"))
