"""Target-distribution importance resampling over hashed word runs, weighed on bit planes.

Every run of one to three words falls into one of 10,000 buckets by its crc32. Bucket counts of all
documents and of all target texts give each bucket a gain, a signed integer: a scaled logarithm of
the ratio of smoothed shares. A document's counts are cut into bit planes of 10,000 bits, plane j
holding bit j of every count; the gains are cut into planes of positive and of negative bits. One AND
of two planes and a population count say how often 2^j meets 2^k, so the weight, the sum of
count times gain, is a sum of popcounts times powers of two: exact, without one multiplication by
a gain. Gumbel noise from a hash of the id turns the weights into keys whose largest are a sample
without replacement in proportion to the importance.

The crc32 of a run is put together from those of its words: appending L bytes is a linear map of 32
bits, tabulated for each L, so runs of a whole batch of texts are hashed as arrays.
"""

from __future__ import annotations

import math
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import kept_by_worker, parallelism, staged
from wayfare.llm.units import slices
from wayfare.llm.wordhash import whole_runs

BUCKETS = 10_000
RUN = 3
SCALE = 1000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Longer words are hashed one by one.
_TABLED = 64
_SLICE = 2_000_000
# Texts whose planes are counted at once.
_DOCS = 64

#: A-Z to a-z; bytes that are no part of a word to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def _appending() -> tuple[np.ndarray, np.ndarray]:
    """(maps, spaces): maps[L, k, b] is what byte k of value b of a crc32 becomes when L bytes follow,
    spaces[L] the crc32 of a space before L bytes of zero effect."""
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    one ^= one[0]  # the table of the plain polynomial, without inversions
    maps = np.empty((_TABLED + 2, 4, 256), np.uint32)
    maps[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, len(maps)):
        before = maps[n - 1]
        maps[n] = one[before & 255] ^ (before >> np.uint32(8))
    space = np.uint32(zlib.crc32(b" "))
    spaces = np.array([_moved(maps, np.array([space]), np.array([n]))[0] for n in range(_TABLED + 1)], np.uint32)
    return maps, spaces


def _moved(maps: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each crc32 becomes, apart from the bytes' own crc32, when ``length`` bytes are appended."""
    out = maps[length, 0, crc & 255]
    for k in (1, 2, 3):
        out ^= maps[length, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def run_buckets(words: list[list[bytes]], buckets: int = BUCKETS, longest: int = RUN):
    """[(bucket, text)] of the runs of 1, 2, ... ``longest`` words of each text, joined by one space."""
    maps, spaces = kept_by_worker(("crc32",), _appending)
    flat = [w for own in words for w in own]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    own = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    tabled = np.minimum(size, _TABLED)
    after_space = spaces[tabled] ^ own
    far = np.flatnonzero(size > _TABLED)
    for i in far.tolist():
        after_space[i] = zlib.crc32(b" " + flat[i])
    out, runs = [], own
    for n in range(1, longest + 1):
        places, owner = whole_runs(counts, n)
        out.append(((runs[places] % np.uint32(buckets)).astype(np.int64), owner))
        if n == longest or len(flat) <= n:
            continue
        more = _moved(maps, runs[:-1], tabled[n:] + 1) ^ after_space[n:]
        for i in far[far >= n].tolist():
            more[i - n] = zlib.crc32(b" " + flat[i], int(runs[i - n]))
        runs = more
    return out


def _counted(texts: list[str | None], buckets: int, longest: int):
    """(first text, counts of each of some texts in each bucket, their words), in order of the texts."""
    texts = [t or "" for t in texts]
    for a, b in slices(texts, _SLICE):
        for c in range(a, b, _DOCS):
            words = [words_of(t) for t in texts[c : min(b, c + _DOCS)]]
            total = np.zeros(len(words) * buckets, np.int64)
            for bucket, owner in run_buckets(words, buckets, longest):
                total += np.bincount(owner * buckets + bucket, minlength=len(total))
            yield c, total.reshape(len(words), buckets), np.fromiter(map(len, words), np.int64, len(words))


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = RUN) -> np.ndarray:
    """Runs of all ``texts`` in each bucket. Tasks send one sum per bucket; the driver gets as many."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, counts, _ in _counted(batch.column(0).to_pylist(), buckets, longest):
                total += counts.sum(0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    sums = texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of each bucket, target over source."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(scale * math.log((float(y) + 1) * (s + buckets) / ((float(x) + 1) * (t + buckets))))
            for x, y in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def planes(rows: np.ndarray) -> np.ndarray:
    """Bits of each row packed into 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, worth): the bits of all positive and of all negative gains, and what each bit is worth."""
    bits, worth = [], []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            bits.append((size >> k) & 1)
            worth.append(sign << k)
    if not bits:
        return np.zeros((0, -(-len(gain) // 64)), np.uint64), np.zeros(0, np.int64)
    return planes(np.array(bits, np.uint8)), np.array(worth, np.int64)


def weights(counts: np.ndarray, signed: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Sum of count times gain of each row of ``counts``, by AND and popcount of planes."""
    out = np.zeros(len(counts), np.int64)
    most = counts.max(1, initial=0)
    for j in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> j)
        own = planes(((counts[rows] >> j) & 1).astype(np.uint8))
        met = np.bitwise_count(own[:, None, :] & signed[None, :, :]).sum(2, dtype=np.int64)
        out[rows] += (met @ worth) << j
    return out


def noise(doc_id: int | None, seed: int = SEED, scale: int = SCALE) -> int:
    """floor(scale times a Gumbel variate) from a hash of the id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, scale: int = SCALE, longest: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((len(gain), *gain_planes(gain)))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def weigh(batches):
        buckets, signed, worth = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, counts, n_words in _counted(batch.column(1).to_pylist(), buckets, longest):
                own = ids[first : first + len(n_words)]
                weight = weights(counts, signed, worth)
                score = weight + np.fromiter((noise(i, seed, scale) for i in own), np.int64, len(own))
                columns = [own, n_words, counts.sum(1), weight, score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, schema)


def ranked(rows: DataFrame, wanted: int, eligible: str, order: list) -> DataFrame:
    """``rows`` with rank (long) of the first ``wanted`` eligible rows in ``order``, null for others.

    Rows are laid out in ranges of the order; the driver holds one count per range, and only ranges
    that reach into the first ``wanted`` rows are numbered. No task holds more than its range.
    """
    spark = rows.sparkSession
    parts = parallelism(spark)
    chosen = rows.filter(eligible).withColumn("__tie", F.monotonically_increasing_id())
    # Written with its tie breaker first, so that every later read sees the same order.
    chosen = staged(chosen, "resample-rows")
    ranged = chosen.repartitionByRange(parts, *order, "__tie").withColumn("__part", F.spark_partition_id())
    ranged = staged(ranged, "resample-ranges")
    before, offset = [], 0
    for row in sorted(ranged.groupBy("__part").count().collect()):
        if offset < wanted:
            before.append((row["__part"], offset))
        offset += row["count"]
    starts = spark.createDataFrame(before, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie"))
    first = ranged.join(F.broadcast(starts), "__part").withColumn("rank", place + F.col("__before"))
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank")
    later = ranged.join(F.broadcast(starts), "__part", "left_anti")
    none = F.lit(None).cast("long").alias("rank")
    rest = rows.filter(f"not ({eligible})")
    out = first.select(*rows.columns, rank)
    return out.unionByName(later.select(*rows.columns, none)).unionByName(rest.select(*rows.columns, none))


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = RUN,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased. Of the documents with at
    least ``min_words`` words, floor(percent * number / 100) of highest score are drawn and ranked
    from 1; others have a null rank. Ties go to the smaller doc_id (a null id after all others), rows
    equal in both to any one of them. Null and empty texts have no words, no features and weight 0.
    A null id is hashed as the empty text. Every row counts and is one document, repeated rows
    and copies included. ``target`` needs a column text; an empty target gives gains all the same.
    Other columns are ignored; an empty table gives an empty table.
    """
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest), scale)
    rows = staged(scored(docs, gain, seed, scale, longest), "resample")
    eligible = f"n_words >= {int(min_words)}"
    wanted = percent * rows.filter(eligible).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return ranked(rows, wanted, eligible, order)
