"""Quality by compression: which of two dictionaries, of good or of bad text, shortens a text more.

Two zstandard dictionaries are trained, one from texts labelled good and one from texts labelled
bad. Each text is compressed with both, in pieces of equal size so that a long text does not wear
the dictionaries' part off. The difference of the two sizes over their sum tells which dictionary
fits; sizes small against the text itself tell of repetition, which fits both. A logistic curve,
fitted on labelled texts that the dictionaries did not see, makes these a probability. Only a
bounded sample of labelled rows is fitted on; all rows are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
PIECE = 2048
SHRINK = 256
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def sizes(self, texts) -> list[tuple[int, int, int, float]]:
        """(bytes, size with the good dictionary, with the bad one, smallest share of a piece)."""
        good, bad = (
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(d),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for d in (self.good, self.bad)
        )
        out = []
        for text in texts:
            data = (text or "").encode("utf-8")
            with_good = with_bad = 0
            least = 1.0
            for i in range(0, len(data), PIECE):
                piece = data[i : i + PIECE]
                g, b = len(good.compress(piece)), len(bad.compress(piece))
                with_good, with_bad = with_good + g, with_bad + b
                # The last piece counts as if it were whole, else short ends look repetitive.
                least = min(least, (min(g, b) + PIECE - len(piece)) / PIECE)
            out.append((len(data), with_good, with_bad, least))
        return out

    def features(self, texts) -> np.ndarray:
        """Rows of (difference, share, least share, 1); an empty text has (0, 0, 0, 1)."""
        n, good, bad, least = np.array(self.sizes(texts), float).reshape(-1, 4).T
        # SHRINK bytes more on each side: a few bytes of difference in a short text prove little.
        difference = (bad - good) / (bad + good + SHRINK)
        share = np.log((good + bad + SHRINK) / (2 * n + SHRINK))
        return np.stack([difference, share, np.log(least), np.ones_like(n)], 1)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -500, 500)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; few or uniform samples, which the trainer refuses, serve as they are."""
    pieces = [s[i : i + 4096] for s in samples for i in range(0, len(s), 4096)]
    size = max(1024, min(size, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by Newton steps; a weak pull to 0 keeps separable data finite."""
    scale = x.std(0)
    scale[scale == 0] = 1.0
    design, w = x / scale, np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 2000,
    sample_chars: int = 50_000,
    dictionary_bytes: int = 112_000,
) -> CompressionModel:
    """Fit on at most ``sample_rows`` labelled texts of each class, none of them held out.

    Rows equal in id and text count once. The ids are those with the smallest hash, and of their texts
    those with the smallest hash of id and text, so the sample is the same each time. Texts
    over ``sample_chars`` are not learned from, which bounds the sample in bytes; they are scored like
    all others. Half of the sample trains the dictionaries, the other half fits the curve. Labels
    other than 0 and 1, null ids and null texts are not learned from. Without both classes every
    score is the share of good labels (one half without any label).
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "quality").filter(~held_out()).dropDuplicates()
    order = F.xxhash64("doc_id", F.lit(11))
    parts = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(sample_rows) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # At most 2 * sample_rows rows of two numbers: their size is bounded, so they can be broadcast.
    own = docs.select("doc_id", "text").filter(F.char_length("text") <= sample_chars)
    rows = own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text", "quality"])
    order = F.xxhash64("doc_id", "text", F.lit(11))
    parts = [rows.filter(F.col("quality") == q).orderBy(order, "doc_id", "text").limit(sample_rows) for q in (0, 1)]
    rows = parts[0].unionByName(parts[1]).toPandas().sort_values(["doc_id", "text"])
    good = rows[rows.quality == 1].text.str.encode("utf-8").tolist()
    bad = rows[rows.quality == 0].text.str.encode("utf-8").tolist()
    if not good or not bad:
        share = np.clip(len(good) / (len(good) + len(bad)) if good or bad else 0.5, 0.01, 0.99)
        return CompressionModel(b"\n", b"\n", (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    half = max(1, len(good) // 2), max(1, len(bad) // 2)
    # Equal bytes of both, else the dictionary with more text has better statistics.
    most = min(sum(map(len, good[: half[0]])), sum(map(len, bad[: half[1]])))
    held = [x[: max(1, int(np.searchsorted(np.cumsum([len(s) for s in x]), most)))] for x in (good[: half[0]], bad[: half[1]])]
    plain = CompressionModel(*(_dictionary(x, dictionary_bytes) for x in held), (0.0,) * 4)
    fresh = (good[half[0] :] or good) + (bad[half[1] :] or bad)
    y = np.array([1.0] * len(good[half[0] :] or good) + [0.0] * len(bad[half[1] :] or bad))
    weights = _logistic(plain.features([t.decode("utf-8") for t in fresh]), y)
    return CompressionModel(plain.good, plain.bad, weights)


def score(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better quality likelier), replacing a column of that name.

    Whole texts are read. Null and empty texts get the score of no difference and no repetition.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return docs.withColumn("score", scores(F.col(text)))


def is_held_out(doc_id) -> bool:
    """The rule of ``held_out`` for one id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
