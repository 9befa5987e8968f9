"""Line dedup: lines found in many documents lose all their copies.

Lines become 128-bit keys. Keys are counted with map-side sums, those of enough rows are joined back
to the (row, key) pairs, distinct documents are counted for them, and each row gets the short list of its
own frequent keys. Whole texts are shuffled once, for that last join. Every join is a plain
equi-join that Spark can split where one key is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import row_key, staged

_BLANK = b" \t\n\x0b\x0c\r"
_KEYS = "array<struct<a:bigint,b:bigint>>"


def _keys(line: bytes) -> bytes:
    """Normalised line: blanks stripped at both ends, A-Z lower-cased (bytes.lower is ASCII only)."""
    return line.lower().strip(_BLANK)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (
        len(key) >= 4 * min_chars or len(key.decode("utf-8")) >= min_chars
    )


def _line_keys(min_chars: int):
    def keys(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            lines = {_keys(x) for x in (text or "").encode("utf-8").split(b"\n")}
            digests = b"".join(xxhash.xxh3_128_digest(k) for k in lines if _long_enough(k, min_chars))
            out.append(
                [{"a": a, "b": b} for a, b in np.frombuffer(digests, ">i8").reshape(-1, 2).tolist()]
            )
        return pd.Series(out)

    return F.pandas_udf(keys, _KEYS)


def _without(min_chars: int):
    schema = T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    def drop(texts: pd.Series, frequent: pd.Series) -> pd.DataFrame:
        kept, n_lines, n_dropped = [], [], []
        for text, hot in zip(texts, frequent, strict=True):
            lines = (text or "").encode("utf-8").split(b"\n")
            n_lines.append(len(lines))
            stay = lines
            if hot is not None and len(hot):
                drop = {np.array([h["a"], h["b"]], ">i8").tobytes() for h in hot}
                stay = []
                for line in lines:
                    key = _keys(line)
                    if not _long_enough(key, min_chars) or xxhash.xxh3_128_digest(key) not in drop:
                        stay.append(line)
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode("utf-8"))
        return pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})

    return F.pandas_udf(drop, schema)


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with frequent lines removed from ``text``, and n_lines and n_dropped.

    A line's key is the line with blanks ([space, tab to carriage return]) stripped at both ends and
    A-Z lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines. Rows of one id are one document, however many; rows of a null id
    are one if their texts are equal. Every input row gives one row. A null or empty text is one empty line, which never has a key
    while ``min_chars`` is at least one; its kept text is ''. Other columns pass unchanged; columns
    already named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    keyed = docs.withColumn("__row", row_key(doc_id, text))
    document = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("null"), F.col(text))).otherwise(F.xxhash64(F.col(doc_id)))
    lines = keyed.select(
        "__row", document.alias("__document"), F.explode(_line_keys(min_chars)(F.col(text))).alias("k")
    ).select("__row", "__document", "k.a", "k.b")
    # Keys of enough rows; documents are counted for these alone.
    often = lines.groupBy("a", "b").count().filter(F.col("count") >= min_docs).select("a", "b")
    # Written first: a join splits a hot key only between two plain exchanges.
    often = staged(often, "lines")
    hits = staged(lines.join(often, ["a", "b"]), "lines")
    documents = hits.select("a", "b", "__document").distinct().groupBy("a", "b").count()
    frequent = staged(documents.filter(F.col("count") >= min_docs).select("a", "b"), "lines")
    own = hits.join(frequent, ["a", "b"]).groupBy("__row").agg(
        F.collect_set(F.struct("a", "b")).alias("__hot")
    )
    joined = keyed.join(own, "__row", "left").withColumn(
        "__kept", _without(min_chars)(F.col(text), F.col("__hot"))
    )
    columns = [F.col("__kept.text").alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, "__kept.n_lines", "__kept.n_dropped")
