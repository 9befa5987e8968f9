"""Substring dedup on a sparse de Bruijn graph of words.

Edges are windows of 20 words. Among the 15 runs of six words in a window the one with the least
hash is the window's anchor; consecutive windows with the same anchor form a nonbranching stretch,
a local path. Equal windows have equal anchors, so only anchors that occur twice matter, and only
one row per anchor, not per window, is shuffled to find them.

Paths of equal words are compacted to their first occurrence by a join. Windows are compared one by
one only within these first occurrences, where paths branch into each other. Matches that run
in parallel in a document and in its source are merged into long spans, and each span is verified: the
words at the target's and at the source's coordinates must have the same 128-bit digest.

Texts travel compressed. Sums and least positions are pre-aggregated, and the tables they are
joined with are written first, so every join with a hot key is one that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import staged
from wayfare.llm.units import slices
from wayfare.llm.wordhash import hashed, runs, whole_runs, words_of

WINDOW, ANCHOR = 20, 6
_SLICE = 1_500_000
_KEYS = ["d", "th"]
_SPAN = "struct<start:int,n:int,sd:bigint,sth:bigint,sstart:int>"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each ``width`` consecutive ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = best[:-size], best[size:]
        best, size = np.where(values[a] <= values[b], a, b), 2 * size
    a, b = best[:n], best[width - size : width - size + n]
    return np.where(values[a] <= values[b], a, b)


def _windows(words: list[list[bytes]], window: int):
    """(hashes of words, first word of each list, window places, list of each, anchor of each)."""
    anchor = min(ANCHOR, window)
    hashes, counts = hashed(words)
    places, owner = whole_runs(counts, window)
    small = runs(hashes, anchor)
    return hashes, np.cumsum(counts) - counts, places, owner, small, _least(small, window - anchor + 1)[places]


def _unpack(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode("utf-8") if z else ""


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by z, its compressed form."""

    def pack(texts: pa.Array) -> pa.Array:
        tool = zstandard.ZstdCompressor(level=1)
        return pa.array([tool.compress((t or "").encode("utf-8")) for t in texts.to_pylist()], pa.binary())

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.arrow_udf(pack, "binary")("text").alias("z"))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(d, th, h, i) of every anchor: its hash and the word it starts at."""

    def find(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in slices(texts, _SLICE):
                words = [words_of(t, False) for t in texts[lo:hi]]
                _, first, _, owner, small, anchor = _windows(words, window)
                new = np.flatnonzero(np.diff(anchor, prepend=-1))
                own = owner[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[lo:hi][own]),
                        pa.array(th[lo:hi][own]),
                        pa.array(small[anchor[new]].view(np.int64)),
                        pa.array((anchor[new] - first[own]).astype(np.int32)),
                    ],
                    ["d", "th", "h", "i"],
                )

    return docs.select("d", "th", "text").mapInArrow(find, "d long, th long, h long, i int")


def _marked_windows(batch, window: int):
    """Per slice of rows (d, th, z, marks): hashes, starts and windows whose anchor is marked."""
    texts = [_unpack(z) for z in batch.column(2).to_pylist()]
    marks = batch.column(3).to_pylist()
    for lo, hi in slices(texts, _SLICE):
        words = [words_of(t, False) for t in texts[lo:hi]]
        hashes, first, places, owner, _, anchor = _windows(words, window)
        marked = np.zeros(len(hashes) + 1, bool)
        for i, m in enumerate(marks[lo:hi]):
            marked[first[i] + np.array(m, np.int64)] = True
        keep = marked[anchor] if len(anchor) else np.zeros(0, bool)
        yield lo, hi, hashes, first, places[keep], owner[keep], anchor[keep]


def _paths(rows: DataFrame, window: int) -> DataFrame:
    """(d, th, h, start, n): stretches of n windows from word ``start`` that share a marked anchor."""

    def find(batches):
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, hashes, first, places, owner, anchor in _marked_windows(batch, window):
                cut = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(owner, prepend=-1))
                n = np.diff(np.append(cut, len(anchor)))
                h = np.zeros(len(cut), np.uint64)
                for size in np.unique(n):
                    some = n == size
                    h[some] = runs(hashes, int(size) + window - 1)[places[cut[some]]]
                own = owner[cut]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[lo:hi][own]),
                        pa.array(th[lo:hi][own]),
                        pa.array(h.view(np.int64)),
                        pa.array((places[cut] - first[own]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["d", "th", "h", "start", "n"],
                )

    return rows.mapInArrow(find, "d long, th long, h long, start int, n int")


def _open_windows(rows: DataFrame, window: int) -> DataFrame:
    """(d, th, h, start) of the windows of rows (d, th, z, open), open: array of (start, n)."""

    def find(batches):
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [_unpack(z) for z in batch.column(2).to_pylist()]
            opened = batch.column(3)
            for lo, hi in slices(texts, _SLICE):
                hashes, counts = hashed([words_of(t, False) for t in texts[lo:hi]])
                first = np.cumsum(counts) - counts
                here = opened.slice(lo, hi - lo)
                flat, spans = here.flatten(), here.value_lengths().to_numpy()
                start, size = (flat.field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
                own = np.repeat(np.repeat(np.arange(hi - lo), spans), size)
                offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(start, size) + offset
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[lo:hi][own]),
                        pa.array(th[lo:hi][own]),
                        pa.array(runs(hashes, window)[first[own] + at].view(np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["d", "th", "h", "start"],
                )

    return rows.mapInArrow(find, "d long, th long, h long, start int")


def _against_first(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the first occurrence (sd, sth, sstart) of their hash where it occurs twice."""
    where = F.min(F.struct("d", "th", "start")).alias("f")
    firsts = rows.groupBy("h").agg(where, F.count(F.lit(1)).alias("times")).filter("times > 1")
    firsts = firsts.select("h", F.col("f.d").alias("sd"), F.col("f.th").alias("sth"), F.col("f.start").alias("sstart"))
    return rows.join(staged(firsts, name), "h", "left")


_LATER = "sd is not null and (d, th, start) != (sd, sth, sstart)"


def _merged(spans: pa.Array) -> pa.Array:
    """Spans of a row that run on in target and source alike become one."""
    names = ["start", "n", "sd", "sth", "sstart"]
    flat = spans.flatten()
    start, n, sd, sth, sstart = (flat.field(k).to_numpy().astype(np.int64) for k in names)
    lengths = spans.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(len(spans)), lengths)
    order = np.lexsort((start, start - sstart, sth, sd, owner))
    start, n, sd, sth, sstart, owner = (x[order] for x in (start, n, sd, sth, sstart, owner))
    parallel = np.zeros(len(start), bool)
    for x in (owner, sd, sth, start - sstart):
        parallel[1:] |= x[1:] != x[:-1]
    # The furthest end so far within rows of one source and offset: groups are lifted apart.
    lift = np.cumsum(parallel) << 40
    reach = np.maximum.accumulate(lift + start + n)
    new = np.ones(len(start), bool)
    new[1:] = lift[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    length = (reach - lift)[last] - start[first]
    columns = [start[first], length, sd[first], sth[first], sstart[first]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    made = pa.StructArray.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)
    counts = np.bincount(owner[first], minlength=len(spans)) if len(first) else np.zeros(len(spans), int)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), made)


def _digests(rows: DataFrame, window: int) -> DataFrame:
    """(d, th, start, n, a, b) of rows (d, th, z, spans): the digest of the words of each span."""

    def find(batches):
        for batch in batches:
            out = []
            for d, th, z, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(_unpack(z), False)
                for s in spans:
                    words_here = words[s["start"] : s["start"] + s["n"] + window - 1]
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words_here)), ">i8").tolist()
                    out.append({"d": d, "th": th, "start": s["start"], "n": s["n"], "a": a, "b": b})
            yield pa.RecordBatch.from_pylist(out, schema)

    long, small = pa.int64(), pa.int32()
    schema = pa.schema([("d", long), ("th", long), ("start", small), ("n", small), ("a", long), ("b", long)])
    return rows.mapInArrow(find, "d long, th long, start int, n int, a long, b long")


def _without(window: int):
    kind = T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )

    def cut(z: pa.Array, copy: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for data, same, own in zip(z.to_pylist(), copy.to_pylist(), spans.to_pylist(), strict=True):
            words = words_of(_unpack(data), False)
            keep = np.ones(len(words), bool)
            if same and len(words) >= window:
                keep[:] = False
            for s in own or []:
                keep[s["start"] : s["start"] + s["n"] + window - 1] = False
            left = b" ".join(words) if keep.all() else b" ".join(words[i] for i in np.flatnonzero(keep))
            out.append({"text": left.decode("utf-8"), "n_words": len(words), "n_removed": int((~keep).sum())})
        fields = [("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
        return pa.array(out, pa.struct(fields))

    return F.arrow_udf(cut, kind)


def drop_repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeat of ``window`` words removed from ``text``, n_words and n_removed.

    Words are runs of anything but space and tab to carriage return, compared unchanged. A word is
    removed if a window that covers it has an equal window that starts earlier: in a smaller
    doc_id, or in the same document before it. All windows are judged on the input. The words kept
    are joined by one space. Null and empty texts have no words and give ''. A null doc_id counts as smaller
    than any number. Different texts under one doc_id are ordered by a hash of the text; equal rows
    (same id, same text) are one document and each get its result. Other columns pass unchanged;
    columns already named n_words or n_removed are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_words", "n_removed")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    several = docs.groupBy(key.alias("d")).count().filter("count > 1")
    # Unique ids, the usual case, need no second part of the key; a constant costs nothing to move.
    tie = F.lit(0).cast("long") if several.isEmpty() else F.xxhash64("text")
    # Names of other columns step aside, so that they clash with none of those used here.
    aside = {c: f"given_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    keyed = docs.withColumnsRenamed(aside).withColumns({"d": key, "th": tie})
    texts = keyed.select("d", "th", "text")

    # Copies of a whole text are settled by the text's digest.
    digest = keyed.select("d", "th", F.md5("text").alias("m")).filter("m is not null")
    groups = digest.groupBy("m").agg(F.min(F.struct("d", "th")).alias("f"), F.count(F.lit(1)).alias("times"))
    groups = staged(groups.filter("times > 1").select("m", "f"), "copies")
    copies = digest.join(groups, "m").filter("(d, th) != (f.d, f.th)").select("d", "th").distinct()
    copies = staged(copies.withColumn("copy", F.lit(True)), "copies")

    anchors = staged(_anchors(texts, window), "places")
    twice = staged(anchors.groupBy("h").count().filter("count > 1").select("h"), "anchors")
    marks = anchors.join(twice, "h").groupBy(*_KEYS).agg(F.collect_set("i").alias("marks"))
    marks = staged(marks.join(copies, _KEYS, "left_anti"), "marks")

    packed = _packed(texts)
    paths = staged(_paths(packed.join(marks, _KEYS).select("d", "th", "z", "marks"), window), "paths")
    placed = staged(_against_first(paths, "firsts"), "placed")
    later = placed.filter(_LATER).select("d", "th", "start", "n", "sd", "sth", "sstart")
    opened = placed.filter(f"not coalesce({_LATER}, false)").groupBy(*_KEYS)
    opened = opened.agg(F.collect_set(F.struct("start", "n")).alias("open"))

    windows = _open_windows(packed.join(opened, _KEYS).select("d", "th", "z", "open"), window)
    windows = staged(windows, "windows")
    more = _against_first(windows, "firsts").filter(_LATER)
    more = more.select("d", "th", "start", F.lit(1).alias("n"), "sd", "sth", "sstart")
    spans = later.unionByName(more).groupBy(*_KEYS)
    spans = spans.agg(F.collect_list(F.struct("start", "n", "sd", "sth", "sstart")).alias("s"))
    spans = staged(spans.select("d", "th", F.arrow_udf(_merged, f"array<{_SPAN}>")("s").alias("spans")), "spans")

    # The words at both coordinates of each span.
    each = spans.select("d", "th", F.explode("spans").alias("s")).select("d", "th", "s.*")
    source = each.select(F.col("sd").alias("d"), F.col("sth").alias("th"), F.col("sstart").alias("start"), "n")
    target = each.select("d", "th", "start", "n")
    asked = source.unionByName(target).groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    read = _digests(packed.join(asked, _KEYS).select("d", "th", "z", "spans"), window).distinct()
    read = staged(read, "digests")
    there = read.select(
        F.col("d").alias("sd"), F.col("th").alias("sth"), F.col("start").alias("sstart"), "n", "a", "b"
    )
    checked = each.join(read, ["d", "th", "start", "n"]).join(there, ["sd", "sth", "sstart", "n", "a", "b"])
    checked = checked.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    whole = _packed(keyed).join(copies, _KEYS, "left").join(checked, _KEYS, "left")
    whole = whole.withColumn("kept", _without(window)("z", "copy", "spans"))
    columns = [F.col("kept.text") if c == "text" else F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return whole.select(*columns, "kept.n_words", "kept.n_removed")
