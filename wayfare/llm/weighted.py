"""Near-duplicate texts: improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

A text is a bag of shingles of five words; a shingle weighs its count times its idf. Documents are
counted for each whole shingle hash: texts are staged in chunks, each chunk asks for its distinct
shingles in parts of the hash range, each part sums over all chunks, and answers with one byte for
each shingle asked for: its count of documents, rounded down to an eighth of a doubling. So a count covers
the whole corpus however large, a shingle travels once, as a packed difference, and no task
holds more than its part. The idf runs from 1 to 1.5 only: the shingles of a large group of near copies
are frequent for that very reason, and a steeper idf would tear such a group apart. A sample of a bag
depends on the weights alone, and two bags share it with the probability of their weighted Jaccard
similarity. Samples are joined to bands; texts that share a band are compared exactly, from whole
texts, which only those texts are read again for.

Equal texts are folded first. In a bucket every text is compared with the first one, which connects a
crowd of copies with one comparison each. Texts of a bucket that are still in different classes
are compared with each other in blocks, inside tasks that return connecting links alone, so no link between
them is lost and no pairs are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import kept_by_worker, parallelism, staged
from wayfare.llm.components import components
from wayfare.llm.units import slices
from wayfare.llm.wordhash import hashed, mixed, runs, whole_runs, words_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
SEED = 20_101
# Steps of the document count in each doubling.
LEVELS = 8
# Bytes of text whose shingles one task counts.
_PART_BYTES = 8 << 20
_SLICE = 800_000
_HASH_BITS = np.uint64(52)
_DOC_BITS = 12
_DOCS = 1 << _DOC_BITS


def _bags(words: list[list[bytes]]):
    """(hash, count, list) of the distinct shingles of each list, in ascending order of list.

    A list of one to four words is one shingle. Hashes have 52 bits, which leaves room for the number of
    the list, so that one sort finds the distinct ones. At most ``_DOCS`` lists.
    """
    hashes, counts = hashed(words)
    places, owner = whole_runs(counts, WORDS)
    found = runs(hashes, WORDS)
    found = found[places] if len(places) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        few = [xxhash.xxh3_64_intdigest(b"\0".join(words[i])) for i in short]
        found = np.concatenate([found, np.array(few, np.uint64)])
        owner = np.concatenate([owner, short])
    keyed = (owner.astype(np.uint64) << _HASH_BITS) | (found >> (np.uint64(64) - _HASH_BITS))
    keyed.sort()
    first = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keyed)))
    keyed = keyed[first]
    return keyed & np.uint64((1 << 52) - 1), times, (keyed >> _HASH_BITS).astype(np.int64)


def _parts(shingles: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` stretches of the hash range each shingle lies in, for up to 2^31 of them."""
    return ((shingles >> (_HASH_BITS - np.uint64(32))) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs_of_docs(texts: list[str], most: int):
    """Slices of at most ``_DOCS`` texts and about ``most`` characters."""
    for a, b in slices(texts, most):
        for c in range(a, b, _DOCS):
            yield c, min(b, c + _DOCS)


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, texts): the rows of ``docs`` in runs of at most ``_DOCS``, null texts as ''."""

    def cut(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs_of_docs(texts, _SLICE):
                row = [[(part << 28) | seq], [ids[a:b]], [texts[a:b]]]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, types)], ["chunk", "ids", "texts"]
                )
                seq += 1

    schema = "chunk long, ids array<long>, texts array<string>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as packed differences: all first bytes, then all second ones, and so on."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(flat.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def levels_of(documents: np.ndarray) -> np.ndarray:
    """Counts of documents rounded down to an eighth of a doubling, as one byte."""
    return np.floor(LEVELS * np.log2(documents)).astype(np.uint8)


def document_levels(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, levels): how many of all documents have each shingle of the chunk.

    ``levels`` follows the ascending distinct shingles of the chunk in that part of the hash range.
    """

    def ask(batches):
        for batch in batches:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles, _, _ = _bags([words_of(t, True) for t in texts])
                found, docs = np.unique(shingles, return_counts=True)
                cuts = np.searchsorted(_parts(found, parts), np.arange(parts + 1))
                used = np.flatnonzero(cuts[1:] > cuts[:-1])
                pack = zstandard.ZstdCompressor(level=1).compress
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), chunk, np.int64)),
                        pa.array([_packed(found[cuts[p] : cuts[p + 1]]) for p in used], pa.binary()),
                        pa.array([pack(docs[cuts[p] : cuts[p + 1]].astype("<u2").tobytes()) for p in used], pa.binary()),
                    ],
                    ["part", "chunk", "shingles", "docs"],
                )

    def answer(batches):
        parts_asked, asked, sizes, shingles, docs = [], [], [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts_asked += batch.column(0).to_pylist()
            asked += batch.column(1).to_pylist()
            for data, n in zip(batch.column(2), batch.column(3), strict=True):
                shingles.append(_unpacked(data.as_py()))
                docs.append(np.frombuffer(unpack(n.as_py()), "<u2"))
                sizes.append(len(docs[-1]))
        if not asked:
            return
        ends = np.cumsum(sizes)
        shingles, docs = np.concatenate(shingles), np.concatenate(docs)
        order = np.argsort(shingles)
        shingles = shingles[order]
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        del shingles
        total = levels_of(np.add.reduceat(docs[order], first, dtype=np.int64))
        levels = np.empty(len(order), np.uint8)
        levels[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        pack = zstandard.ZstdCompressor(level=1).compress
        for lo in range(0, len(asked), 1024):
            own = range(lo, min(lo + 1024, len(asked)))
            data = [pack(levels[ends[i] - sizes[i] : ends[i]].tobytes()) for i in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([asked[i] for i in own], pa.int64()),
                    pa.array([parts_asked[i] for i in own], pa.int32()),
                    pa.array(data, pa.binary()),
                ],
                ["chunk", "part", "levels"],
            )

    wanted = chunks.select("chunk", "texts").mapInArrow(ask, "part int, chunk long, shingles binary, docs binary")
    return wanted.repartitionById(parts, "part").mapInArrow(answer, "chunk long, part int, levels binary")


def idf_of(levels: np.ndarray, rows: int) -> np.ndarray:
    """1 + log((1 + rows) / (1 + d)) / (2 log(1 + rows)) for d = 2^(level / 8) of ``rows`` documents."""
    documents = np.minimum(2.0 ** (levels / LEVELS), rows)
    steep = np.log((1 + rows) / (1 + documents))
    return (1 + steep / (2 * np.log(max(2, 1 + rows)))).astype(np.float32)


def _variates():
    """Quantiles of the Gamma(2, 1) law by 16 random bits: as they are, and their logarithms."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(1e-6, 40, 2_000_000)
    gamma = np.interp(u, 1 - np.exp(-x) * (1 + x), x).astype(np.float32)
    return gamma, np.log(gamma)


def samples(shingles, weights, owner, n: int, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each of ``n`` bags, 0 for an empty bag."""
    out = np.zeros((n, count), np.uint64)
    if not len(shingles):
        return out
    gamma, log_gamma = kept_by_worker(("gamma",), _variates)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    bags, sizes = owner[first], np.diff(np.append(first, len(owner)))
    log_weight, low = np.log(weights).astype(np.float32), np.uint64(0xFFFF)
    for k in range(count):
        bits = mixed(shingles + np.uint64((0x9E3779B97F4A7C15 * (k + SEED)) % (1 << 64)))
        r = gamma[bits & low]
        shift = (bits >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_weight / r + shift)
        rank = log_gamma[(bits >> np.uint64(16)) & low] - r * (t - shift + 1)
        hit = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, first), sizes))
        hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
        out[bags, k] = mixed(shingles[hit] * np.uint64(31) + t[hit].astype(np.int64).astype(np.uint64) + np.uint64(k + 1))
    return out


def signatures(chunks: DataFrame, levels: DataFrame, rows: int) -> DataFrame:
    """(row, id, a, b, n, weight, bands, levels), a row for each of ``chunks``' texts.

    row is a number of its own; a and b are a 128-bit hash of the words, n the words, weight the sum of
    weights; levels has one byte for each of the text's shingles, in ascending order of their hashes.
    """
    per = BANDS * ROWS

    def sign(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        counted = counted.sort_by("part")
        known = b"".join(unpack(x) for x in counted["levels"].to_pylist())
        known = np.frombuffer(known, np.uint8)
        (number,), (ids,), (texts,) = (chunk[c].to_pylist() for c in ("chunk", "ids", "texts"))
        words = [words_of(t, True) for t in texts]
        shingles, times, owner = _bags(words)
        own = known[np.unique(shingles, return_inverse=True)[1]]
        weights = times * idf_of(np.arange(256), rows)[own]
        drawn = samples(shingles, weights, owner, len(ids), per)
        bands = np.zeros((len(ids), BANDS), np.uint64)
        for r in range(ROWS):
            bands = mixed(bands * np.uint64(31) + drawn[:, r::ROWS] + np.uint64(r + 1))
        digest = b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words)
        a, b = np.frombuffer(digest, ">i8").reshape(-1, 2).astype(np.int64).T
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS)
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
        columns = {
            "row": pa.array((number << _DOC_BITS) + np.arange(len(ids))),
            "id": pa.array(ids, pa.int64()),
            "a": pa.array(a),
            "b": pa.array(b),
            "n": pa.array([len(w) for w in words], pa.int64()),
            "weight": pa.array(np.bincount(owner, weights, len(ids)).astype(float)),
            "bands": pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())),
            "levels": pa.array([own[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
        }
        return pa.table(columns)

    schema = "row long, id long, a long, b long, n long, weight double, bands array<long>, levels binary"
    return chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(sign, schema)


def similarity(x, y) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, weights)."""
    (a, u), (b, v) = x, y
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = float(np.minimum(u[i], v[j]).sum())
    total = float(u.sum()) + float(v.sum()) - shared
    return shared / total if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, rows: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts have at least the similarity; ``texts`` is (id, weight, text, levels).

    Weights that differ by more than the threshold allows rule a pair out before its texts are joined.
    """
    size = texts.select("id", "weight")
    fit = pairs.join(size.withColumnsRenamed({"id": "a", "weight": "u"}), "a")
    fit = fit.join(size.withColumnsRenamed({"id": "b", "weight": "v"}), "b")
    fit = fit.filter(F.least("u", "v") >= (threshold - 1e-3) * F.greatest("u", "v")).select("a", "b")
    own = texts.select("id", F.struct("text", "levels").alias("own"))
    left = own.select(F.col("id").alias("a"), F.col("own").alias("left"))
    right = own.select(F.col("id").alias("b"), F.col("own").alias("right"))

    def check(batches):
        kept = {}
        idf = idf_of(np.arange(256), rows).astype(float)

        def bag(key, own):
            if key not in kept:
                if len(kept) > 64:
                    kept.clear()
                shingles, times, _ = _bags([words_of(own["text"], True)])
                kept[key] = shingles, times * idf[np.frombuffer(own["levels"], np.uint8)]
            return kept[key]

        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                a, b, t, u = (some.column(i).to_pylist() for i in range(4))
                ok += [
                    similarity(bag(i, x), bag(j, y)) >= threshold for i, j, x, y in zip(a, b, t, u, strict=True)
                ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = fit.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(check, "a long, b long")


def _linked(bags: list, sets: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Pairs of places (i, j) that connect what is still apart: i of ``left`` and j of ``right`` are compared
    unless links known or found so far connect them. ``sets`` holds the class of each place.

    One bag is spread over the shingles of all, and held against all bags at once.
    """
    sizes = np.array([len(s) for s, _ in bags])
    names, place = np.unique(np.concatenate([s for s, _ in bags]), return_inverse=True)
    weight = np.concatenate([w for _, w in bags])
    begin = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weight, begin)
    sets = np.unique(sets, return_inverse=True)[1]
    spread, found = np.zeros(len(names)), []
    for i in left.tolist():
        if (sets[right] == sets[i]).all():
            continue
        own = slice(begin[i], begin[i] + sizes[i])
        spread[place[own]] = weight[own]
        shared = np.add.reduceat(np.minimum(spread[place], weight), begin)
        spread[place[own]] = 0
        near = right[shared[right] >= threshold * (total[right] + total[i] - shared[right])]
        for j in near.tolist():
            if sets[j] != sets[i]:
                found.append((i, j))
                sets[sets == sets[j]] = sets[i]
    return found


def open_links(
    buckets: DataFrame, classes: DataFrame, texts: DataFrame, rows: int, threshold: float,
    block: int = 1024, block_words: int = 400_000,
) -> DataFrame:
    """(a, b): links between texts of a bucket (band, value, id) that ``classes`` leaves apart.

    Large buckets are cut into blocks of about so many texts and words; every two blocks meet in one group,
    where all texts of different classes are compared exactly. A group returns the links that connect
    its classes, at most one for each of its texts, and never its pairs.
    """
    known = buckets.select("band", "value", "id").join(classes, "id", "left")
    known = known.withColumn("class", F.coalesce("component", "id")).join(texts.select("id", "n"), "id")
    crowds = known.groupBy("band", "value").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("count"), F.sum("n").alias("words")
    )
    blocks = F.ceil(F.greatest(F.col("count") / block, F.col("words") / block_words)).cast("int")
    crowds = crowds.filter("lo < hi").select("band", "value", blocks.alias("blocks"))
    met = known.join(crowds, ["band", "value"])
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "value", "id", "class", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    met = met.join(texts.select("id", "text", "levels"), "id")

    def meet(group: pa.Table) -> pa.Table:
        ids, sets, own = (group[c].to_numpy() for c in ("id", "class", "own"))
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        idf, bags = idf_of(np.arange(256), rows).astype(float), []
        for text, levels in zip(group["text"], group["levels"], strict=True):
            shingles, times, _ = _bags([words_of(text.as_py(), True)])
            bags.append((shingles, times * idf[np.frombuffer(levels.as_py(), np.uint8)]))
        found = _linked(bags, sets, np.flatnonzero(own == x), np.flatnonzero(own == y), threshold)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    return met.groupBy("band", "value", "x", "y").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) of every row of ``docs`` (doc_id, text): classes of linked texts.

    Words are runs of anything but blanks, A-Z lower-cased; texts of one to four words are one
    shingle. Texts of equal words are linked; others if their weighted Jaccard similarity is at
    least ``threshold`` and they share a band (a chance of 99.7 % at 0.8, more above). class_id is
    the smallest doc_id that links reach, kept is true where it is the row's own.
    Texts without words, null texts included, link with nothing. Rows that share an id are one
    document with several texts. A null id has a null class and is kept. Ties need no rule: links have
    no order. An empty table gives an empty table. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = staged(_chunks(docs), "chunks")
    size = F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t)))
    rows, size = chunks.agg(F.sum(F.size("ids")), size).first()
    rows, parts = rows or 0, max(parallelism(spark), (size or 0) // _PART_BYTES)
    signed = staged(signatures(chunks, document_levels(chunks, parts), rows), "signatures")
    worded = signed.filter("n > 0 and id is not null")
    folded = worded.groupBy("a", "b").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    folded = staged(folded, "folded")
    bands = folded.select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "value"))
    crowds = bands.groupBy("band", "value").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    shared = bands.join(crowds.filter("n > 1").select("band", "value", "head"), ["band", "value"])
    shared = staged(shared, "bands")
    # Texts that share a band with another are read once more; the rest never moves.
    members = shared.select("id").distinct()
    number = F.shiftleft("chunk", _DOC_BITS) + F.col("pos")
    texts = chunks.select("chunk", F.posexplode("texts").alias("pos", "text")).select(number.alias("id"), "text")
    known = signed.select(F.col("row").alias("id"), "n", "weight", "levels").join(members, "id", "left_semi")
    texts = staged(known.join(texts, "id"), "texts")
    stars = shared.filter("id > head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    tried = staged(stars.distinct(), "stars")
    links = staged(verified(tried, texts, rows, threshold), "links")
    linked = components(links)
    # Then all texts of a bucket that are still apart.
    rest = staged(open_links(shared, linked, texts, rows, threshold), "open")
    if not rest.isEmpty():
        linked = components(links.unionByName(rest))
    # From each id to the row that stands for its words, to the class of that row, to its least id.
    copies = worded.select("id", "a", "b").join(folded.select("a", "b", "row"), ["a", "b"])
    copies = copies.join(linked.withColumnRenamed("id", "row"), "row", "left")
    copies = copies.select("id", F.coalesce("component", "row").alias("component"), "a", "b")
    least = copies.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = copies.join(least, "component").select("id", "class_id").distinct()
    several = worded.groupBy("id").agg(F.count_distinct("a", "b").alias("texts")).filter("texts > 1")
    if not several.isEmpty():
        tied = classes.select(F.col("id").alias("a"), F.col("class_id").alias("b"))
        classes = components(staged(tied, "links")).withColumnRenamed("component", "class_id")
    placed = docs.select("doc_id").join(classes, F.col("doc_id") == F.col("id"), "left")
    own = F.coalesce("class_id", "doc_id")
    return placed.select("doc_id", own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
