"""Token ids as compressed binary blocks in ascending order of documents.

Documents are sorted by id with a range exchange, tokenized once and staged as blocks of whole
documents. Token ids are counted over all blocks; the counts, as many as the vocabulary has
entries, become the one frequency table that all blocks share. Then each block is encoded by
``rans`` into a table of (part, seq, first, doc_ids, lengths, block). A reader decodes blocks
independently.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import rans
from wayfare.llm.common import kept_by_worker, parallelism, staged
from wayfare.llm.units import PLAIN, Known, gathered, slices_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
_SLICE = 12_000_000
_CACHED = 1_200_000
# Units in one text for the library.
_JOINED = 512


class Encoder:
    """The tokenizers library with a bounded cache of the ids of units, kept by each worker.

    Its defaults hold: the literal of an added token, such as <|endoftext|>, is that token's id. No
    such literal holds a blank, so none is cut in two.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Known(_CACHED)
        # Bytes of each id: of a byte-level vocabulary a character stands for a byte.
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()} | added
        self.size = np.zeros(max(size) + 1, np.int64)
        self.size[list(size)] = list(size.values())

    def _one_by_one(self, some: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def _joined(self, some: pa.Array) -> list[bytes]:
        """Ids of units that begin with one space and end without a blank, from one text of all of them.

        No piece of the pattern crosses such a border, so the ids are those of the units one by one; where each
        unit's end is told by the bytes that ids stand for.
        """
        begin = pa.array([*range(0, len(some), _JOINED), len(some)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(begin, some), "").to_pylist()
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, "<u4") for c in coded])
        reached = np.cumsum(self.size[ids])
        wanted = np.cumsum(pc.binary_length(some).to_numpy(), dtype=np.int64)
        ends = np.searchsorted(reached, wanted) + 1
        if ends[-1] != len(ids) or (reached[ends - 1] != wanted).any():
            return self._one_by_one(some.to_pylist())  # no byte-level vocabulary
        data, ends = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _new(self, some: list[str]) -> list[bytes]:
        out: list = [b""] * len(some)
        units = pa.array(some, pa.string())
        plain = pc.match_substring_regex(units, PLAIN).to_numpy(zero_copy_only=False)
        for joined in (True, False):
            own = np.flatnonzero(plain == joined)
            for a in range(0, len(own), 16_384):
                some_of = units.take(own[a : a + 16_384])
                codes = self._joined(some_of) if joined else self._one_by_one(some_of.to_pylist())
                for i, code in zip(own[a : a + 16_384].tolist(), codes, strict=True):
                    out[i] = code
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where those of each text begin and the last ends)."""
        return self.cache.coded(texts, self._new)


def encoder(path: str) -> Encoder:
    return kept_by_worker(("tokenizers", path), lambda: Encoder(path))


def _count(blocks: DataFrame) -> DataFrame:
    """(id, count) over all ids of staged blocks."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = np.bincount(_unpack(data))
                total.resize(max(len(total), len(found)), refcheck=False)
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "count"])

    counted = blocks.select("ids").mapInArrow(count, "id long, count long")
    return counted.groupBy("id").agg(F.sum("count").alias("count"))


def _pack(ids: np.ndarray) -> bytes:
    """Compressed: the low halves of the ids, then the high halves, mostly zeros."""
    return zstandard.ZstdCompressor(level=1).compress(
        (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()
    )


def _unpack(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u2").reshape(2, -1)
    return low.astype(np.int64) | (high.astype(np.int64) << 16)


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int | None = END_ID,
    block_ids: int = 1 << 19,
    scale_bits: int = 20,
) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``/blocks and their table to ``path``/table.

    Documents stand in ascending order of doc_id (nulls first), equal ids in order of their texts'
    hash; each row is a document of its own. Null and empty texts have the end id alone. Blocks hold
    whole documents and end when they have ``block_ids`` ids, so one very long document is one block.
    ``end_id`` None appends nothing. An empty table writes no block.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def tokenize(batches):
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        held, ids, size, seq, first = [], [], 0, 0, 0

        def block():
            lengths = [len(x) for x in held]
            row = [[part], [seq], [first], [ids], [lengths], [_pack(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        names = ["part", "seq", "first", "doc_ids", "lengths", "ids"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        # Known units are indexed for each slice: short texts come in many small batches.
        for batch in gathered(batches, 1, _SLICE):
            texts = batch.column(1).fill_null("")
            keys = batch.column(0).to_pylist()
            for a, b in slices_of(texts, _SLICE):
                coded, begin = encode(texts.slice(a, b - a))
                for i, key in enumerate(keys[a:b]):
                    held.append(np.concatenate([coded[begin[i] : begin[i + 1]], end]))
                    ids.append(key)
                    size += len(held[-1])
                    if size >= block_ids:
                        yield block()
                        held, ids, seq, first, size = [], [], seq + 1, first + size, 0
        if held:
            yield block()

    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    rest = "part int, seq long, first long, doc_ids array<long>, lengths array<long>"
    plain = staged(ranged.mapInArrow(tokenize, f"{rest}, ids binary"), "ids")
    # As many rows as the vocabulary has ids, however large the corpus.
    counts = _count(plain).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    dense[counts["id"].to_numpy()] = counts["count"].to_numpy()
    table = rans.Table.fit(dense, scale_bits)
    spark.createDataFrame(
        [(scale_bits, table.freqs.astype("<u4").tobytes())], "scale_bits int, freqs binary"
    ).write.parquet(f"{path}/table")
    sent = spark.sparkContext.broadcast(table)

    def compress(batches):
        model = sent.value
        for batch in batches:
            data = [rans.encode(_unpack(x), model) for x in batch["ids"].to_pylist()]
            names = batch.schema.names[:-1]
            columns = [batch[n] for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], [*names, "block"])

    plain.mapInArrow(compress, f"{rest}, block binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``ids`` is little-endian uint32.

    ``start`` is the number of ids of all documents before it. The driver holds one sum per part.
    """
    stored = spark.read.parquet(f"{path}/table").first()
    table = rans.Table(np.frombuffer(stored["freqs"], "<u4").astype(np.int64), stored["scale_bits"])
    coded = spark.read.parquet(f"{path}/blocks")
    n_ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = coded.groupBy("part").agg(F.sum(n_ids).alias("n")).collect()
    before, offset = {}, 0
    for row in sorted(sums, key=lambda r: r["part"]):
        before[row["part"]], offset = offset, offset + row["n"]
    sent = spark.sparkContext.broadcast((table, before))

    def documents(batches):
        model, offsets = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                data = rans.decode(row["block"], model).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"] + offsets[row["part"]]),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([data[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return coded.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
