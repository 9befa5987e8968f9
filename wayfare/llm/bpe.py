"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

Texts are cut into matches of the pattern. Rows (word, pos, token) of the distinct words that a
worker has not met before join the merge table; in every round of a recursive query each word
contracts its leftmost pair of least rank, and a word without a pair leaves. The ids of a text are
those of its words in order. Ordered aggregation of the tokens' bytes decodes them.

A word longer than ``LONG`` bytes is cut into stretches, which the same query encodes. Where two
stretches meet, the last tokens of one and the first of the other are encoded again together:
if the tokens at both ends of that window come out as they were, what lies beyond them is not touched by the
seam, and the window's tokens replace them. Else the two stretches become one. So a word without
repetition takes time in proportion to its length, and a repetitive one, whose stretches do
merge, falls in few rounds because all occurrences of its pair are contracted in one, where this
provably changes nothing.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import kept_by_worker
from wayfare.llm.units import Recent, slices, slices_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = 48
# Tokens on each side of a seam that are encoded again.
_WINDOW = 6
_SLICE = 2_000_000
_CACHED = 200_000
# Bytes of words in one query, and ids decoded by one: they bound the memory of both.
_QUERY_BYTES = 250_000
_QUERY_IDS = 200_000

# One round contracts one pair of each word. A round's rows are lists of tokens; the shortest is the last.
_SINGLE = """
with recursive step(word, t) as (
  select word, list(token order by pos) from symbols group by word
  union all
  (with pairs as (
    select word, unnest(t[:-2]) as l, unnest(t[2:]) as r, unnest(range(1, len(t))) as i from step where len(t) > 1
  ), best as (
    select word, min((m.rank::bigint << 32) | i) as place
    from pairs join merges m using (l, r) group by word
  )
  select word, t[:(place & 4294967295) - 1] || [(place >> 32)::integer] || t[(place & 4294967295) + 2:]
  from step join best using (word))
)
select word, arg_min(t, len(t)) as ids from step group by word
"""

# One round contracts all occurrences of the pair, left to right without overlap, if the pair is
# safe: then no new pair can have a lower rank, and the leftmost pair would stay the same one.
_MANY = """
with recursive step as (
  select word, pos, token, false as done from symbols
  union all
  (with paired as (
    select word, pos, token,
      lead(token) over (partition by word order by pos) as next from step where not done
  ), ranked as (
    select p.word, p.pos, p.token, m.rank, m.safe
    from paired p left join merges m on m.l = p.token and m.r = p.next
  ), best as (
    select *, min(rank) over (partition by word) as least,
      row_number() over (partition by word order by pos) as n from ranked
  ), hit as (
    select *, rank is not null and rank = least as hits from best
  ), runs as (
    select *, row_number() over (partition by word, hits order by pos) as h from hit
  ), taken as (
    select *, hits and case when safe
      then row_number() over (partition by word, hits, n - h order by pos) % 2 = 1
      else h = 1 end as merged from runs
  ), behind as (
    select *, lag(merged, 1, false) over (partition by word order by pos) as gone from taken
  )
  select word, pos, case when merged then rank else token end as token, least is null as done
  from behind where not gone)
)
select word, list(token order by pos) as ids from step where done group by word
"""

_DECODE = """
select doc, list(bytes order by place) as pieces
from places join vocabulary using (id) group by doc order by doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """The ranks as DuckDB tables of one worker, and a bounded cache of the ids of units."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        # No spill folder: a query beyond the limit fails loudly instead of filling a local disk.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        early, pairs = set(), []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
                    # A part that came later than the whole could make a lower pair when it appears.
                    early.update(r for r in (left, right) if r > rank)
        left, right, rank = (np.array(c, np.int32) for c in zip(*pairs, strict=True))
        safe = ~np.isin(rank, np.fromiter(early, np.int32, len(early)))
        merges = pa.table({"l": left, "r": right, "rank": rank, "safe": pa.array(safe)})
        vocabulary = pa.table(
            {
                "id": pa.array(self.ranks.values(), pa.int32()),
                "bytes": pa.array(self.ranks, pa.binary()),
            }
        )
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", rows)
            self.con.execute(f"create table {name} as select * from given")
            self.con.unregister("given")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.words, self.units = Recent(_CACHED), Recent(_CACHED)

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.con.unregister(name)

    def _run(self, sql: str, data: list[bytes]) -> list[bytes]:
        """Ids of each byte string by one of the recursive queries, as little-endian int32."""
        out, at = [], 0
        while at < len(data):
            end, size = at + 1, len(data[at])
            while end < len(data) and size + len(data[end]) <= _QUERY_BYTES:
                size += len(data[end])
                end += 1
            lengths = np.fromiter(map(len, data[at:end]), np.int64, end - at)
            joined = np.frombuffer(b"".join(data[at:end]), np.uint8)
            offset = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            symbols = pa.table(
                {
                    "word": np.repeat(np.arange(end - at, dtype=np.int32), lengths),
                    "pos": offset.astype(np.int32),
                    "token": self.byte_ids[joined],
                }
            )
            got = self._query(sql, symbols=symbols)
            lists = got["ids"].combine_chunks()
            flat = lists.flatten().to_numpy().astype("<i4").tobytes()
            ends = (np.cumsum(lists.value_lengths().to_numpy()) * 4).tolist()
            some = [b""] * (end - at)
            for word, a, b in zip(got["word"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
                some[word] = flat[a:b]
            out += some
            at = end
        return out

    def _short(self, data: list[bytes]) -> list[bytes]:
        """Ids of byte strings by the plain query, each distinct one once."""
        ranks = self.ranks
        known = {d: ranks[d].to_bytes(4, "little") if d in ranks else b"" for d in data}
        new = [d for d, ids in known.items() if not ids]
        known.update(zip(new, self._run(_SINGLE, new), strict=True))
        return [known[d] for d in data]

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words: stretches encoded one by one, then mended where they meet."""
        cut = [[w[i : i + LONG] for i in range(0, len(w), LONG)] for w in words]
        coded = iter(self._short([piece for own in cut for piece in own]))
        parts, width = [[next(coded) for _ in own] for own in cut], 4 * _WINDOW
        while any(len(own) > 1 for own in parts):
            # Every other seam at a time, so that no stretch is changed from both sides at once.
            seams = [(w, i) for w, own in enumerate(parts) for i in range(0, len(own) - 1, 2)]
            windows = [(parts[w][i][-width:], parts[w][i + 1][:width]) for w, i in seams]
            mended = self._short([self._bytes(left + right) for left, right in windows])
            whole = {}
            for (w, i), (left, right), new in zip(seams, windows, mended, strict=True):
                a, b = parts[w][i], parts[w][i + 1]
                # A window that reaches the end of the word needs no token there to hold on to.
                held_left = new[:4] == left[:4] if len(a) > len(left) else i == 0
                held_right = new[-4:] == right[-4:] if len(b) > len(right) else i + 2 == len(parts[w])
                if held_left and held_right:
                    whole[w, i] = a[: len(a) - len(left)] + new + b[len(right) :]
            rest = [s for s in seams if s not in whole]
            joined = [self._bytes(parts[w][i] + parts[w][i + 1]) for w, i in rest]
            # All occurrences of a pair at once: stretches that do not mend are mostly repetitive.
            whole.update(zip(rest, self._run(_MANY, joined), strict=True))
            for w, own in enumerate(parts):
                if len(own) > 1:
                    parts[w] = [whole.get((w, i), own[i]) for i in range(0, len(own), 2)]
        return [own[0] for own in parts]

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<i4").tolist()))

    def _contract(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian int32; a word that is a token needs no merging."""
        data = [word.encode("utf-8") for word in words]
        long = [d for d in data if len(d) > LONG and d not in self.ranks]
        if not long:
            return self._short(data)
        made = dict(zip(long, self._long(long), strict=True))
        short = [d for d in data if d not in made]
        made.update(zip(short, self._short(short), strict=True))
        return [made[d] for d in data]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text."""
        flat, begin = self.units.coded(texts, self._new)
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat.view(np.int32)))

    def _new(self, some: list[str]) -> list[bytes]:
        """Ids of units, each of which is cut into words."""
        return self.words.joined([self.split(unit) for unit in some], self._contract)

    def decode(self, lists: pa.Array) -> pa.Array:
        """Bytes of each list of ids; an empty or null list has none. Unknown ids raise."""
        lengths = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten().to_numpy().astype(np.int32)
        places = pa.table(
            {
                "doc": np.repeat(np.arange(len(lists), dtype=np.int32), lengths),
                "place": np.arange(len(flat), dtype=np.int32),
                "id": flat,
            }
        )
        got = self._query(_DECODE, places=places)
        pieces = got["pieces"].combine_chunks()
        if len(pieces.flatten()) != len(flat):
            raise ValueError("an id is not in the vocabulary")
        # The pieces of a document lie side by side: its bytes are one slice of their buffer.
        tokens = pieces.flatten().cast(pa.large_binary())
        at = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :]
        out = np.zeros(len(lists), np.int64)
        last = np.cumsum(pieces.value_lengths().to_numpy())
        own = at[last] - at[last - pieces.value_lengths().to_numpy()]
        out[got["doc"].to_numpy()] = own
        offsets = np.concatenate([[0], np.cumsum(out)]) + (at[0] if len(at) else 0)
        body = tokens.buffers()[2] or pa.py_buffer(b"")
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), body]
        )
        return made.cast(pa.binary())


def coder(path: str, pattern: str) -> Coder:
    return kept_by_worker(("duckdb", path, pattern), lambda: Coder(path, pattern))


def _encoded(texts: pa.Array, ranks: str, pattern: str) -> pa.Array:
    made = [pa.array([], pa.list_(pa.int32()))]
    texts = texts.fill_null("")
    for a, b in slices_of(texts, _SLICE):
        made.append(coder(ranks, pattern).encode(texts.slice(a, b - a)).cast(made[0].type))
    return pa.concat_arrays(made)


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>), replacing a column of that name.

    Ids are those of the tiktoken library without special tokens. Null and empty texts have no ids.
    Every row is encoded for itself, so repeated rows, nulls elsewhere and other columns pass. Very
    long texts are cut into words like others; a very long word without blanks is encoded in
    stretches, in time in proportion to its length unless it neither repeats nor mends.
    """

    def run(texts: pa.Array) -> pa.Array:
        return _encoded(texts, ranks, pattern)

    return docs.withColumn("ids", F.arrow_udf(run, "array<int>")(F.col(text)))


def _decoded(lists: pa.Array, ranks: str, pattern: str) -> pa.Array:
    made = [pa.array([], pa.binary())]
    lengths = lists.value_lengths().fill_null(0).to_pylist()
    for a, b in slices([range(n) for n in lengths], _QUERY_IDS):
        made.append(coder(ranks, pattern).decode(lists.slice(a, b - a)))
    return pa.concat_arrays(made)


def decode(coded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """``coded`` with decoded (binary), the bytes of its ids, replacing a column of that name."""

    def run(lists: pa.Array) -> pa.Array:
        return _decoded(lists, ranks, pattern)

    return coded.withColumn("decoded", F.arrow_udf(run, "binary")(F.col(ids)))


def encode_and_decode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ids and with decoded, the bytes that these ids stand for.

    The same as ``decode(encode(docs))``, but in one call of a worker: chained, Spark would encode once
    for each of the two columns.
    """

    def run(texts: pa.Array) -> pa.Array:
        lists = _encoded(texts, ranks, pattern)
        return pa.StructArray.from_arrays([lists, _decoded(lists, ranks, pattern)], ["ids", "decoded"])

    both = F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>")(F.col(text))
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    return docs.withColumn("__coded", both).select(*rest, "__coded.ids", "__coded.decoded")
