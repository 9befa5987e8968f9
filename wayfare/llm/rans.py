"""Interleaved asymmetric numeral systems with one static table (Duda 2013; Giesen 2014).

A block of symbols is dealt out to lanes: symbol i goes to lane i % lanes. Each lane has a 64-bit
state; a step codes one symbol in every lane, as one operation on arrays. States are kept above
2**31 by moving 32-bit words to one stream, in lane order, so a decoder reads the words of a step
as one slice. A checkpoint holds the states and the place in the stream at a step, so that the
parts of a block between checkpoints can be decoded apart from each other.

Block layout, little-endian: magic, version, scale bits, lanes, symbols, checkpoint steps, words,
crc32 of the table, crc32 of the decoded symbols as uint32, crc32 of what follows; then states at
step 0, per checkpoint its step, word position and states, and the words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Fixed values of the format.
MAGIC, VERSION = b"WRAN", 1
HEAD = "<4sHHIQIQIII"
HEAD_BYTES = struct.calcsize(HEAD)
LOW = np.uint64(1 << 31)
U32 = np.uint64(32)


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**scale_bits; symbols of frequency 0 cannot be coded."""

    freqs: np.ndarray
    scale_bits: int

    @staticmethod
    def fit(counts: np.ndarray, scale_bits: int = 20) -> Table:
        """Scale counts; every symbol that occurs keeps a frequency of at least one."""
        counts = np.asarray(counts, np.int64)
        total, room = int(counts.sum()), 1 << scale_bits
        if np.count_nonzero(counts) > room:
            raise ValueError("more symbols than the scale has room for")
        if not total:
            return Table(np.zeros(len(counts), np.int64), scale_bits)
        freqs = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
        order = np.argsort(-freqs, kind="stable")
        spare, i = room - int(freqs.sum()), 0
        if spare > 0:
            freqs[order[0]] += spare
        while spare < 0:  # too many were raised to one: take from the frequent, never below one
            symbol = order[i % len(order)]
            cut = min(-spare, max(0, int(freqs[symbol]) - 1), max(1, int(freqs[symbol]) // 16))
            freqs[symbol] -= cut
            spare, i = spare + cut, i + 1
        return Table(freqs, scale_bits)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)

    @cached_property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs)

    @cached_property
    def wide(self) -> np.ndarray:
        return self.freqs.astype(np.uint64)

    @cached_property
    def crc(self) -> int:
        return zlib.crc32(self.freqs.astype("<u4").tobytes())

    def __getstate__(self):  # derived arrays are made again where the table arrives
        return {"freqs": self.freqs, "scale_bits": self.scale_bits}


def encode(ids: np.ndarray, table: Table, lanes: int = 2048, checkpoint_steps: int = 128) -> bytes:
    ids = np.ascontiguousarray(ids, np.int64)
    n, bits = len(ids), np.uint64(table.scale_bits)
    if n and not table.freqs[ids].all():
        raise ValueError("a symbol is missing in the table")
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    freq, start = table.wide[ids], table.starts[ids]
    limit = ((LOW >> bits) << U32) * freq
    x = np.full(lanes, LOW, np.uint64)
    stream, marks, written = [], [], 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        own = x[: b - a]
        full = own >= limit[a:b]
        if full.any():
            words = (own[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            stream.append(words)
            written += len(words)
            own[full] >>= U32
        q = own // freq[a:b]
        x[: b - a] = (q << bits) + (own - q * freq[a:b]) + start[a:b]
        if step and step % checkpoint_steps == 0:
            marks.append((step, written, x.copy()))
    body = [x.astype("<u8").tobytes()]
    for step, count, states in reversed(marks):
        body.append(struct.pack("<IQ", step, written - count) + states.astype("<u8").tobytes())
    body += [w.tobytes() for w in reversed(stream)]
    body = b"".join(body)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = (MAGIC, VERSION, table.scale_bits, lanes, n, len(marks), written, table.crc, crc, zlib.crc32(body))
    return struct.pack(HEAD, *head) + body


def parts(block: bytes) -> int:
    """How many parts of a block can be decoded apart from each other."""
    return struct.unpack_from(HEAD, block)[5] + 1


def decode(block: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """Symbols of a block as uint32, or of one of its parts. Damage raises ValueError."""
    magic, version, scale, lanes, n, marks, n_words, table_crc, crc, body_crc = struct.unpack_from(HEAD, block)
    if magic != MAGIC or version != VERSION or scale != table.scale_bits or table_crc != table.crc:
        raise ValueError("not a block of this format and table")
    body = memoryview(block)[HEAD_BYTES:]
    if zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    size, steps = 12 + 8 * lanes, -(-n // lanes)
    begin = [(0, 0, np.frombuffer(body, "<u8", lanes))]
    for m in range(marks):
        at = 8 * lanes + m * size
        step, word = struct.unpack_from("<IQ", body, at)
        begin.append((step, word, np.frombuffer(body, "<u8", lanes, at + 12)))
    words = np.frombuffer(body, "<u4", n_words, 8 * lanes + marks * size)
    ends = [b[0] for b in begin[1:]] + [steps]
    first, last = (0, steps) if part is None else (begin[part][0], ends[part])
    _, place, states = begin[part or 0]
    x, bits = states.astype(np.uint64), np.uint64(scale)
    mask = np.uint64((1 << scale) - 1)
    out = np.empty(min(n, last * lanes) - min(n, first * lanes), np.uint32)
    symbols, freqs, starts = table.symbols, table.wide, table.starts
    for step in range(first, last):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        own = x[: b - a]
        slot = own & mask
        s = symbols[slot]
        own = freqs[s] * (own >> bits) + slot - starts[s]
        need = np.flatnonzero(own < LOW)
        own[need] = (own[need] << U32) | words[place : place + len(need)]
        place += len(need)
        x[: b - a] = own
        out[a - first * lanes : b - first * lanes] = s
    if part is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of the symbols does not match")
    return out
