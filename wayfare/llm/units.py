"""Cut texts where no piece of the byte-level BPE pattern can cross.

The pattern joins one space to the word after it and never mixes blanks with other characters in
a piece. So a text may be cut before a single space or newline that stands between two characters
that are not blank, and each part be split and encoded alone: units repeat, and may be cached.
"""

from __future__ import annotations

import re
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Two blanks side by side, of any kind that some pattern takes for a blank, or the mark used here.
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANKS_MEET = _BLANK + "{2}|\\x00"
# One space, then what begins and ends with no blank.
PLAIN = rf"\A [^{_BLANK[1:]}(?:(?s:.*)[^{_BLANK[1:]})?\z"
_MEET = re.compile(r"\s{2}")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def units(text: str) -> list[str]:
    """Parts of ``text`` in order; empty parts mean nothing. Their concatenation is ``text``."""
    if _MEET.search(text) or text[-1:].isspace() or "\0" in text:
        return _CUT.split(text)
    # Every blank stands alone: a space goes with what follows, a newline stands by itself.
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def slices(texts, most: int):
    """Runs (first, last) of ``texts`` of about ``most`` characters each, at least one text."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def slices_of(texts: pa.Array, most: int):
    """``slices`` of an Arrow array of strings, by bytes."""
    return slices([range(n) for n in pc.binary_length(texts).to_pylist()], most)


def gathered(batches, column: int, most: int):
    """Record batches in order; small ones are joined as long as ``column`` holds ``most`` bytes at most."""
    held, size = [], 0
    for batch in batches:
        own = batch.column(column).nbytes
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def _all_units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(units of all texts in a row, dictionary-encoded; number of units of each text)."""
    if not len(texts):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    # What ``units`` does, on all texts at once; texts where blanks meet are cut one by one.
    lone = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
    lists = pc.split_pattern(lone, "\0")
    counts = lists.value_lengths().to_numpy().astype(np.int64)
    chunks, done = [], 0
    for i in np.flatnonzero(pc.match_substring_regex(texts, _BLANKS_MEET).to_numpy(zero_copy_only=False)):
        own = pa.array(units(texts[int(i)].as_py()), pa.string())
        chunks += [lists.slice(done, i - done).flatten(), own]
        counts[i], done = len(own), i + 1
    chunks.append(lists.slice(done).flatten())
    return pa.concat_arrays(chunks).dictionary_encode(), counts


class Recent:
    """Codes of units of late: two generations of about ``most`` units each.

    When the young generation is full it becomes the old one, so units that recur stay.
    """

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def values(self, keys: list[str], make) -> list[bytes]:
        """The code of each of the distinct ``keys``; ``make`` gets the list of unknown ones."""
        found = list(map(self.young.get, keys))
        lacking = [k for k, value in zip(keys, found, strict=True) if value is None]
        if lacking:
            again = {k: self.old[k] for k in lacking if k in self.old}
            new = [k for k in lacking if k not in again]
            again.update(zip(new, make(new) if new else (), strict=True))
            found = [again[k] if value is None else value for k, value in zip(keys, found, strict=True)]
            # Long ones rarely recur.
            self.young.update(again if max(map(len, lacking)) <= 100 else {k: v for k, v in again.items() if len(k) <= 100})
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        return found

    def coded(self, texts: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where those of each text begin and the last ends)."""
        flat, counts = _all_units(texts)
        codes = self.values(flat.dictionary.to_pylist(), make)
        data = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        index = flat.indices.to_numpy()
        each = sizes[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        # A slice of texts has far fewer than 2^31 ids; half the bytes take half the time.
        kind = np.int32 if max(len(data), ends[-1]) < 2**31 else np.int64
        at = np.repeat(((np.cumsum(sizes) - sizes)[index] - ends[:-1]).astype(kind), each)
        at += np.arange(int(ends[-1]), dtype=kind)
        return data[at], ends[np.concatenate([[0], np.cumsum(counts)])]

    def joined(self, cut: list[list[str]], make) -> list[bytes]:
        """The codes of each list's units, joined; ``make`` gets the list of unknown units."""
        young, out, late = self.young, [], []
        for i, units_here in enumerate(cut):
            try:
                out.append(b"".join(map(young.__getitem__, units_here)))
            except KeyError:
                out.append(b"")
                late.append(i)
        if late:
            unknown = chain.from_iterable(cut[i] for i in late)
            lacking = set(filterfalse(young.__contains__, unknown))
            again = {u: self.old[u] for u in lacking if u in self.old}
            young.update(again)
            new = list(lacking.difference(again))
            young.update(zip(new, make(new) if new else (), strict=True))
            for i in late:
                out[i] = b"".join(map(young.__getitem__, cut[i]))
            for unit in new:
                if len(unit) > 100:  # long ones rarely recur
                    del young[unit]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


class Known:
    """Codes of units of late, at most ``most`` of them, held in Arrow: no Python object for a unit that is known.

    When there are more, the half used last stays.
    """

    def __init__(self, most: int) -> None:
        self.most, self.now = most, 0
        self.keys, self.codes = pa.array([], pa.string()), pa.array([], pa.large_binary())
        # The number of the call that used each unit last.
        self.used = np.zeros(0, np.int64)

    def coded(self, texts: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """As ``Recent.coded``; each unit's code is copied whole instead of id by id."""
        flat, counts = _all_units(texts)
        at = pc.index_in(flat.dictionary, value_set=self.keys)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        self.now += 1
        self.used[place[~unknown]] = self.now
        place[unknown] = len(self.keys) + np.arange(np.count_nonzero(unknown))
        new = flat.dictionary.filter(pa.array(unknown))
        codes = pa.array(make(new.to_pylist()) if len(new) else [], pa.large_binary())
        taken = pa.concat_arrays([self.codes, codes]).take(pa.array(place)).take(flat.indices)
        self._keep(new, codes)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy())]) // 4
        data = np.frombuffer(taken.buffers()[2] or b"", "<u4", int(ends[-1]))
        return data, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _keep(self, new: pa.Array, codes: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(new), 100)  # long ones rarely recur
        new, codes = new.filter(short), codes.filter(short)
        self.keys, self.codes = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.codes, codes])
        self.used = np.concatenate([self.used, np.full(len(new), self.now)])
        if len(self.keys) > self.most:
            half = max(1, self.most // 2)
            stay = np.sort(np.argpartition(self.used, -half)[-half:])
            self.keys, self.codes, self.used = self.keys.take(stay), self.codes.take(stay), self.used[stay]
