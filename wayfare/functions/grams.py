"""Character grams of word lists as Arrow functions.

A batch's distinct words are cut once, by arithmetic on their code points; documents then add up what their words
hold, in slices of whole documents, so that memory follows the batch's text and not its number of grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# A gram's hash: code points as digits to this base, modulo this prime, from left to right.
HASH_BASE = 1_000_003
HASH_PRIME = 2_147_483_647
# Grams of documents that are added up at a time.
SLICE = 1 << 20


def _windows(words: list[str]):
    """(text, code points, word of each, characters from each to its word's end) of the padded words."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    return text, points, word, np.cumsum(size)[word] - np.arange(len(points))


def _terms(words: list[str], low: int, high: int):
    """(word, gram) of every gram of every word, and the grams' texts; a longer gram continues a shorter one."""
    text, points, word, left = _windows(words)
    code = np.unique(points, return_inverse=True)[1]
    base = int(code.max()) + 1
    longer, of, gram, texts = np.zeros(len(points), np.int64), [], [], []
    for n in range(1, high + 1):
        at = np.flatnonzero(left >= n)
        _, first, longer[at] = np.unique(longer[at] * base + code[at + n - 1], return_index=True, return_inverse=True)
        if n >= low:
            of.append(word[at])
            gram.append(longer[at] + len(texts))
            texts += [text[i : i + n] for i in at[first]]
    return np.concatenate(of), np.concatenate(gram), texts


def _buckets(words: list[str], low: int, high: int, dimensions: int):
    """(word, bucket) of every gram of every word. Grams that start at one place share the hash of their head."""
    _, points, word, left = _windows(words)
    value, of, bucket = np.zeros(len(points), np.int64), [], []
    for n in range(1, high + 1):
        at = np.flatnonzero(left >= n)
        value[at] = (value[at] * HASH_BASE + points[at + n - 1]) % HASH_PRIME
        if n >= low:
            of.append(word[at])
            bucket.append(value[at] % dimensions)
    return np.concatenate(of), np.concatenate(bucket)


def _by_document(lists, cut):
    """(first row, last row, row, item, times) by slices of documents, and what ``cut`` gives besides (word, item)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return [], []
    of, item, *more = cut(words)
    order = np.argsort(of, kind="stable")
    item, many = item[order], np.bincount(of, minlength=len(words))
    begin = np.cumsum(many) - many
    row = np.repeat(np.arange(len(lists)), sizes)
    pair, times = np.unique(row * len(words) + coded.indices.to_numpy(), return_counts=True)
    row, word = np.divmod(pair, len(words))
    total = np.cumsum(np.bincount(row, many[word], len(lists)))
    ends = np.searchsorted(total, np.arange(SLICE, total[-1] + SLICE, SLICE)).clip(max=len(lists) - 1)
    ends = np.unique(np.r_[ends, len(lists) - 1])

    def slices():
        start = 0
        for end in ends.tolist():
            lo, hi = np.searchsorted(row, (start, end + 1))
            own = many[word[lo:hi]]
            at = np.repeat(begin[word[lo:hi]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            yield start, end, np.repeat(row[lo:hi], own), item[at], np.repeat(times[lo:hi], own)
            start = end + 1

    return slices(), more


def gram_counts(words: Column, low: int = 2, high: int = 4) -> Column:
    """Array of (term, tf): the padded grams of the words of an array and how often each occurs."""

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def count(lists: pa.Array) -> pa.Array:
        slices, texts = _by_document(lists, lambda w: _terms(w, low, high))
        grams, sums, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end, row, gram, times in slices:
            key = row * len(texts[0]) + gram
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            sums.append(np.add.reduceat(times[order], first) if len(first) else first)
            row, gram = np.divmod(key[first], len(texts[0]))
            grams.append(gram)
            sizes.append(np.bincount(row - start, minlength=end + 1 - start))
        sizes = np.concatenate(sizes) if len(sizes) > 1 else np.zeros(len(lists), np.int64)
        terms = pa.array(texts[0] if texts else [], pa.string()).take(pa.array(np.concatenate(grams)))
        pairs = pa.StructArray.from_arrays([terms, pa.array(np.concatenate(sums))], names=["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs)

    # Not deterministic by name alone: filters that Spark infers shall not count twice.
    return count.asNondeterministic()(words)


def bucket_counts(words: Column, dimensions: int, low: int = 2, high: int = 4) -> Column:
    """Array of the number of padded grams in each hash bucket; null where there is none."""

    @F.arrow_udf("array<bigint>")
    def count(lists: pa.Array) -> pa.Array:
        slices, _ = _by_document(lists, lambda w: _buckets(w, low, high, dimensions))
        parts = [np.zeros(0, np.int64)]
        for start, end, row, bucket, times in slices:
            cells = (row - start) * dimensions + bucket
            parts.append(np.bincount(cells, times, (end + 1 - start) * dimensions).astype(np.int64))
        counts = np.concatenate(parts) if len(parts) > 1 else np.zeros(len(lists) * dimensions, np.int64)
        empty = ~counts.reshape(len(lists), dimensions).any(axis=1)
        offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions)
        return pc.if_else(pa.array(empty), None, pa.ListArray.from_arrays(offsets, pa.array(counts)))

    # As above.
    return count.asNondeterministic()(words)
