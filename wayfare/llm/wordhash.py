"""Hashes of words and of runs of consecutive words, as arrays over many texts at once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Runs of anything but space and tab to carriage return; A-Z lower-cased if asked."""
    data = (text or "").encode("utf-8")
    return (data.lower() if lower else data).split()


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all lists in a row, number of words of each list)."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    each = map(xxhash.xxh3_64_intdigest, chain.from_iterable(words))
    return np.fromiter(each, np.uint64, int(counts.sum())), counts


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place (fewer places than words by k - 1)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    # A polynomial of the word hashes, built from runs of 1, 2, 4, ... words.
    done, size, power, length = None, 0, hashes, 1
    while True:
        if k & length:
            if done is None:
                done, size = power, length
            else:
                factor = np.uint64(pow(_BASE, length, 1 << 64))
                n = len(hashes) - size - length + 1
                done = done[:n] * factor + power[size : size + n]
                size += length
        if size == k:
            return mixed(done)
        factor = np.uint64(pow(_BASE, length, 1 << 64))
        n = len(hashes) - 2 * length + 1
        power = power[:n] * factor + power[length : length + n]
        length *= 2


def whole_runs(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places at which a run of k words lies within one list, list of each such place)."""
    fit = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), fit)
    offset = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)
    return (np.cumsum(counts) - counts)[owner] + offset, owner
