"""Importance resampling: planes, hashed runs and ranks against a version that counts one by one."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfare.llm import importance

from .conftest import messy, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(rows, target, percent=5):
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ss, tt = float(s.total()), float(t.total())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10000) / ((s[b] + 1.0) * (tt + 10000)))) for b in set(s) | set(t)}
    out = []
    for i, text in rows:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words), len(own), weight, score))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn[(r[0], r[4], place)] += 1
    return sorted(out, key=str), drawn


def check(spark, rows, target, percent=5, **columns):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "1 as score", "'x' as rank", "2 as weight")
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.importance_sample(docs, texts, percent=percent).collect()
    plain, drawn = brute(rows, target, percent)
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"] is not None) == drawn


def test_messy_rows_equal_brute_force(spark):
    check(spark, messy(), [prose(1, 60), None, "", "Ünïcode ça va " * 3, "X " * 9], percent=40)


def test_ties_repeated_rows_and_everything_drawn(spark):
    text = prose(3, 40)
    rows = [(5, text)] * 30 + [(i, text) for i in range(40)] + [(None, text), (7, "short")]
    check(spark, rows, [text], percent=100)
    check(spark, rows, [text], percent=50)


def test_empty_tables(spark, empty):
    nothing = spark.createDataFrame([], "text string")
    assert importance.importance_sample(empty, nothing).count() == 0
    check(spark, [(1, "a b c"), (2, None)], [])


def test_long_words_and_long_texts(spark):
    words = ["x" * n for n in (63, 64, 65, 66, 300, 5000)] + ["é" * 40, "日本語" * 30, "ok"]
    rows = [(1, " ".join(words * 3)), (2, prose(4, 60_000)), (3, "y" * 200_000)]
    check(spark, rows, [" ".join(words)], percent=100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=70), max_size=8), max_size=4))
def test_runs_are_hashed_like_joined_words(words):
    for n, (buckets, owner) in enumerate(importance.run_buckets(words), 1):
        expected = [
            (k, zlib.crc32(b" ".join(own[i : i + n])) % 10000)
            for k, own in enumerate(words)
            for i in range(len(own) - n + 1)
        ]
        assert list(zip(owner.tolist(), buckets.tolist(), strict=True)) == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 300), st.integers(0, 5))
def test_planes_give_the_exact_sum(seed, buckets, rows):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 2 ** int(rng.integers(1, 20)), (rows, buckets))
    gain = rng.integers(-30_000, 30_000, buckets)
    assert (importance.weights(counts, *importance.gain_planes(gain)) == counts @ gain).all()


@pytest.mark.parametrize("gain", [[0, 0, 0], [5], [-5]])
def test_gains_of_one_sign(gain):
    counts = np.arange(2 * len(gain)).reshape(2, -1)
    assert (importance.weights(counts, *importance.gain_planes(np.array(gain))) == counts @ gain).all()
