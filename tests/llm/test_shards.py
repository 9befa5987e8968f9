import math
import time
from collections import Counter

import numpy as np

from wayfare.llm import shards
from wayfare.llm.shards import blocks_of, matrix_row, shard_rows


def test_matrix_has_exact_sums():
    counts = np.array([5, 0, 100, 37, 1, 64])
    _, _, sizes = blocks_of(int(counts.sum()), 4, 20)
    rows = np.array([matrix_row(counts, sizes, p, 3) for p in range(len(counts))])
    assert (rows.sum(1) == counts).all() and (rows.sum(0) == sizes).all() and (rows >= 0).all()


def test_rows_beyond_any_limit_have_exact_sums():
    counts = np.array([10**12, 3, 999_000_000_000, 0, 2 * 10**12 + 1])
    _, _, sizes = blocks_of(int(counts.sum()), 4, 10**11)
    rows = np.array([matrix_row(counts, sizes, p, 3) for p in range(len(counts))])
    assert (rows.sum(1) == counts).all() and (rows.sum(0) == sizes).all() and (rows >= 0).all()
    # Each cell is within some deviations of its share.
    share = np.outer(counts.astype(float), sizes / counts.sum())
    assert (np.abs(rows - share) <= 6 * np.sqrt(share + 1)).all()


def test_own_draws_have_the_law_of_numpy(monkeypatch):
    rng = np.random.default_rng(5)
    for good, bad, drawn in ((40, 60, 30), (5, 5, 5), (300, 7, 150), (3, 2000, 900), (10**6, 10**6, 10**5), (1, 1, 1)):
        n = 20_000
        want = rng.hypergeometric(good, bad, drawn, n)
        with monkeypatch.context() as m:
            m.setattr(shards, "NUMPY_LIMIT", 0)
            got = shards.hypergeometric(rng, np.full(n, good), np.full(n, bad), np.full(n, drawn))
        assert got.min() >= max(0, drawn - bad) and got.max() <= min(good, drawn)
        cuts = np.unique(np.quantile(want, np.linspace(0, 1, 12)))
        a, b = (np.histogram(x, np.r_[-np.inf, cuts + 0.5, np.inf])[0] for x in (want, got))
        some = a + b > 0
        chi = ((a - b)[some] ** 2 / (a + b)[some]).sum()
        assert chi < some.sum() + 5 * np.sqrt(2 * some.sum()) + 5


def test_law_to_double_precision_at_any_size():
    x, good, bad, drawn = 30.0, 40.0, 60.0, 55.0
    exact = [math.comb(40, int(k)) * math.comb(60, 55 - int(k)) for k in (x, 22)]
    law = [float(shards._log_law(np.array([k]), np.array([good]), np.array([bad]), np.array([drawn]))[0]) for k in (x, 22.0)]
    assert math.isclose(law[0] - law[1], math.log(exact[0] / exact[1]), rel_tol=1e-12)
    # One step from the mode of a law over 10**13 rows is a ratio of four counts.
    g, b, d = 4e12, 6e12, 5e11
    k = 2e11 + 12345
    law = shards._log_law(np.array([k, k + 1]), np.array([g, g]), np.array([b, b]), np.array([d, d]))
    assert math.isclose(law[1] - law[0], math.log((g - k) / (k + 1) * (d - k) / (b - d + k + 1)), abs_tol=2e-9)


def test_a_batch_costs_the_same_for_any_number_of_blocks():
    """A row of the matrix over 200,000 blocks, once a partition; a batch is a search in its sums."""
    sizes = np.full(200_000, 4096)
    counts = np.full(64, sizes.sum() // 64)
    start = time.time()
    row = matrix_row(counts, sizes, 17, 3)
    assert row.sum() == counts[17] and time.time() - start < 20


def check(got, n, shards):
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and max(sizes.values()) - min([sizes[s] for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_are_even_and_slots_gapless(clashing):
    got = shard_rows(clashing, shards=3, block_rows=4).collect()
    check(got, clashing.count(), 3)
    assert Counter(r.text for r in got) == Counter(r.text for r in clashing.collect())


def test_places_are_uniform(spark):
    docs = spark.range(4000, numPartitions=7).selectExpr("id as doc_id", "'same' as text")
    got = shard_rows(docs, shards=8, block_rows=100).collect()
    check(got, 4000, 8)
    place = np.array([r.slot * 8 + r.shard for r in sorted(got, key=lambda r: r.doc_id)])
    assert abs(np.corrcoef(np.arange(4000), place)[0, 1]) < 0.06
    again = shard_rows(docs, shards=8, block_rows=100).collect()
    assert sorted(again) == sorted(got)
    other = shard_rows(docs, shards=8, block_rows=100, seed=8).collect()
    assert sorted(other) != sorted(got)


def test_empty_table_and_few_rows(spark, empty):
    assert shard_rows(empty).count() == 0
    check(shard_rows(spark.range(3).selectExpr("id as doc_id"), shards=8).collect(), 3, 8)
