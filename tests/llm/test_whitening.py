"""Whitening against numpy's eigenvectors, exact integers, and matrices of known spectrum."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfare.llm import whitening
from wayfare.llm.common import table
from wayfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def turned(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=12), st.integers(0, 99))
def test_counts_equal_signs_of_eigenvalues(values, seed):
    matrix = turned(np.array(values), seed)
    shift = float(np.median(values)) + 0.137
    clear = np.abs(np.array(values) - shift).min() > 1e-9
    if clear:
        assert whitening.above(matrix, shift) == sum(v > shift for v in values)


def test_counts_of_matrices_without_plain_pivots():
    # Zero diagonals need blocks of two.
    assert whitening.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    pairs = np.kron(np.eye(5), np.array([[0.0, 2.0], [2.0, 0.0]]))
    assert whitening.negatives(pairs) == 5
    rng = np.random.default_rng(1)
    for n in (3, 8, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        np.fill_diagonal(a, 0)
        assert whitening.negatives(a) == (np.linalg.eigvalsh(a) < 0).sum()


@pytest.mark.parametrize(
    "values",
    [
        [9, 5, 2, 1, 0.5],
        [5, 5, 5, 1],
        [3, 3, 3, 3, 3, 3],
        [1e12, 1, 1e-6, 1e-9],
        [4, 4 - 1e-9, 4 - 2e-9, 1, 0],
        [7, 0, 0, 0, 0],
        [0, 0, 0],
        [2e-200, 1e-200],
        [3e150, 2e150, 1e150],
        list(np.linspace(1, 2, 64)),
    ],
)
def test_leading_values_and_vectors(values):
    matrix = turned(np.array(values, float))
    found, vectors = whitening.leading(matrix, 4)
    scale = max(np.abs(values)) or 1.0
    k = min(4, len(values))
    assert found.shape == (k,) and np.abs(found - sorted(values, reverse=True)[:k]).max() <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() <= 1e-12 * scale


def brute(rows, components=4):
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    dims = [len(v) for _, v in kept]
    most = max(set(dims), key=lambda d: (dims.count(d), d))
    kept = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in kept if len(v) == most]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return kept, n, sums, values, axes, float(np.trace(cov))


def agrees(got, rows):
    kept, n, sums, values, axes, trace = brute(rows)
    parts = {}
    for r in got:
        parts.setdefault(r.component, []).append(r)
    assert sorted(parts) == list(range(1, len(values) + 1)) and all(len(p) == len(kept) for p in parts.values())
    mean = np.array([s / n for s in sums])
    for k, own in parts.items():
        assert {r.n for r in own} == {n} and len({r.identity_error for r in own}) == 1
        exact = [(str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in kept]
        exact = [(i, d if d < 2**63 else None) for i, d in exact]
        assert sorted(((str(r.vec_id), r.deviation) for r in own), key=str) == sorted(exact, key=str)
        want = {}
        for i, x in kept:
            want.setdefault(str(i), []).append(float((np.array(x) - mean) @ axes[:, k - 1] / np.sqrt(values[k - 1])))
        have = {}
        for r in own:
            have.setdefault(str(r.vec_id), []).append(r.whitened)
        flat = [(a, b) for i in want for a, b in zip(sorted(want[i]), sorted(have[i]), strict=True)]
        turned_ = [(-a, b) for i in want for a, b in zip(sorted(want[i], reverse=True), sorted(have[i]), strict=True)]
        assert min(max(abs(a - b) for a, b in f) for f in (flat, turned_)) < 1e-8
        assert all(abs(r.explained - values[k - 1] / trace) <= 1e-9 and r.identity_error < 1e-9 for r in own)


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    agrees(QUERIES["op12_spectrum_sliced_whitening"](spark, SF).collect(), rows)


def messy():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.1]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(5, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 6)]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (203, [float("nan")] * 6)]
    rows += [(204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0]), (206, [-0.0] * 6), (207, [1e-30] * 6)]
    return rows


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as x", "1 as n", "2 as whitened")


def test_messy_rows_equal_numpy(spark):
    agrees(whitening.whitened_vectors(frame(spark, messy()).repartition(4)).collect(), messy())


def test_large_entries_stay_exact(spark):
    rows = [(i, [c * 2.0**13 for c in v]) if v and None not in v else (i, v) for i, v in messy()]
    got = whitening.whitened_vectors(frame(spark, rows)).collect()
    agrees(got, rows)
    assert len({r.deviation for r in got} - {None}) > 10
    rows = [(i, [i * 2.0**40, float(-i), 3.0 * i * i]) for i in range(30)]
    got = whitening.whitened_vectors(frame(spark, rows), 2).collect()
    # n x is far beyond what squares to a long.
    assert {r.deviation for r in got} == {None} and all(abs(r.identity_error) < 1e-9 for r in got)


def test_no_variance_and_no_rows(spark):
    got = whitening.whitened_vectors(frame(spark, [(i, [1.5, 2.0]) for i in range(9)])).collect()
    assert len(got) == 18 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = whitening.whitened_vectors(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and {r.component for r in line} == {1, 2, 3}
    assert whitening.whitened_vectors(frame(spark, [])).count() == 0
    assert whitening.whitened_vectors(frame(spark, [(1, None), (2, [])], "float")).count() == 0
