import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import fusion, neardup, search, similarity, tfidf

DOCS = [(1, "red rice"), (2, "red red fish"), (3, "fish soup")]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    counts = tfidf.term_counts(docs)
    return counts, tfidf.fit_vocabulary(counts, 3)


def test_hand_computed_tfidf(model):
    counts, terms = model
    assert [(r["term"], r["term_id"], round(r["idf"], 6)) for r in terms.orderBy("term").collect()] == [
        ("fish", 0, 1.287682),
        ("red", 1, 1.287682),
    ]
    got = {
        (r["doc_id"], r["term_id"]): round(r["weight"], 6)
        for r in tfidf.tfidf_weights(counts, terms).collect()
    }
    assert got == {(1, 1): 1.0, (2, 0): 0.508542, (2, 1): 0.861037, (3, 0): 1.0}


def test_sparse_search_and_single_list_fusion(spark, model):
    counts, terms = model
    vectors = tfidf.sparse_vectors(counts, terms)
    asked = spark.createDataFrame(
        [(1, "red fish"), (2, "unknown words")], "query_id bigint, text string"
    )
    q = search.query_weights(asked, terms)
    got = search.sparse_topk(vectors, q, 10).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == [
        (1, 2, 0.968439),
        (1, 1, 0.707107),
        (1, 3, 0.707107),
    ]
    joined = search.ranked(search.sparse_scores(tfidf.unpack_sparse(vectors), q), 10)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, got))
    fused = fusion.sparse_fused_topk(vectors, q, 3).orderBy("rank").collect()
    assert [r["score"] for r in fused] == [0.016393, 0.016129, 0.015873]


def test_large_query_sets_are_joined_by_term(spark, monkeypatch):
    """The same hits when queries are held block by block, and when frequent terms are joined in parts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [
        (i, "abc"[i % 3], " ".join(["hot"] + rng.choices(words, k=rng.randint(1, 12)))) for i in range(120)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, tag string, text string")
    counts = tfidf.term_counts(docs, carry=("tag",))
    terms = tfidf.fit_vocabulary(counts, 120)
    vectors = tfidf.sparse_vectors(counts, terms, ("tag",))
    asked = spark.createDataFrame(
        [(i, ["a"] if i % 2 else [], f"hot w{i} w{i + 9}") for i in range(20)],
        "query_id bigint, tags array<string>, text string",
    )
    q = search.query_weights(asked, terms)
    held = sorted(map(tuple, search.sparse_topk(vectors, q, 4).collect()))
    monkeypatch.setattr(search, "MAX_QUERY_TERMS", 20)
    assert sorted(map(tuple, search.sparse_topk(vectors, q, 4).collect())) == held
    monkeypatch.setattr(search, "MAX_QUERY_TERMS", 0)
    monkeypatch.setattr(search, "HOT_POSTINGS", 10)
    weights = tfidf.unpack_sparse(vectors, ("tag",))
    assert sorted(map(tuple, search.ranked(search.sparse_scores(weights, q), 4).collect())) == held
    assert len(held) == 80


def test_held_and_joined_queries_agree_on_tags_and_halves(spark, monkeypatch):
    """An empty tag is a tag, a null one is none; scores in the middle are rounded up."""
    rows = [(1, "", 1.0), (2, None, 1.0), (3, "a", 1.0), (4, "a", 0.5), (5, "", 0.25), (6, "b", 0.750001)]
    vectors = spark.createDataFrame(
        [(i, t, ([0], [w])) for i, t, w in rows],
        "doc_id bigint, tag string, sparse struct<indices: array<bigint>, values: array<double>>",
    )
    halves = [0.1234565, 0.0000025, 0.2500005, 0.0000065, 0.3000015]
    wanted = [None, [], [""], ["a", None], ["", "b"]]
    q = spark.createDataFrame(
        [(5 * i + j, t, 0, w) for i, t in enumerate(wanted) for j, w in enumerate(halves)],
        "query_id bigint, tags array<string>, term_id bigint, weight double",
    )
    held = sorted(map(tuple, search.sparse_topk(vectors, q, 2).collect()))
    monkeypatch.setattr(search, "MAX_QUERY_TERMS", 10)
    assert sorted(map(tuple, search.sparse_topk(vectors, q, 2).collect())) == held
    found = {(r[0], r[1]): r[2] for r in held}
    assert {d for n, d in found if n in range(10, 15)} == {1, 5} and {d for n, d in found if n in range(15, 20)} == {3, 4}
    assert [found[n, 1] for n in range(5)] == [0.123457, 0.000003, 0.250001, 0.000007, 0.300002]


def test_vocabulary_size_is_bounded(model, monkeypatch):
    counts, terms = model
    # A bound beyond what one task ranks gives the ids of one within it.
    known = sorted(map(tuple, terms.collect()))
    assert sorted(map(tuple, tfidf.fit_vocabulary(counts, 3, max_features=10**9).collect())) == known
    monkeypatch.setattr(tfidf, "SMALL_VOCABULARY", 1)
    assert sorted(map(tuple, tfidf.fit_vocabulary(counts, 3, max_features=10**9).collect())) == known
    top = tfidf.fit_vocabulary(counts, 3, max_features=1).collect()
    assert [(r["term"], r["cf"]) for r in top] == [("red", 3)]


def test_vocabulary_is_cut_by_histograms(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 6, 300), rng.integers(1, 10**7, 50), [10**12, 10**12]])
    names = [f"w{x}" for x in rng.permutation(len(sizes))]
    rows = [(d, names[i], int(n)) for i, n in enumerate(sizes) for d in (1, 2)]
    counts = spark.createDataFrame(rows, "doc_id bigint, term string, tf bigint")
    totals = {t: 2 * n for _, t, n in rows}
    for wanted in (1, 2, 3, 40, 52, 100, 200, 351, 352, 10**9):
        best = sorted(totals, key=lambda t: (-totals[t], t))[:wanted]
        got = tfidf.fit_vocabulary(counts, 2, max_features=wanted)
        assert {r["term"]: r["term_id"] for r in got.collect()} == {t: i for i, t in enumerate(sorted(best))}
    # Few bins take several rounds and end at the same value.
    held = tfidf.term_totals(counts, 2)
    for rank in (1, 2, 3, 60, 200):
        assert tfidf.count_at_rank(held, "cf", rank, bins=3) == tfidf.count_at_rank(held, "cf", rank)
    assert tfidf.count_at_rank(held, "cf", 352) == (None, 0)
    assert tfidf.fit_vocabulary(counts.limit(0), 0).count() == 0


def _random_vectors(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype("float32")
    for i in range(copies):
        v[n - 1 - i] = v[0]
    return v


def _brute_topk(docs, queries, k, allowed=lambda q, d: True):
    out = set()
    for q, qv in enumerate(queries):
        scored = []
        for d, dv in enumerate(docs):
            if allowed(q, d):
                a, b = qv.astype(float), dv.astype(float)
                scored.append((-round(a @ b / math.sqrt((a @ a) * (b @ b)), 6), d))
        out |= {(q, d, r + 1) for r, (_, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("held", [True, False])
def test_dense_topk_equals_brute_force(spark, held):
    docs, queries = _random_vectors(300, 8, 1, copies=100), _random_vectors(30, 8, 2)
    tags = ["a", "b", None]
    wanted = [[], ["a"], ["a", "b"], None]
    d = spark.createDataFrame(
        [(i, v.tolist(), tags[i % 3]) for i, v in enumerate(docs)],
        "doc_id bigint, embedding array<float>, tag string",
    )
    q = spark.createDataFrame(
        [(i, v.tolist(), wanted[i % 4]) for i, v in enumerate(queries)],
        "query_id bigint, embedding array<float>, tags array<string>",
    )
    options = {} if held else dict(max_queries=7, doc_block=50)
    got = search.dense_topk(d, q, 5, **options).select("query_id", "doc_id", "rank").collect()

    def allowed(qi, di):
        t = wanted[qi % 4]
        return not t or tags[di % 3] in t

    assert {tuple(r) for r in got} == _brute_topk(docs, queries, 5, allowed)


def test_cells_without_a_hit_are_skipped(spark):
    """Clustered documents: each of many queries visits few cells, and the hits are those of brute force."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(40, 16))
    docs = (np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(2000, 16))).astype("float32")
    queries = (centres[rng.integers(0, 40, 300)] + rng.normal(scale=0.05, size=(300, 16))).astype("float32")
    d = spark.createDataFrame(
        [(i, v.tolist(), None) for i, v in enumerate(docs)] + [(9000, None, "a"), (9001, [0.0] * 16, "a")],
        "doc_id bigint, embedding array<float>, tag string",
    )
    q = spark.createDataFrame(
        [(i, v.tolist(), None) for i, v in enumerate(queries)] + [(900, [0.0] * 16, None), (901, None, None)],
        "query_id bigint, embedding array<float>, tags array<string>",
    )
    placed, first, visits = search.cells_to_visit(d, q, search._pivots(d, 100), 5, 50, 100)
    cells = placed.select("cell").distinct().count()
    assert cells >= 30 and placed.count() == 2000 and 1200 <= first.count() <= 1500
    # Without bounds there would be a visit for every query and every other cell.
    assert visits.count() < 0.1 * 300 * (cells - 1)
    got = search.dense_topk(d, q, 5, max_queries=50, doc_block=100).select("query_id", "doc_id", "rank").collect()
    assert {tuple(r) for r in got} == _brute_topk(docs, queries, 5)
    empty = search.dense_topk(d.limit(0), q, 5, max_queries=50)
    assert empty.count() == 0 and search.dense_topk(d.filter("doc_id >= 9000"), q, 5, max_queries=50).count() == 0


def test_dense_topk_with_string_ids_and_null_vectors(spark):
    d = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), ("z", [0.0, 0.0])],
        "doc_id string, embedding array<float>",
    )
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = search.dense_topk(d, q, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0)]


def test_hybrid_without_a_sparse_model_is_dense(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    got = fusion.hybrid_topk(d, q, None, None, k=1).collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == [(7, 1, 1.0)]


def test_fusion_shapes(spark):
    lists = spark.createDataFrame(
        [("s", 1, 10, 5.0, 1), ("s", 1, 11, 5.0, 2), ("d", 1, 10, 0.9, 1), ("d", 1, 12, 0.1, 2)],
        "list string, query_id bigint, doc_id bigint, score double, rank int",
    )
    rrf = {r["doc_id"]: r["score"] for r in fusion.rrf(lists).collect()}
    assert rrf == {10: round(2 / 61, 6), 11: round(1 / 62, 6), 12: round(1 / 62, 6)}
    dbsf = {r["doc_id"]: r["score"] for r in fusion.dbsf(lists).collect()}
    # Equal scores have no deviation and count one half each.
    assert dbsf[11] == 0.5 and dbsf[10] == pytest.approx(0.5 + 0.617851, abs=1e-5)


def _brute_pairs(v, t):
    u = v.astype(float)
    u = u / np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= t}


@pytest.mark.parametrize("leaf,threshold", [(1000, 0.5), (100, 0.7), (20, 0.85), (8, 0.99)])
def test_pairs_equal_brute_force(spark, leaf, threshold):
    v = _random_vectors(400, 6, 3, copies=20)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
    got = similarity.similar_pairs(df, df, threshold, leaf=leaf, block=64)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(_brute_pairs(v, threshold))
    odd, even = df.filter("id % 2 = 1"), df.filter("id % 2 = 0")
    got = similarity.similar_pairs(odd, even, threshold, leaf=leaf // 2, block=32, forward=False)
    both = {(a, b) if a % 2 else (b, a) for a, b in _brute_pairs(v, threshold) if (a + b) % 2}
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(both)


def _clusters(spark, n, size=20, width=32):
    """n vectors in tight clusters of ``size``: the number of clusters grows with n."""
    rng = np.random.default_rng(n)
    v = np.repeat(rng.normal(size=(n // size, width)), size, axis=0)
    v = (v + rng.normal(scale=0.05, size=v.shape)).astype("float32")
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(4), v


def test_comparisons_per_row_do_not_grow_with_the_rows(spark):
    """Two more doublings of the rows, with as many more clusters, leave the partners to try per row alone."""
    tried = []
    for n in (1000, 2000, 4000):
        df, v = _clusters(spark, n)
        homes, visits = similarity.layout(df, df, 0.95, leaf=100)
        work = similarity._counts(homes, visits).selectExpr("sum(n_left * n_right) as w", "max(n_left) as m").first()
        tried.append(work["w"] / n)
        assert homes.count() == n and work["m"] <= 400
    # Without cells it would be 1000, 2000 and 4000.
    assert tried[2] < 1.5 * tried[0] and tried[2] < 200
    got = similarity.similar_pairs(df, df, 0.95, leaf=100)
    assert {(r["a"], r["b"]) for r in got.collect()} == _brute_pairs(v, 0.95)


def test_cells_that_gain_nothing_stay_whole(spark):
    """A crowd of near copies, and vectors in no clusters at a low threshold, are not copied to many cells."""
    rng = np.random.default_rng(8)
    for v, t in ((1 + rng.normal(scale=1e-4, size=(600, 8)), 0.9), (rng.normal(size=(600, 64)), 0.3)):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
        homes, visits = similarity.layout(df, df, t, leaf=50)
        assert homes.count() == 600 and visits.count() == 600


def _greedy(n, pairs):
    """Sequential walk: leaders in row order, groups look forward."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
    covered, groups = set(), {}
    for i in range(n):
        if i not in covered:
            if near[i]:
                groups[i] = {i} | near[i]
            covered |= {i} | near[i]
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_leader_rounds_equal_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([15, 60, 150]))})
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    lead, _ = neardup.leaders(df)
    near, covered, want = {}, set(), set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    for i in sorted(near):
        if i not in covered:
            want.add(i)
            covered |= near[i]
    assert {r["id"] for r in lead.collect()} == want


def test_long_chains_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a bigint, b bigint")
    assert {r["id"] for r in neardup.leaders(chain)[0].collect()} == set(range(0, 1001, 2))
    short = chain.filter("a < 6")
    assert {r["id"] for r in neardup.leaders(short, finish_pairs=0)[0].collect()} == {0, 2, 4, 6}


def test_groups_with_a_third_of_copies(spark):
    v = _random_vectors(240, 5, 9)
    order = np.random.default_rng(4).permutation(240)
    v[order[:80]] = v[order[0]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
    groups = neardup.near_duplicate_groups(df, 0.9, hot_rows=10, leaf=30, block=32)
    got = {}
    for r in groups.collect():
        got.setdefault(r["leader"], set()).add(r["id"])
    want = _greedy(240, _brute_pairs(v, 0.9))
    assert got == want
    # The same groups when the copies are told apart by a little noise and decided in batches.
    noisy = v + np.random.default_rng(5).normal(scale=1e-3, size=v.shape).astype("float32")
    near = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(noisy)], "id bigint, embedding array<float>")
    found = {}
    for r in neardup.near_duplicate_groups(near, 0.9, budget=2, leaf=30, block=32).collect():
        found.setdefault(r["leader"], set()).add(r["id"])
    assert found == _greedy(240, _brute_pairs(noisy, 0.9))
    sizes = spark.createDataFrame([(i, i % 7) for i in range(240)], "id bigint, size int")
    keep = {r["id"] for r in neardup.rows_to_keep(df, groups, sizes).collect()}
    best = {max(g, key=lambda i: (i % 7, -i)) for g in want.values()}
    assert keep == best | (set(range(240)) - set().union(*want.values()))


@pytest.mark.parametrize("late", [False, True])
def test_a_crowd_of_near_copies_is_decided_in_batches(spark, late, monkeypatch):
    """A third of all rows nearly equal, at the start or at the end of the id order."""
    v = _random_vectors(600, 8, 11)
    crowd = range(400, 600) if late else range(200)
    noise = np.random.default_rng(6).normal(scale=1e-3, size=v.shape).astype("float32")
    for i in crowd:
        v[i] = v[crowd[0]] + noise[i]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
    emitted = []
    real = neardup.similar_pairs

    def counted(*args, **kw):
        out = real(*args, **kw)
        emitted.append(out.count())
        return out

    monkeypatch.setattr(neardup, "similar_pairs", counted)
    got = {}
    for r in neardup.near_duplicate_groups(df, 0.95, budget=4).collect():
        got.setdefault(r["leader"], set()).add(r["id"])
    assert got == _greedy(600, _brute_pairs(v, 0.95))
    # All pairs of the crowd alone would be 19,900.
    assert sum(emitted) < 5000


def test_a_crowd_of_a_thousandth_of_the_rows_is_seen(spark, monkeypatch):
    """20 near copies among 20,000 rows, which a sample of a thousand would miss."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(20_000, 24)).astype("float32")
    plain = v.copy()
    crowd = rng.choice(20_000, 20, replace=False)
    v[crowd] = v[crowd[0]] + rng.normal(scale=1e-3, size=(20, 24)).astype("float32")
    frames = [
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id bigint, embedding array<float>").repartition(4).cache()
        for rows in (plain, v)
    ]
    ends = [19_999, 4_999]
    without, seen = (neardup.expected_pairs(f, ends) for f in frames)
    assert seen[0] - without[0] >= 150 and seen[1] - without[1] >= 0.5 * (crowd <= 4_999).sum()
    # A budget that the crowd alone exceeds: the batch shrinks until its pairs are few.
    first, rest = neardup._next_batch(frames[1], (without[0] + 50) / 20_000)
    assert rest is not None and first.count() + rest.count() == 20_000
    for f in frames:
        f.unpersist()


def test_vocabulary_beyond_one_task(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    counts = tfidf.term_counts(df)
    small = [sorted(map(tuple, tfidf.fit_vocabulary(counts, 40, 1, n).collect())) for n in (5, 1000)]
    monkeypatch.setattr(tfidf, "SMALL_VOCABULARY", 3)
    large = [sorted(map(tuple, tfidf.fit_vocabulary(counts, 40, 1, n).collect())) for n in (5, 1000)]
    assert small == large and len(small[0]) == 5


def test_long_unspaced_words_are_linear(spark):
    from wayfare.operators import context

    word = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(2_000_000))
    df = spark.createDataFrame([(1, word)], "doc_id bigint, text string")
    assert tfidf.term_counts(df, "char_wb").agg({"tf": "sum"}).first()[0] == 2_000_001 + 2_000_000 + 1_999_999
    assert context.split_oversize(df, ["doc_id"], "text", 500).count() == 4000


def test_texts_get_tasks_by_their_size(spark, monkeypatch):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {name: sorted(map(tuple, tfidf.term_counts(df, name).collect())) for name in ("word", "char_wb")}
    monkeypatch.setattr(tfidf, "TASK_BYTES", 2000)
    tasks = -(-sum(len(t) for _, t in docs) // 2000)
    assert tasks > 30 and tfidf.spread_by_id(df).rdd.getNumPartitions() == tasks
    assert {name: sorted(map(tuple, tfidf.term_counts(df, name).collect())) for name in want} == want


def test_packed_grams_are_the_counts(spark, monkeypatch):
    from wayfare.functions import grams, text
    from wayfare.operators import encode

    rng = random.Random(5)
    docs = [(i % 90, " ".join("".join(rng.choice("abÉ點心𝄞") for _ in range(rng.randint(1, 9))) for _ in range(i))) for i in range(100)]
    docs += [(None, "a b"), (None, "b"), (7, None), (91, ""), (92, " \n")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = df.select("doc_id", F.explode(text.char_grams("text")).alias("term")).groupBy("doc_id", "term").count()
    monkeypatch.setattr(grams, "SLICE", 100)
    packed = tfidf.packed_grams(df)
    assert sorted(map(str, tfidf.unpacked(packed).collect())) == sorted(
        map(str, want.withColumnRenamed("count", "tf").collect())
    )
    # Sparse vectors are the same from packed counts and from rows, also without any known term.
    terms = tfidf.fit_vocabulary(packed, 100, 2, 60)
    rows = tfidf.term_counts(df, "char_wb")
    for known in (terms, terms.limit(0)):
        both = [tfidf.sparse_vectors(c, known).orderBy("doc_id").collect() for c in (packed, rows)]
        assert [(r["doc_id"], r["sparse"]["indices"]) for r in both[0]] == [(r["doc_id"], r["sparse"]["indices"]) for r in both[1]]
        for a, b in zip(*both):
            assert a["sparse"]["values"] == pytest.approx(b["sparse"]["values"])
    # A bucket holds what its grams' hashes say.
    value = want.select("doc_id", "count", F.aggregate(
        F.transform(F.split("term", ""), lambda c: F.ascii(c)), F.lit(0).cast("bigint"),
        lambda s, c: (s * grams.HASH_BASE + c) % grams.HASH_PRIME,
    ).alias("h"))
    value = value.groupBy("doc_id", (F.col("h") % 32).cast("int").alias("bucket")).agg(F.sum("count").alias("n"))
    assert sorted(map(str, encode.hashed_buckets(df, 32).collect())) == sorted(map(str, value.collect()))


def test_visiting_rows_come_in_small_groups(spark, monkeypatch):
    placed, sizes = similarity._placed, []

    def spy(rows, cells, size, reach, block):
        sizes.append((size, block))
        return placed(rows, cells, size, reach, block)

    monkeypatch.setattr(similarity, "_placed", spy)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 4)))]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    similarity.layout(df, df, 0.99, leaf=100, block=64)
    assert {b for s, b in sizes if s == "n_left"} == {64} and {b for s, b in sizes if s == "n_right"} == {8}


@pytest.mark.parametrize("width,threshold", [(3, 0.2), (40, 0.6), (40, 0.999999), (80, 0.9)])
def test_close_pairs_of_two_blocks(monkeypatch, width, threshold):
    """Bounds in single precision lose no pair: vectors in a narrow cone, a crowd, copies, and scores next to the threshold."""
    rng = np.random.default_rng(width)
    v = np.r_[rng.normal(size=(200, width)), 3 + rng.normal(size=(200, width)), np.ones((60, width)) + rng.normal(scale=1e-3, size=(60, width))]
    v = np.r_[v, v[:50], v[150:200] + rng.normal(scale=0.05, size=(50, width))].astype("float32")
    v = v[rng.permutation(len(v))]
    units = v / np.linalg.norm(v.astype(float), axis=1)[:, None]
    odd, even = np.arange(1, len(v), 2), np.arange(0, len(v), 2)
    monkeypatch.setattr(similarity, "TILE", (64, 37))
    want = {(a, b) for p in _brute_pairs(v, threshold) for a, b in (p, p[::-1]) if a % 2 and not b % 2}
    for forward in (True, False):
        got = [
            pair
            for a, b, _ in similarity._close_pairs(odd, units[odd], even, units[even], threshold, forward)
            for pair in zip(a.tolist(), b.tolist())
        ]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a < b or not forward}


def test_no_row_is_copied_to_cells_that_gain_nothing(spark, monkeypatch):
    """Visits are counted first; before, each row was written once for every cell it has to visit."""
    placed, written = similarity._placed, []

    def spy(rows, cells, size, reach, block):
        out = placed(rows, cells, size, reach, block)
        written.append((size, out.count()))
        return out

    monkeypatch.setattr(similarity, "_placed", spy)
    v = np.random.default_rng(8).normal(size=(600, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
    _, visits = similarity.layout(df, df, 0.3, leaf=50)
    assert visits.count() == 600
    assert sum(n for size, n in written if size == "n_right") == 0


def test_a_cone_without_near_copies_is_one_batch(spark):
    """Rows in a narrow cone share signatures; held against a sample they show that few are similar."""
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(4, 24)), 500, axis=0) + rng.normal(scale=0.2, size=(2000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>").cache()
    assert neardup._next_batch(df, 0.5)[1] is not None
    assert neardup._next_batch(df, 0.5, 0.9999)[1] is None
    # A real crowd still shows.
    assert neardup._next_batch(df, 0.5, 0.8)[1] is not None
    df.unpersist()


@pytest.mark.parametrize("once", [True, False])
def test_rows_of_a_crowded_cell_are_not_copied(spark, monkeypatch, once):
    """Before, each row of a cell that no split helps was written once for every block it was held against, 16 times here."""
    rng = np.random.default_rng(21)
    v = _random_vectors(500, 48, 21)
    v[100:120] = v[100] + rng.normal(scale=0.02, size=(20, 48)).astype("float32")
    v[7], v[499] = 0, v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>").repartition(3)
    grouped, real = spark.sparkContext.accumulator(0), similarity._matcher

    def spy(threshold, forward):
        match = real(threshold, forward)

        def counted(batches):
            batches = list(batches)
            grouped.add(sum(b.num_rows for b in batches))
            yield from match(iter(batches))

        counted.__annotations__ = match.__annotations__
        return counted

    monkeypatch.setattr(similarity, "_matcher", spy)
    u = np.delete(v, 7, axis=0).astype(float)
    at = np.delete(np.arange(500), 7)
    want = {(int(at[a]), int(at[b])) for a, b in _brute_pairs(u, 0.4)}
    if once:
        got = similarity.similar_pairs(df, df, 0.4, leaf=50, block=16)
    else:
        odd, even = df.filter("id % 2 = 1"), df.filter("id % 2 = 0")
        got = similarity.similar_pairs(odd, even, 0.4, leaf=50, block=16, forward=False)
        want = {(a, b) if a % 2 else (b, a) for a, b in want if (a + b) % 2}
    assert len(want) > 100 and sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)
    assert grouped.value <= 3 * 500


def test_groups_expand_copies_by_narrow_keys(spark, monkeypatch):
    """Before, every pair of a leader and a row carried the row's vector through a shuffle, also without any copy."""
    joined, real = [], neardup.spread_join

    def spy(rows, dims, keys, *args):
        joined.append((rows.columns + dims.columns, dims.count()))
        return real(rows, dims, keys, *args)

    monkeypatch.setattr(neardup, "spread_join", spy)
    v = _random_vectors(200, 5, 17)
    v[150], v[160], v[10] = v[20], v[20], v[199]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    # Copies that no cosine tells: with null, zero and negative zero values, and an id that comes twice.
    odd = [(300, [1.0, None, 0.0, 0.0, 0.0]), (301, [None, 1.0, 0.0, 0.0, 0.0]), (302, [1.0, None, 0.0, -0.0, 0.0])]
    odd += [(303, [0.0] * 5), (304, [-0.0] * 5), (305, None), (306, None), (307, [float("nan")] * 5), (307, [float("nan")] * 5)]
    df = spark.createDataFrame(rows + odd, "id bigint, embedding array<float>").repartition(3)
    want = {(a, b) for a, g in _greedy(200, _brute_pairs(v, 0.9)).items() for b in g}
    want = sorted([*want, (300, 300), (300, 302), (303, 303), (303, 304), (307, 307), (307, 307)])
    for budget in (200, 1):
        got = neardup.near_duplicate_groups(df, 0.9, budget=budget)
        assert sorted(map(tuple, got.select("leader", "id").collect())) == want
    # Only rows that stand for copies are joined.
    assert all("embedding" not in columns for columns, _ in joined)
    assert 0 < joined[0][1] < len(want) / 4
