import math
import re
from collections import Counter

import numpy as np

from wayfare.llm import weighted
from wayfare.llm.components import components

from .conftest import messy, prose


def exact(rows, threshold=weighted.SIMILARITY):
    """{id: class} of (id, text) by shingles as tuples of words and the idf written out; null ids are left out."""
    bags = []
    for _, t in rows:
        ws = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^ \t-\r]+", t or "")]
        bags.append(Counter(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, min(len(ws), 1)))))
    df = Counter(s for bag in bags for s in bag)
    n = len(rows)
    rounded = {k: 2 ** (math.floor(8 * math.log2(k)) / 8) for k in set(df.values())}
    idf = {s: 1 + math.log((1 + n) / (1 + rounded[k])) / (2 * math.log(1 + n)) for s, k in df.items()}
    weight = [sum(idf[s] * k for s, k in bag.items()) for bag in bags]
    least = {i: i for i, _ in rows if i is not None}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    holders = {}
    for x, (i, _) in enumerate(rows):
        if i is None:
            continue
        for y in {y for s in bags[x] for y in holders.get(s, ())}:
            shared = sum(idf[s] * min(k, bags[y][s]) for s, k in bags[x].items() if s in bags[y])
            if shared >= threshold * (weight[x] + weight[y] - shared):
                a, b = sorted((root(i), root(rows[y][0])))
                least[b] = a
        for s in bags[x]:
            holders.setdefault(s, []).append(x)
    return {i: root(i) for i in least}


def brute(rows, threshold=weighted.SIMILARITY):
    """The classes as the operator's rows are sorted: (id, class) as strings, null ids included."""
    found = exact(rows, threshold)
    return sorted((str(i), str(found.get(i))) for i, _ in rows)


def boilerplate():
    shared = prose(300, 104)
    rows = [(i, f"{shared} {prose(400 + i, 300)}") for i in range(40)]
    # 100 shared shingles and 10 own ones each: plain similarity 0.83, weighted 0.78.
    return rows + [(100 + i, f"{shared} {prose(500 + i, 10)}") for i in range(2)] + [(200, rows[0][1]), (201, prose(600, 3))]


def test_counts_of_documents_are_by_shingle(spark):
    rows = boilerplate()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in weighted.near_duplicates(docs).collect()}
    assert got == exact(rows) and got[101] == 101 and got[200] == 0


def test_weights_equal_the_formula():
    n, df = 4600, np.array([1, 2, 64, 70, 4600])
    rounded = [1, 2, 64, 2 ** (49 / 8), 2 ** (97 / 8)]
    expected = [1 + math.log((1 + n) / (1 + k)) / (2 * math.log(1 + n)) for k in rounded]
    assert np.allclose(weighted.idf_of(weighted.levels_of(df), n), expected, atol=1e-6)
    assert weighted.levels_of(np.array([2**31])) == 248


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5000):
        x = np.unique(rng.integers(0, 2**52, n).astype(np.uint64))
        assert (weighted._unpacked(weighted._packed(x)) == x).all()
    parts = weighted._parts(np.array([0, 2**51, 2**52 - 1], np.uint64), 2**31)
    assert parts.tolist() == [0, 2**30, 2**31 - 1]


def changed(text, every):
    ws = text.split()
    for i in range(every // 2, len(ws), every):
        ws[i] = "changed"
    return " ".join(ws)


def near():
    rows = messy()
    for s in range(6):
        text = prose(50 + s, 300)
        rows += [(500 + 10 * s, text), (501 + 10 * s, changed(text, 90)), (502 + 10 * s, changed(text, 12)), (503 + 10 * s, text.upper())]
    chain = prose(80, 400).split()
    rows += [(700 + i, " ".join(chain[10 * i : 10 * i + 200])) for i in range(6)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = near()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.selectExpr("*", "'x' as id", "'x' as a", "'x' as b", "'x' as class_id", "'x' as n")
    got = weighted.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)


def test_crowds_of_copies_and_near_copies(spark):
    text = prose(90, 120)
    rows = [(i, text) for i in range(400)] + [(1000 + i, f"{text} end {i}") for i in range(300)] + [(5000, prose(91, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in weighted.near_duplicates(docs).collect()}
    assert got.pop(5000) == 5000 and set(got.values()) == {0}


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    shingles = np.sort(rng.integers(0, 2**52, 60).astype(np.uint64))
    u, v = rng.uniform(0.5, 5, 60), rng.uniform(0.5, 5, 60)
    owner = np.zeros(60, np.int64)
    a = weighted.samples(shingles, u, owner, 1, 3000)[0]
    b = weighted.samples(shingles, v, owner, 1, 3000)[0]
    true = np.minimum(u, v).sum() / np.maximum(u, v).sum()
    assert abs((a == b).mean() - true) < 0.04


def test_open_links_within_and_between_blocks(spark):
    """Texts of one bucket in a chain, no two neighbours in a class: all blocks connect them, one link each."""
    words = prose(70, 400).split()
    rows = [(i, " ".join(words[6 * i : 6 * i + 150]), 150) for i in range(12)] + [(50, prose(71, 100), 100)]
    texts = spark.createDataFrame(
        [(i, t, n, bytearray(n - 4)) for i, t, n in rows], "id long, text string, n long, levels binary"
    )
    buckets = spark.createDataFrame([(0, 9, i) for i, _, _ in rows], "band int, value long, id long")
    classes = spark.createDataFrame([(3, 2), (2, 2)], "id long, component long")
    for block, block_words in ((1024, 400_000), (4, 400_000), (1, 400_000), (1024, 300)):
        got = [(r.a, r.b) for r in weighted.open_links(buckets, classes, texts, 13, 0.8, block, block_words).collect()]
        linked = {r.id: r.component for r in components(spark.createDataFrame([*got, (2, 3)], "a long, b long")).collect()}
        assert linked == {i: 0 for i in range(12)} and all(abs(a - b) < 4 for a, b in got)
        assert len(got) <= 13 * len(rows)


def test_a_varied_crowd_writes_no_pairs(spark):
    """600 texts of one origin, each changed at random: links are exact, and written rows stay few."""
    rng, origin = np.random.default_rng(5), prose(72, 150).split()
    rows = []
    for i in range(600):
        ws = list(origin)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            ws[at] = f"w{rng.integers(10**9)}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in weighted.near_duplicates(docs).collect()}
    want = exact(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(rows)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for ab in links for x in ab if x is not None and None not in ab}
    changed_any = True
    while changed_any:
        changed_any = False
        for a, b in links:
            if a is not None and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed_any = True
    assert got == parent


def test_empty_table(empty):
    assert weighted.near_duplicates(empty).count() == 0
