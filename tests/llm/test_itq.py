import numpy as np

from wayfare.llm.itq import linked_vectors


def brute(rows, threshold=0.93):
    good = [
        (i, v, lab) for i, v, lab in rows
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    parent, links = {}, []
    for k, (i, v, lab) in enumerate(good):
        n = 0
        for j, (o, w, other) in enumerate(good):
            if j != k and other == lab and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold or v == w:
                    n += 1
                    parent.setdefault(i, set()).add(o)
        links.append((i, n))

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = parent.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return min(seen)

    out = [(i, n, reach(i)) for i, n in links]
    bad = [i for i, v, lab in rows if (i, v, lab) not in good]
    return sorted((out + [(i, 0, i) for i in bad]), key=str)


def rows_of(seed=1, n=150, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.standard_normal(dims) * rng.choice([0.02, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], i % 12 % 3))
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * dims, 1), (302, rows[1][1], None), (303, [float("nan")] + [1.0] * 15, 1)]
    rows += [(304, [None] + [1.0] * 15, 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (None, rows[2][1], 2)]
    rows += [(308, [float("inf")] + [1.0] * 15, 1), (5, rows[5][1], rows[5][2])]
    return rows


def test_links_equal_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for block in (1024, 8):  # blocks change the work, never the result
        got = linked_vectors(df, block=block).collect()
        found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)
        expected = brute(rows)
        links = sum(n for _, n, _ in expected)
        assert len(found) == len(expected) and links
        assert sum(n for _, n, _ in found) >= 0.97 * links  # recall; none beyond
        assert all(a[1] <= b[1] for a, b in zip(found, expected, strict=True))
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_crowd_of_copies_and_clashing_names(spark):
    rows = [(i, [1.0, 0.5, 0.25], 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "'x' as id", "'x' as keys", "'x' as n_links")
    got = linked_vectors(df).collect()
    assert {r.n_links for r in got} == {2999} and {r.component_id for r in got} == {0}


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert linked_vectors(none).count() == 0
