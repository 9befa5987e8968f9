import re
from collections import Counter

from wayfare.llm.debruijn import drop_repeated_spans

from .conftest import messy, prose


def brute(rows, window):
    """Every window against all earlier ones; equal rows are one document."""
    words = {(i is not None, i or 0, t or ""): re.findall(r"[^ \t-\r]+", t or "") for i, t in rows}
    first: dict[tuple, tuple] = {}
    for doc, ws in words.items():
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p : p + window])
            first[w] = min(first.get(w, (doc[:2], p)), (doc[:2], p))
    out = {}
    for doc, ws in words.items():
        keep = [True] * len(ws)
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (doc[:2], p):
                keep[p : p + window] = [False] * window
        out[doc] = (" ".join(w for w, k in zip(ws, keep) if k), len(ws), keep.count(False))
    return Counter(((i, *out[i is not None, i or 0, t or ""])) for i, t in rows)


def results(df):
    return Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect())


def test_equals_brute_force(documents, clashing):
    expected = brute(messy(), 20)
    assert results(drop_repeated_spans(documents)) == expected
    got = drop_repeated_spans(clashing)
    assert results(got) == expected and got.filter("d = 'given' and th = 'given'").count() == clashing.count()


def test_unique_ids_branches_and_self_repeats(spark):
    a, b, c, d = (prose(s, 40) for s in range(4))
    rows = [
        (1, f"{a} {b}"), (2, f"{a} {c}"), (3, f"{b} {c} {a}"), (4, f"{c[:80]} {d} {d}"), (5, "w " * 90),
        (6, "v w " * 60), (7, a), (8, a), (9, prose(5, 19)), (10, prose(5, 19)), (11, prose(6, 20)), (12, prose(6, 20)),
        (13, None), (14, ""), (15, f"{b}\n{d}\t{a}"), (16, " ".join(prose(7, 30).split()[5:]) + " " + d), (17, prose(7, 30)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (3, 8, 20):
        assert results(drop_repeated_spans(docs, window)) == brute(rows, window), window


def test_empty_table(empty):
    assert drop_repeated_spans(empty).count() == 0
