import re
from collections import Counter

import pytest

from wayfare.llm.decontam import contaminated

from .conftest import messy, prose


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    windows = set()
    for item, text in items:
        ws = cut(text)
        if ws:
            n = min(window, len(ws))
            windows |= {("" if item is None else str(item), tuple(ws[i : i + n])) for i in range(len(ws) - n + 1)}
    lengths = {len(w) for _, w in windows}
    by_words: dict[tuple, set] = {}
    for item, w in windows:
        by_words.setdefault(w, set()).add(item)
    out = []
    for i, text in rows:
        ws, hit, found = cut(text), set(), set()
        for n in lengths:
            for p in range(len(ws) - n + 1):
                if items_here := by_words.get(tuple(ws[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= items_here
        out.append((i, len(ws), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(out)


ITEMS = [
    (1, prose(1, 60)), (2, prose(11, 200)[200:400]), (10, "WORD"), (3, "Shared line É of"), (4, "a a a a a a a a a a a a"),
    (5, None), (6, ""), (7, "x x x x x x x x x x x x"), (7, prose(12, 30)), (None, "日本語 Ünïcode"), (8, "... !!"), (9, prose(7, 30)),
    (9, prose(7, 30)),
]


@pytest.mark.parametrize("bound", [64 << 20, 0])  # broadcast windows, shuffled words
def test_equals_brute_force(spark, documents, clashing, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as w", "'x' as item")
    for docs in (documents, clashing):
        got = contaminated(docs, items, broadcast_bytes=bound).collect()
        rows = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got)
        assert rows == brute(messy(), ITEMS)


def test_empty_tables(spark, documents, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(documents, none).filter("contaminated or n_hit > 0").count() == 0
    assert contaminated(empty, spark.createDataFrame(ITEMS, none.schema)).count() == 0


def test_plan_has_no_python(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contaminated(documents, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
