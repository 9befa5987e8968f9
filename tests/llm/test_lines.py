from collections import Counter

from wayfare.llm.lines import drop_frequent_lines

from .conftest import messy

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least):
    # Documents are ids; rows without an id are documents by their texts.
    holders = {(k, ("id", i) if i is not None else ("text", t)) for i, t in rows for k in map(key, (t or "").split("\n")) if k}
    found = Counter(k for k, _ in holders)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_equals_brute_force(documents):
    for least in (2, 10):
        got = drop_frequent_lines(documents, min_docs=least).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute(messy(), least)


def test_repeated_rows_are_one_document(spark):
    rows = [(500, "hello")] * 10 + [(None, "none")] * 10 + [(600, "other"), (600, "other two")] * 5
    rows += [(i, f"shared\nown {i}") for i in range(9)] + [(8, "shared")] * 3
    rows += [(100 + i, "Ten \n x") for i in range(9)] + [(None, "ten\nx")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = drop_frequent_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute(rows, 10)
    assert {r.text for r in got if r.doc_id == 500} == {"hello"} and {r.text for r in got if r.doc_id == 100} == {""}


def test_other_columns_and_empty_tables(clashing, empty):
    got = drop_frequent_lines(clashing)
    assert got.count() == clashing.count()
    assert got.filter("d = 'given' and a = 'given'").count() == clashing.count()
    assert dict(got.dtypes)["n_lines"] == "bigint"
    assert drop_frequent_lines(empty).count() == 0


def test_short_keys_stay_when_asked(spark):
    rows = [(i, "é\nab") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in drop_frequent_lines(docs, 3, min_chars=2).collect()} == {"é"}
