"""Scalar expressions against hand-made edge cases."""

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.functions import parse, text, vectors


def one(frame, values, expression, schema="c string"):
    df = frame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_lenient_cost(frame):
    given = ["HKD 150", "HKD 50-100", "$12.5", "HKD 1,200", "平民價", None, "HKD 10–60", ""]
    want = [150.0, 50.0, 12.5, 1.0, None, None, 10.0, None]
    assert one(frame, given, parse.lenient_cost("c")) == want


def test_strict_cost(frame):
    given = ["HKD 150", "HKD 50-100", "HKD 10–60", "150", "HKD $42", "HKD 50 lunch", None, "HKD"]
    want = [150.0, None, None, None, 42.0, None, None, None]
    assert one(frame, given, parse.strict_cost("c")) == want


def test_coordinates(frame):
    given = ["(22.3, 114.1)", "22.3, 114.1", "(22.3)", "(a, 1)", None, " ( -1 , 2 ) ", "(1,2,3)"]
    want = [(22.3, 114.1), (None, None), (None, None), (None, None), (None, None), (-1.0, 2.0)]
    got = one(frame, given, parse.coordinates("c"))
    assert [tuple(r) for r in got] == [*want, (None, None)]


def test_stable_id_is_uuid5(frame):
    rows = [
        ("Tsui Wah", "中西區"),
        ("small ring", "Brand#2"),
        ("　TSUI wah　", " 中西區 "),
        ("é", "ß"),
    ]
    got = [
        r[0]
        for r in frame(rows, "n string, d string").select(parse.stable_id("n", "d")).collect()
    ]
    want = [
        str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{n.strip().lower()}|{d.strip().lower()}"))
        for n, d in rows
    ]
    assert got == want
    assert got[0] == got[2] == "4033873a-3b72-55af-93b2-00516c59d615"
    assert got[1] == "15bf39cb-ee7f-555b-a700-6af2bfd09df8"


def test_char_grams(frame):
    got = one(frame, ["a", "ab", "A  b\n", None, ""], text.char_grams("c"))
    assert got[0] == [" a", "a ", " a "]
    assert got[1] == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert got[2] == [" a", "a ", " a ", " b", "b ", " b "]
    assert got[3] is None and got[4] == []


def test_exploded_grams_equal_the_array_form(frame):
    from wayfare.operators import tfidf

    rows = [(1, "dim sum 點心 a ab x"), (2, "一二三四五六七"), (3, "  ")]
    # Words around and beyond the length at which they are cut into stretches.
    letters = "abcdefgh點心茶飯"
    for n in (60, 61, 62, 63, 64, 65, 66, 125, 126, 127, 128, 129, 130, 131, 300):
        rows.append((n, "".join(letters[(i * i + i // 7) % len(letters)] for i in range(n))))
    df = frame(rows, "doc_id bigint, text string")
    want = df.select("doc_id", F.explode(text.char_grams("text")).alias("term"))
    want = {(r[0], r[1]): r[2] for r in want.groupBy("doc_id", "term").count().collect()}
    got = {(r[0], r[1]): r[2] for r in tfidf.term_counts(df, "char_wb").collect()}
    assert got == want


def test_tokens_keep_accents_and_scripts(frame):
    got = one(frame, ["Élan d'un_2 食nt飯!"], text.tokens("c"))
    assert got == [["élan", "d", "un_2", "食nt飯"]]


def test_query_text(frame):
    assert one(frame, ["noodles "], text.query_text("c", F.lit("北區"), F.lit(""))) == ["noodles  北區"]
    assert one(frame, [None], text.query_text("c")) == [""]


def test_captions(frame):
    cue = "00:00:01.000 --> 00:00:02.000"
    given = [
        f"WEBVTT\n\n{cue}\nhi",
        f"{cue} align:start\nhi\n\n  there ",
        "1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\n",
        None,
    ]
    assert one(frame, given, text.clean_captions("c")) == [
        "WEBVTT hi",
        f"{cue} align:start hi   there",
        "1 00:00:01,000 --> 00:00:02,000 hi",
        None,
    ]
    assert one(frame, given, text.clean_captions("c", strict=True)) == ["hi", "hi   there", "hi", None]


def test_json_lists(frame):
    given = [
        'Here: [ {"Name":"a"},\n{"Name":"b"} ] ok',
        '[{"Name":',
        "[]",
        "nothing",
        '[{"Name": "九龍", "Other": 1}]',
    ]
    got = one(frame, given, parse.json_list(parse.find_json_list("c")))
    assert [r["Name"] for r in got[0]] == ["a", "b"]
    assert got[1] is None and got[2] == [] and got[3] is None
    assert got[4][0]["Name"] == "九龍" and got[4][0]["Location"] is None


def test_url_parameter(frame):
    given = ["https://www.youtube.com/watch?v=abc&t=3", "https://example.org"]
    assert one(frame, given, text.url_parameter("c")) == ["abc", ""]


def test_fold_accents(frame):
    assert one(frame, [" Straße CAFÉ ", "茶", None], text.fold_accents("c")) == ["strae cafe", "", None]


def test_folding_holds_few_texts_as_python_strings():
    import tracemalloc

    texts = pa.array(["Crème brûlée, ﬁn " * 500, "plain " * 1000, None, "", "茶"] * 400)
    tracemalloc.start()
    got = text.folded(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == ["Creme brulee, fin " * 500, "plain " * 1000, None, "", ""] * 400
    # All texts are 6 MB.
    assert peak < 3_000_000
    assert text.folded(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    assert text.folded(pa.array([], pa.string())).to_pylist() == []



def test_snippet_cuts_before_replacing(frame):
    long = "a" * 99 + "\nbc"
    assert one(frame, [long, None], text.snippet("c")) == ["a" * 99 + " ", ""]


def test_sentence_does_not_rescan_values(frame):
    filled = text.sentence("{q} and {c}!", q=F.lit("{c}"), c=F.col("c"))
    assert one(frame, ["x", None], filled) == ["{c} and x!", "{c} and !"]


def test_vectors(frame):
    df = frame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.unit("a"), vectors.cosine("a", "b")).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[0][1] == pytest.approx(0.96)
    assert got[1][0] is None and got[1][1] is None


def test_random_id(frame):
    df = frame([(1,), (2,)], "c int").select(parse.random_id())
    ids = [r[0] for r in df.collect()]
    assert len(set(ids)) == 2 and all(uuid.UUID(i).version == 4 for i in ids)


def test_alias_tables_of_any_size_give_the_places_of_the_list(spark):
    import random

    from pyspark.sql import functions as F

    from wayfare.operators import gazetteer as g

    rng = random.Random(2)
    names = ["central", "central pier", "mong kok", "a", "st. john's", "c++", "new", "旺角", "中", "x-y", "角a", ""]
    aliases = [g.Alias(n, (n.upper(), "ALL"), whole_word=i < 7) for i, n in enumerate(names) if n]
    texts = [(i, "".join(rng.choice([*names, " ", " ", ".", "é", "Central", "New"]) for _ in range(12))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "Central Pier, St. John's / C++ 旺角A"), (103, "recentral")]
    df = spark.createDataFrame(texts, "id bigint, text string")
    want = {r["id"]: r["p"] for r in df.select("id", g.places("text", aliases).alias("p")).collect()}
    got = g.places_joined(df, "id", "text", g.alias_table(spark, aliases))
    assert {r["id"]: r["places"] for r in got.collect()} == want
    # Two shards, keys that repeat or are null, and columns of the names used inside.
    rows = [(1, "Mong Kok"), (1, "central"), (None, "旺角"), (None, "none"), (1, "Mong Kok")]
    own = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "'x' as ord", "'y' as alias", "1 as places")
    got = g.with_places(own, "text", g.alias_table(spark, aliases), shard_chars=20)
    want = own.select("id", "text", "ord", "alias", g.places("text", aliases).alias("places"))
    assert sorted(map(str, got.select("id", "text", "ord", "alias", "places").collect())) == sorted(map(str, want.collect()))
    many = spark.range(50_000).select(
        F.col("id").alias("ord"), F.concat(F.lit("place"), "id").alias("alias"),
        F.array(F.col("id").cast("string")).alias("targets"), F.lit(True).alias("whole_word"),
    )
    asked = spark.createDataFrame([(1, "from place7 to Place49999"), (2, "place")], "id bigint, text string")
    found = {r["id"]: r["places"] for r in g.places_joined(asked, "id", "text", many).collect()}
    assert found == {1: ["7", "49999"], 2: []}
