import pytest

from wayfare.functions.places_hk import CHINESE, ENGLISH, HONG_KONG
from wayfare.operators import curate, extract
from wayfare.operators.gazetteer import places
from wayfare.operators.grouping import spread_join, top_k
from wayfare.schema import EXTRACTED_FIELDS, VENUE_REQUIRED, require_columns
from pyspark.sql import functions as F


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="unique_tips"):
        require_columns([c for c in VENUE_REQUIRED if c != "unique_tips"], VENUE_REQUIRED)


def test_venue_columns_rename_and_fill(frame):
    headers = ["店名", "所在區", "餐廳亮點", "推薦原因", "獨門貼士"]
    headers += [f"消費預算—{m}（HKD/人）" for m in ("早餐", "午餐", "晚餐")]
    df = frame([tuple("x" for _ in headers)], ", ".join(f"`{h}` string" for h in headers))
    out = curate.venue_columns(df)
    assert {"name", "district", "cost_estimate_dinner", "coordinates"} <= set(out.columns)
    with pytest.raises(ValueError, match="name"):
        curate.venue_columns(df.drop("店名"))


def test_dedup_keeps_last_and_sets_nulls_apart(frame):
    rows = [(0, "Tsui Wah "), (1, "Other"), (2, "tsui wah"), (3, None), (4, None)]
    kept, bad = curate.dedup_keep_last(frame(rows, "ord bigint, name string"))
    assert sorted(r["ord"] for r in kept.collect()) == [1, 2]
    assert sorted(r["ord"] for r in bad.collect()) == [3, 4]


def test_token_bounds(frame):
    rows = [
        (n, "name", "place", " ".join(["w"] * n), "a b c", "HKD 50", "x y") for n in (4, 5, 100, 101)
    ]
    df = frame(rows, "ord int, " + ", ".join(f"`{f}` string" for f in EXTRACTED_FIELDS))
    kept, bad = curate.split_valid(df)
    assert sorted(r["ord"] for r in kept.collect()) == [5, 100]
    assert {r["ord"]: r["reasons"] for r in bad.collect()} == {
        4: ["Description/Highlights too short: 4 tokens (min 5)"],
        101: ["Description/Highlights too long: 101 tokens (max 100)"],
    }


def test_record_payload_source(frame):
    schema = ", ".join(f"`{f}` string" for f in EXTRACTED_FIELDS)
    row = ("a", "b", "c", "d", " HKD 42 ", "e")
    assert curate.record_payload(frame([row], schema)).first()["Source"] == "Unknown"
    got = curate.record_payload(frame([(*row, "tv")], schema + ", Source string")).first()
    assert got["Source"] == "tv" and got["Parsed Cost"] == 42.0 and got["Cost Estimate"] == "HKD 42"


def test_place_lookup(frame):
    asked = [
        "kowloon bay cafe",
        "九龍灣",
        "paint",
        "Central and Sheung Wan",
        "no place",
        None,
        "食nt飯",
    ]
    got = [
        r[0] for r in frame([(a,) for a in asked], "q string").select(places("q", HONG_KONG)).collect()
    ]
    kowloon = ENGLISH["kowloon"]
    assert got == [kowloon, kowloon, [], ["中西區"], [], [], []]
    assert len(ENGLISH) == 70 and len(CHINESE) == 66


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = top_k(df, "g", [F.col("v").desc()], 1500).groupBy("g").agg(F.count("v"), F.min("v"))
    assert sorted(map(tuple, got.collect())) == [(0, 1500, 2000), (1, 1500, 2001)]


def test_spread_join_splits_a_hot_key(spark):
    rows = spark.range(900).select(
        "id", F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    dims = rows.groupBy("k").agg(F.count("id").alias("n")).withColumn("v", F.length("k"))
    got = spread_join(rows, dims, "k", "id", "n", hot_rows=20)
    assert got.count() == 900 and got.select("id").distinct().count() == 900


def test_watch_ids_limit_before_the_url_test(frame):
    rows = [(i, f"https://www.youtube.com/watch?v=v{i}&x=1" if i % 2 else "https://o.org") for i in range(40)]
    got = extract.watch_ids(frame(rows, "ord bigint, url string"), "ord").collect()
    assert [r["video_id"] for r in got] == [f"v{i}" for i in range(1, 20, 2)]
