import json

import pytest
from pyspark.sql import functions as F

from checks import inputs
from wayfare.operators import context, curate, encode
from wayfare.plans import ingest, retrieve
from wayfare.schema import VENUE_HEADERS, VOCABULARY
from wayfare.sources import files, store
from wayfare.streaming.history import stream_history
from wayfare.streaming.ingest import stream_points

SF = "/root/testdata/sf0.001"


def test_upsert_twice_is_once_and_last_wins(spark, tmp_path):
    root = str(tmp_path / "points")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    b = spark.createDataFrame([("y", 3, 0), ("y", 4, 1), ("z", 5, 0)], "id string, v int, ord int")
    assert store.read(spark, root) is None
    assert store.upsert(root, a) == 0
    assert store.upsert(root, b, order="ord") == 1
    want = [("x", 1), ("y", 4), ("z", 5)]
    assert sorted(map(tuple, store.read(spark, root).collect())) == want
    assert store.upsert(root, b, order="ord", version=1) == 1
    assert sorted(map(tuple, store.read(spark, root).collect())) == want
    assert store.upsert(root, b, order="ord") == 2
    assert sorted(map(tuple, store.read(spark, root).collect())) == want
    assert store.versions(spark, root) == [0, 1, 2]


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = tmp_path / "points"
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v"))
    store.upsert(str(root), rows, buckets=32)
    before = _files(root / "rows")
    sent = spark.createDataFrame([("17", 1), ("new", 1)], "id string, v int")
    touched = {f"bucket={r[0]}" for r in sent.select(store.bucket_of("id", 32)).collect()}
    assert store.upsert(str(root), sent, buckets=32) == 1
    after = _files(root / "rows")
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in after if f not in before} == touched
    got = {r["id"]: r["v"] for r in store.read(spark, str(root)).collect()}
    assert len(got) == 2001 and {i for i, v in got.items() if v} == {"17", "new"}
    # A replay touches no file at all, nor does an empty batch.
    assert store.upsert(str(root), sent, version=1, buckets=32) == 1 and _files(root / "rows") == after
    assert store.upsert(str(root), sent.limit(0), buckets=32) == 2 and _files(root / "rows") == after
    with pytest.raises(Exception, match="another number of buckets"):
        store.upsert(str(root), rows, buckets=31)


@pytest.mark.parametrize("lost", [[], ["bucket"], ["noted"]])
def test_a_batch_that_broke_off_is_finished(spark, tmp_path, monkeypatch, lost):
    """Merged but not replaced, replaced in part with files already gone, or replaced but not noted."""
    root = tmp_path / "points"
    first = spark.range(200).select("id", F.lit(0).alias("v"))
    second = spark.range(100, 300).select("id", F.lit(1).alias("v"))
    store.upsert(str(root), first, buckets=4)

    def stop(spark, root, version, sort_by):
        raise OSError("lost")

    publish, note = store._publish, store._note
    monkeypatch.setattr(store, *(("_note", stop) if lost == ["noted"] else ("_publish", stop)))
    with pytest.raises((OSError, TypeError)):
        store.upsert(str(root), second, version=1, buckets=4)
    monkeypatch.setattr(store, "_publish", publish)
    monkeypatch.setattr(store, "_note", note)
    if lost == ["bucket"]:
        import shutil

        shutil.rmtree(root / "rows" / "bucket=1")
    assert store.versions(spark, str(root)) == [0]
    # Another batch, not the same one, comes next: the one that broke off is finished first.
    third = spark.createDataFrame([(0, 2)], "id long, v int")
    assert store.upsert(str(root), third, buckets=4) == 2
    got = sorted(map(tuple, store.read(spark, str(root)).collect()))
    assert got == [(0, 2)] + [(i, 0) for i in range(1, 100)] + [(i, 1) for i in range(100, 300)]
    assert store.versions(spark, str(root)) == [0, 1, 2] and not list((root / "pending").glob("*"))


def test_a_new_column_is_null_in_untouched_buckets(spark, tmp_path):
    root = str(tmp_path / "points")
    store.upsert(root, spark.range(50).select("id", F.lit(0).alias("v")), buckets=8)
    store.upsert(root, spark.createDataFrame([(3, 1, "x")], "id long, v int, w string"), buckets=8)
    got = {r["id"]: (r["v"], r["w"]) for r in store.read(spark, root).collect()}
    assert len(got) == 50 and got[3] == (1, "x") and set(got.values()) == {(1, "x"), (0, None)}


def test_ingest_again_keeps_one_copy_of_rejects(spark, tmp_path):
    root = str(tmp_path / "p")
    for _ in range(2):
        ingest.ingest(_venues(spark), root, str(tmp_path / "m"), version=0)
    assert spark.read.parquet(f"{root}_rejects").count() == 1 and store.read(spark, root).count() == 3


def test_create_keeps_and_recreates(spark, tmp_path):
    root = str(tmp_path / "t")
    store.create(spark, root, VOCABULARY)
    row = spark.createDataFrame([("a", 0, 1, 1, 1.0)], VOCABULARY)
    store.upsert(root, row, key="term")
    store.create(spark, root, VOCABULARY)
    assert store.read(spark, root).count() == 1
    store.create(spark, root, VOCABULARY, recreate=True)
    assert store.read(spark, root).count() == 0
    assert store.read(spark, root).schema == VOCABULARY


def test_csv_with_spreadsheet_headers(spark, tmp_path):
    heads = list(VENUE_HEADERS)
    lines = [",".join(f'"{h}"' for h in heads)]
    lines += [",".join(f'"{n}{i}"' for i in range(len(heads))) for n in ("甲", "乙\n")]
    path = tmp_path / "v.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    got = files.read_venues(spark, str(path), multi_line=True).orderBy("ord").collect()
    assert [r["name"] for r in got] == ["甲0", "乙\n0"] and got[0]["ord"] < got[1]["ord"]
    (tmp_path / "bad.csv").write_text("店名\nx", encoding="utf-8")
    with pytest.raises(ValueError, match="所在區"):
        files.read_venues(spark, str(tmp_path / "bad.csv"))


def test_json_arrays_and_sink_keep_chinese(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        json.dumps([{"Name": "茶"}, {"Name": "b", "Location": "北區"}], ensure_ascii=False, indent=2),
        encoding="utf-8",
    )
    df = files.read_records(spark, str(tmp_path / "in.json"))
    assert df.count() == 2
    files.write_json(df.coalesce(1), str(tmp_path / "out"))
    written = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "茶" in written and "北區" in written
    files.write_rejects(df, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_caption_files_are_keyed_by_path(spark, tmp_path):
    cue = "00:00:01.000 --> 00:00:02.000"
    (tmp_path / "a.vtt").write_text(f"WEBVTT\n\n{cue}\nhi\n{cue}\n茶", encoding="utf-8")
    (tmp_path / "b.srt").write_text("1\nyo", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    got = {r["path"][-5:]: r["transcript"] for r in files.read_captions(spark, str(tmp_path)).collect()}
    assert got == {"a.vtt": "WEBVTT hi 茶", "b.srt": "1 yo"}


def test_literal_list_and_vectors_on_disk(spark, tmp_path):
    asked = files.literal_rows(spark, ["屯門印度菜", "cozy cafe Central"])
    assert [r["text"] for r in asked.orderBy("ord").collect()] == ["屯門印度菜", "cozy cafe Central"]
    v = spark.createDataFrame([(1, [0.5, 0.25])], "id bigint, embedding array<float>")
    v.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.schema["embedding"].dataType == v.schema["embedding"].dataType
    assert back.first()["embedding"] == [0.5, 0.25]


def _venues(spark):
    rows = [
        ("Tsui Wah", "港式", "中西區", "Wellington Street", "(22.28, 114.15)", "milk tea, curry"),
        ("tsui wah ", "港式", "中西區", "Wellington Street 2", "(22.28, 114.15)", "milk tea, curry beef"),
        ("Spice", "印度菜", "屯門區", "Tuen Mun Road", None, "curry house 印度菜"),
        ("Sea", "海鮮", "深水埗區", "Apliu Street", None, "seafood dinner 海鮮 印度菜 curry"),
        (None, "x", "北區", None, None, "nameless"),
    ]
    cols = "name string, cuisine string, district string, address string, coordinates string, description_highlights string"
    df = spark.createDataFrame(rows, cols).coalesce(1)
    more = ["why_recommended", "unique_tips"] + [f"cost_estimate_{m}" for m in ("breakfast", "lunch", "dinner")]
    return files.with_input_order(df.withColumns({c: F.lit("HKD 50-80") for c in more}))


def test_ingest_then_search(spark, tmp_path):
    root, model = str(tmp_path / "points"), str(tmp_path / "model")
    venues = _venues(spark)
    ingest.ingest(venues, root, model, encoder=lambda d: encode.hashed_vectors(d, 64), rejects=str(tmp_path / "r"))
    points = store.read(spark, root)
    assert points.count() == 3 and spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert points.filter("name = 'tsui wah '").first()["parsed_cost_lunch"] == 50.0
    terms = store.load_model(spark, model)
    before = terms.count()
    ingest.ingest(venues.filter("name = 'Sea'"), root, model, encoder=lambda d: encode.hashed_vectors(d, 64))
    assert store.load_model(spark, model).count() == before and store.read(spark, root).count() == 3
    asked = spark.createDataFrame([(1, "屯門印度菜"), (2, "curry"), (3, "zzz")], "query_id bigint, text string")
    got = retrieve.search_venues(store.read(spark, root), asked, terms, k=2).collect()
    first = {r["query_id"]: r["name"] for r in got if r["rank"] == 1}
    assert first[1] == "Spice" and {r["district"] for r in got if r["query_id"] == 1} == {"屯門區"}
    assert 3 not in first
    points = store.read(spark, root)  # as the second batch left it
    for vocabulary in (terms, None):
        both = retrieve.search_venues(
            points, asked, vocabulary, k=2, encoder=lambda d: encode.hashed_vectors(d, 64)
        )
        names = {r["name"] for r in both.collect() if r["query_id"] == 1}
        assert names == {"Spice"}
    assert store.load_model(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        retrieve.search_venues(points, asked, None)


def test_record_points(spark):
    from wayfare.operators.curate import record_text
    from wayfare.schema import EXTRACTED_FIELDS

    rows = [(i, f"n{i}", "Central", "a b c d e", "good and cheap", "HKD 50", "go early") for i in range(3)]
    rows.append((9, "bad", "Central", "too short", "x", "", ""))
    df = spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"`{f}` string" for f in EXTRACTED_FIELDS))
    texts = df.select(F.col("ord").alias("doc_id"), record_text().alias("text"))
    good, bad = ingest.record_points(df, ingest.fit(texts, **ingest.RECORD_MODEL))
    got = good.collect()
    assert len({r["id"] for r in got}) == 3 and all(r["sparse"]["indices"] for r in got)
    assert [len(r["reasons"]) for r in bad.collect()] == [4]


def test_stream_equals_batch(spark, tmp_path):
    """Venues of the part table in three files, with ids sent again across files."""
    venues = inputs.venues(spark, SF)
    folder = tmp_path / "in"
    for i, low in enumerate((0, 40, 80)):
        part = venues.filter(F.col("ord").between(low, low + 119))
        part = part.withColumn("source_title", F.lit(f"file {i}"))
        part.coalesce(1).write.mode("append").parquet(str(folder / f"b={i}"))
    texts = ingest.index_texts(venues)
    terms = ingest.fit(texts, **ingest.VENUE_MODEL)
    schema = venues.schema
    for batch in range(3):
        # One new folder per run, so the order of batches is fixed.
        incoming = spark.readStream.schema(schema).parquet(str(folder / f"b={batch}"))
        query = stream_points(
            incoming, terms, str(tmp_path / "points"), str(tmp_path / f"c{batch}"),
            first_version=batch + 1, keys=("name", "district"),
        )
        query.awaitTermination()
    streamed = store.read(spark, str(tmp_path / "points"))
    sent = None
    for i, low in enumerate((0, 40, 80)):
        part = venues.filter(F.col("ord").between(low, low + 119))
        part = part.withColumn("source_title", F.lit(f"file {i}")).withColumn("ord", F.col("ord") + i * 1000)
        sent = part if sent is None else sent.unionByName(part)
    kept, _ = curate.dedup_keep_last(sent, ("name", "district"))
    want = ingest.points(kept.drop("ord"), terms)
    columns = ["id", "name", "source_title", "latitude", "sparse.indices"]
    assert sorted(map(str, streamed.select(*columns).collect())) == sorted(
        map(str, want.select(*columns).collect())
    )


def _run_history(spark, folder, checkpoint, seen, schema, **options):
    """Run the stream over what is new in ``folder``; the rows of state that are left, by operator."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = stream_history(spark.readStream.schema(schema).parquet(folder), **options)
    query = (
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]


def test_history_stream_equals_batch(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    folder = str(tmp_path / "turns")
    # Of an earlier block than the turns that came last: late is judged by conversation.
    late = turns.filter("turn = 0").limit(1).withColumn("text", F.lit("too late"))
    seen = []
    for part in (turns.filter("turn <= 1"), turns.filter("turn > 1").unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(folder)
        _run_history(spark, folder, str(tmp_path / "checkpoint"), seen, turns.schema, block=3)
    streamed = {(r["conv_id"], r["turn"]): r["messages"] for r in seen if not r["late"]}
    batch = {(r["conv_id"], r["turn"]): r["messages"] for r in context.history(turns, 3).collect()}
    assert streamed == batch
    assert [r["text"] for r in seen if r["late"]] == ["too late"]


def test_history_state_shrinks(spark, tmp_path):
    folder, schema = str(tmp_path / "turns"), "conv_id bigint, turn bigint, role string, text string"
    batches = [
        [(c, t, "user", f"{c}.{t}") for c in range(20) for t in range(5)],  # a full block of four and an open one
        [(99, 0, "user", "x"), (None, 0, "user", "x"), (1, None, "user", "x")],
    ]
    seen, left = [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.createDataFrame([], schema).schema
        left.append(_run_history(spark, folder, str(tmp_path / "checkpoint"), seen, stream, block=4, idle_ms=1))
    # Full blocks keep nothing; by the second batch all twenty conversations are idle and dropped.
    assert [sorted(n) for n in left] == [[20, 20], [1, 1]]
    assert len(seen) == 101 and not any(r["late"] for r in seen)


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,district,cuisine\nx,east,old\n", encoding="utf-8")
    rows = "\n".join(f"{c},n{c},west" for c in range(3000))
    (tmp_path / "b.csv").write_text(f"cuisine,name,district\n{rows}\nnew,x,north\n", encoding="utf-8")
    got = files.read_table(spark, str(tmp_path), ordered=True)
    kept, _ = curate.dedup_keep_last(got, ("name",))
    assert kept.count() == 3001
    last = kept.filter("name = 'x'").first()
    assert (last["district"], last["cuisine"]) == ("north", "new")
    first = got.orderBy("ord").first()
    assert (first["name"], first["district"], first["cuisine"]) == ("x", "east", "old")


def test_csv_headers_take_the_first_bytes(spark, tmp_path):
    import gzip

    folder = tmp_path / "with blanks"
    folder.mkdir()
    long = ",".join(f"c{i}" for i in range(20_000))
    (folder / "a.csv").write_text('\ufeff"na\nme","dis,trict"\n"x","east"\n', encoding="utf-8")
    (folder / "b.csv").write_bytes(b"")
    (folder / "c.csv").write_text("district", encoding="utf-8")
    with gzip.open(folder / "d.csv.gz", "wt", encoding="utf-8") as f:
        f.write("區,name\nwest,y\n")
    heads = files._csv_files(spark, str(folder))
    assert list(heads) == [("na\nme", "dis,trict"), ("district",), ("區", "name")] or () in heads
    got = files.read_table(spark, str(folder / "d.csv.gz"))
    assert [tuple(r) for r in got.collect()] == [("west", "y")]
    (tmp_path / "long.csv").write_text(f"{long}\n", encoding="utf-8")
    assert [len(h) for h in files._csv_files(spark, str(tmp_path / "long.csv"))] == [20_000]
    one = files.read_table(spark, str(folder / "a.csv"), multi_line=True)
    assert one.columns == ["na\nme", "dis,trict"] and tuple(one.first()) == ("x", "east")


def test_stream_keeps_rejects_and_keys_of_the_batch(spark, tmp_path):
    names = [("a", "east"), ("a", "west"), (None, "north")]
    from wayfare.schema import VENUE

    df = spark.createDataFrame(names, "name string, district string")
    more = [f.name for f in VENUE if f.name not in ("name", "district")]
    df = files.with_input_order(df.coalesce(1).withColumns({c: F.lit("HKD 50-80") for c in more}))
    terms = ingest.fit(ingest.index_texts(df), **ingest.VENUE_MODEL)
    df.write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_points(incoming, terms, str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    assert [(r["name"], r["district"]) for r in store.read(spark, str(tmp_path / "p")).collect()] == [("a", "west")]
    bad = spark.read.parquet(str(tmp_path / "p_rejects"))
    assert [r["district"] for r in bad.collect()] == ["north"]


def test_history_stream_reads_a_folder_of_files(spark, tmp_path):
    from checks.queries import QUERIES

    schema = "conv_id bigint, turn bigint, role string, text string"
    turns = spark.createDataFrame([(c, t, "user", f"{c}.{t}") for c in range(30) for t in range(6)], schema)
    turns.repartition(3, "conv_id").write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    got = QUERIES["stream_history"](spark, str(tmp_path / "many"))
    want = QUERIES["history_prefix"](spark, str(tmp_path / "many"))
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))
