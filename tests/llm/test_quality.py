import numpy as np
from pyspark.sql import functions as F

from wayfare.llm import quality

from .conftest import prose


def table(spark, n=240):
    docs = [(i, prose(i, 60) if i % 3 else " | ".join(prose(i, 60).upper().split())) for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark)
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).withColumn("held", quality.held_out()).collect()
    held = [r for r in rows if r.held]
    assert 20 < len(held) < 90
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(r.held == quality.is_held_out(r.doc_id) for r in rows)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark)
    flipped = labels.withColumn(
        "quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_odd_rows_are_scored(documents, clashing, empty, spark):
    docs, labels = table(spark)
    model = quality.fit(docs, labels)
    for given in (documents, clashing):
        got = quality.score(given, model).collect()
        assert len(got) == given.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0


def test_without_labels_every_score_is_one_half(spark, documents, empty):
    _, labels = table(spark)
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        got = quality.score(documents, quality.fit(documents, none)).collect()
        assert {round(r.score, 6) for r in got} == {0.5}
    assert quality.fit(empty, labels).weights[-1] == 0.0


def test_one_repeated_document_does_not_crowd_out_the_sample(spark):
    docs, labels = table(spark)
    copied = docs.filter("doc_id = 3").crossJoin(spark.range(3000).select(F.col("id").alias("n")))
    same = copied.select("doc_id", "text").coalesce(1).unionByName(docs)
    plain = quality.fit(docs, labels, sample_rows=100)
    assert quality.fit(same, labels, sample_rows=100) == plain and any(plain.weights[:3])
    # Other texts of that id: both classes stay, and the order of rows does not matter.
    other = copied.select("doc_id", F.concat("text", F.lit(" "), "n").alias("text")).coalesce(1).unionByName(docs)
    model = quality.fit(other, labels, sample_rows=100)
    assert any(model.weights[:3]) and quality.fit(other.repartition(7, "text"), labels, sample_rows=100) == model
