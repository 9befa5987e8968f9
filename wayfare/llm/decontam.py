"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ten words. A document can hold a window only if it holds all its words, so
one word of each window is enough to find candidates: the rarest over all documents, its prefix.
Document words join the windows on that word, bounds on the position and the length leave one
place where the window could lie, and the words there are compared exactly.

Windows are broadcast when their measured size is under a bound; beyond it words are shuffled with
their neighbours. Only verified hits are shuffled back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import ascii_lower, staged

WINDOW = 10
# Fixed value: what stands between words, which are runs of letters, digits and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NULL_ID = -(2**63)


def words(text: Column) -> Column:
    """Lower-cased words. Splitting costs half of matching, and most words are of single bytes."""
    cut = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    return F.array_remove(F.transform(cut, ascii_lower), "")


def row_keys() -> tuple[Column, Column]:
    """d and th, which stand for a row's id and text and are never null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), F.xxhash64("text")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, w) of every distinct window: ``window`` consecutive words, or all words of a shorter item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")
    ).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    cut = F.explode(F.transform(starts, lambda i: F.slice("ws", i, window)))
    return items.select("item", cut.alias("w")).distinct()


def _rarities(tokens: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(word, n): occurrences over all documents of every word of the windows."""
    side = F.broadcast(vocabulary) if small else vocabulary
    counted = tokens.join(side, "word", "left_semi").groupBy("word").count()
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, d, th) of every row of ``docs``.

    d and th are the ``row_keys`` of the row.
    n_hit counts words inside any occurrence of a window, items is the sorted array of the ids, as strings, of
    items with occurring windows. Null and empty texts have no words; items without words have no
    windows; a null item_id counts as ''. Benchmark rows that share an item_id are one item. Every
    row of ``docs`` gives one row: rows equal in id and text get equal results, ids may repeat or be null. An
    empty table on either side gives no hits. Other columns are ignored.
    """
    keys = [key.alias(name) for key, name in zip(row_keys(), ("d", "th"))]
    windows = staged(item_windows(benchmark, window), "windows")
    size = windows.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 16 * F.size("w") + 100)).first()[0] or 0
    small = size <= broadcast_bytes

    # Texts are cut into words once; both passes over the words read these.
    worded = staged(docs.select("doc_id", *keys, words(F.col("text")).alias("ws")), "words")
    tokens = worded.select(F.explode("ws").alias("word"))
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    rare = staged(_rarities(tokens, vocabulary, small), "rarities")
    # The prefix: the rarest word of the window, the first by name among equals, where it first stands.
    placed = windows.select("item", "w", F.explode(F.array_distinct("w")).alias("word")).join(rare, "word")
    prefix = placed.groupBy("item", "w").agg(F.min(F.struct("n", "word")).alias("p"))
    prefix = prefix.select("item", "w", F.col("p.word").alias("word"))
    prefix = staged(prefix.withColumn("before", F.array_position("w", F.col("word")) - 1), "prefixes")

    found = worded.select("d", "th", "ws", F.posexplode("ws").alias("at", "word"))
    if small:
        found = found.withColumnRenamed("ws", "near").withColumn("skip", F.lit(0))
        joined = found.join(F.broadcast(prefix), "word")
    else:
        skip = F.greatest(F.col("at") - window + 1, F.lit(0))
        near = F.slice("ws", skip + 1, 2 * window)
        found = found.select("d", "th", near.alias("near"), (F.col("at") - skip).alias("at"), "word", skip.alias("skip"))
        joined = found.join(prefix, "word")
    start = F.col("at") - F.col("before")
    fits = (start >= 0) & (start + F.size("w") <= F.size("near"))
    same = F.slice("near", (start + 1).cast("int"), F.size("w")) == F.col("w")
    hits = joined.filter(F.when(fits, same).otherwise(F.lit(False))).select(
        "d", "th", "item", (start + F.col("skip")).cast("int").alias("start"), F.size("w").alias("n")
    )
    per_doc = hits.groupBy("d", "th").agg(
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # Union of the spans: each adds what lies beyond the end so far.
    empty = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def extend(a: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        more = F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))
        return F.struct((a["hit"] + more).alias("hit"), F.greatest(a["end"], end).alias("end"))

    covered = F.aggregate("spans", empty, extend)["hit"]
    per_doc = per_doc.select("d", "th", covered.alias("hit"), "items")
    counts = worded.select("doc_id", "d", "th", F.size("ws").cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return counts.join(per_doc, ["d", "th"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
        "d",
        "th",
    )
