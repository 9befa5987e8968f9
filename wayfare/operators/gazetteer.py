"""Places named in a text.

A short, fixed alias list becomes one narrow projection: every alias is a literal test inside the
scan, without a join or a shuffle. A gazetteer of any size is a table, whose shards become
automata that read each text once where it lies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Alias:
    """``whole_word`` aliases match the lower-cased text at word borders, others as substring."""

    text: str
    targets: tuple[str, ...]
    whole_word: bool = True


def _java_quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _hit(c: Column, lowered: Column, alias: Alias) -> Column:
    if not alias.whole_word:
        return F.contains(c, F.lit(alias.text))
    # The substring test is cheap and spares most rows the border check.
    pattern = rf"(?U)\b{_java_quote(alias.text)}\b"
    return F.contains(lowered, F.lit(alias.text)) & lowered.rlike(pattern)


def places(c, aliases: list[Alias]) -> Column:
    """Distinct targets of all matching aliases, in the order first met along the list.

    There is no longest-match rule: a longer name also hits the shorter ones inside it. Made for
    lists of a few hundred names; ``places_joined`` takes larger ones.
    """
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    lowered = F.lower(c)
    none = F.array().cast("array<string>")
    found = [
        F.when(_hit(c, lowered, a), F.array(*[F.lit(t) for t in a.targets])).otherwise(none)
        for a in aliases
    ]
    return F.array_distinct(F.flatten(F.array(*found))) if found else none


def alias_list(english: dict[str, list[str]], chinese: dict[str, list[str]]) -> list[Alias]:
    """One list from two dictionaries: all English aliases first, each in its own order."""
    out = [Alias(a, tuple(t)) for a, t in english.items()]
    return out + [Alias(a, tuple(t), whole_word=False) for a, t in chinese.items()]


def alias_table(spark: SparkSession, aliases: list[Alias]) -> DataFrame:
    """(ord, alias, targets, whole_word) of a list."""
    rows = [(i, a.text, list(a.targets), a.whole_word) for i, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "ord bigint, alias string, targets array<string>, whole_word boolean")


def _shards(aliases: DataFrame, shard_chars: int) -> list[DataFrame]:
    """The alias table in parts of about ``shard_chars`` characters each."""
    chars = aliases.agg(F.sum(F.length("alias"))).first()[0] or 0
    count = max(1, -(-chars // shard_chars))
    part = F.pmod(F.xxhash64("ord", "alias"), F.lit(count))
    return [aliases.filter(part == i) for i in range(count)]


def _with_hits(df: DataFrame, aliases: list, shard: int) -> DataFrame:
    """``df`` with the aliases of a shard that occur in a text added to the array ``_hits``."""
    held = df.sparkSession.sparkContext.broadcast(aliases)

    def scan(batches):
        import ahocorasick
        import pyarrow as pa

        rows = held.value
        plain, lowered = ahocorasick.Automaton(), ahocorasick.Automaton()
        by_name: dict = {}
        for i, (_, alias, _, whole) in enumerate(rows):
            by_name.setdefault((whole, alias), []).append(i)
        for (whole, alias), own in by_name.items():
            (lowered if whole else plain).add_word(alias, own)
        machines = []
        for machine, column in ((plain, "_plain"), (lowered, "_lowered")):
            if len(machine):
                machine.make_automaton()
                machines.append((machine, column))
        for batch in batches:
            found: list = [set() for _ in range(batch.num_rows)]
            for machine, column in machines:
                for hits, text in zip(found, batch.column(column), strict=True):
                    for _, own in machine.iter(text.as_py()):
                        hits.update(own)
            at = batch.schema.get_field_index("_hits")
            kind = batch.schema.field(at).type
            before = batch.column(at).to_pylist() if shard else [[]] * batch.num_rows
            made = [
                old + [dict(zip(("ord", "alias", "targets", "whole"), rows[i])) for i in sorted(own)]
                for old, own in zip(before, found, strict=True)
            ]
            yield batch.set_column(at, "_hits", pa.array(made, kind))

    return df.mapInArrow(scan, df.schema)


def with_places(df: DataFrame, text: str, aliases: DataFrame, shard_chars: int = 2_000_000) -> DataFrame:
    """``df`` with places: what ``places`` gives, from an alias table (ord, alias, targets, whole_word).

    Each text is read once by an Aho-Corasick automaton that knows all aliases of a shard; a table
    of up to ``shard_chars`` characters is one shard, held by each task. Every row is looked up for itself,
    so keys may repeat or be null; a null or empty text has no places. Empty aliases are left out.
    Word borders of what was found are tested as ``places`` tests them.
    """
    none = F.array().cast("array<struct<ord:bigint,alias:string,targets:array<string>,whole:boolean>>")
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({"_plain": plain, "_lowered": F.lower(plain), "_hits": none})
    known = aliases.filter(F.length("alias") > 0).select(
        F.col("ord").cast("bigint").alias("ord"), "alias", "targets", F.col("whole_word").alias("whole")
    )
    for i, shard in enumerate(_shards(known, shard_chars)):
        rows = _with_hits(rows, [tuple(r) for r in shard.collect()], i)

    def stands(x: Column) -> Column:
        quoted = F.regexp_replace(x["alias"], r"([^\w\s])", r"\\$1")
        pattern = F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b"))
        return ~x["whole"] | F.regexp_like(F.col("_lowered"), pattern)

    kept = F.array_sort(F.filter("_hits", stands))
    found = F.array_distinct(F.flatten(F.transform(kept, lambda x: x["targets"])))
    return rows.withColumn("places", found).select(*[c for c in df.columns if c != "places"], "places")


def places_joined(df: DataFrame, key: str, text: str, aliases: DataFrame, **options) -> DataFrame:
    """(key, places) of every row of ``df``, see ``with_places``."""
    return with_places(df.select(key, text), text, aliases, **options).select(key, "places")
