"""Typed values from free text: costs, coordinates, ids, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.text import normal_key, strip, text_or_empty
from wayfare.functions.vectors import let
from wayfare.schema import EXTRACTED_LIST

# Currency marks, number shapes, the first JSON array of objects in a text,
# and the DNS namespace of version-5 UUIDs.
CURRENCY = ("HKD", "$")
FIRST_NUMBER = r"(\d+(\.\d+)?)"
WHOLE_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
JSON_ARRAY = r"(?s)\[\s*\{.*?\}\s*\]"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def _without_currency(c) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for mark in CURRENCY:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return strip(out)


def lenient_cost(c) -> Column:
    """First number of the text, so a range gives its lower bound."""
    found = F.regexp_extract(_without_currency(c), FIRST_NUMBER, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def strict_cost(c) -> Column:
    """A number only when the text is marked HKD, has no hyphen and nothing else."""
    raw = F.col(c) if isinstance(c, str) else c
    rest = _without_currency(raw)
    plain = F.contains(raw, F.lit("HKD")) & ~F.contains(raw, F.lit("-")) & rest.rlike(WHOLE_NUMBER)
    return F.when(plain, rest.try_cast("double"))


def coordinates(c) -> Column:
    """``(lat, lon)`` as a struct of two doubles, both null unless both parse."""
    raw = strip(F.col(c) if isinstance(c, str) else c)
    parts = F.split(F.btrim(raw, F.lit("()")), ",")
    shaped = F.contains(raw, F.lit("(")) & F.contains(raw, F.lit(")")) & (F.size(parts) == 2)

    def number(i: int) -> Column:
        part = strip(F.get(parts, F.lit(i)))
        return F.when(shaped & part.rlike(WHOLE_NUMBER), part.try_cast("double"))

    lat, lon = number(0), number(1)
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"))


def stable_id(name, district) -> Column:
    """Version-5 UUID of the two normalised keys, equal in every run and on every row order."""
    base = F.concat(
        normal_key(text_or_empty(name)), F.lit("|"), normal_key(text_or_empty(district))
    )

    def shaped(digest: Column) -> Column:
        nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
        variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
        return F.concat(
            F.substring(digest, 1, 8),
            F.lit("-"),
            F.substring(digest, 9, 4),
            F.lit("-5"),
            F.substring(digest, 14, 3),
            F.lit("-"),
            variant,
            F.substring(digest, 18, 3),
            F.lit("-"),
            F.substring(digest, 21, 12),
        )

    namespace = F.unhex(F.lit(DNS_NAMESPACE))
    return let(F.sha1(F.concat(namespace, F.encode(base, "UTF-8"))), shaped)


def random_id() -> Column:
    """A random UUID: not repeatable, never a key."""
    return F.uuid()


def find_json_list(c) -> Column:
    """The first JSON array of objects in noisy text; a bare ``[]`` counts; null if none."""
    raw = F.col(c) if isinstance(c, str) else c
    found = F.nullif(F.regexp_extract(raw, JSON_ARRAY, 0), F.lit(""))
    return F.coalesce(found, F.when(strip(raw) == "[]", F.lit("[]")))


def json_list(c, element: T.ArrayType = EXTRACTED_LIST) -> Column:
    """Parsed list of records, null when the text is not valid JSON."""
    return F.from_json(c, element)
