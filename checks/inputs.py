"""Inputs derived from the given tables.

The expressions are valid in both Spark SQL and DuckDB, so each derived input is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PRICE = "cast(cast(p_retailprice as decimal(12,2)) as string)"
_SIZE = "cast(p_size as string)"
_KEY = "cast(p_partkey as string)"

VENUE = {
    "ord": "p_partkey",
    "name": "case p_partkey % 5 when 0 then concat('  ', upper(p_name)) "
    "when 1 then concat(p_name, ' ') else p_name end",
    "cuisine": "p_type",
    "district": "p_brand",
    "address": f"case when p_partkey % 11 = 3 then null else concat({_SIZE}, ' Harbour Road') end",
    "coordinates": "case p_partkey % 8 "
    f"when 0 then concat('22.', {_SIZE}, ', 114.', {_SIZE}) "
    f"when 1 then concat('(22.', {_SIZE}, ')') "
    f"when 2 then concat('(a, ', {_SIZE}, ')') "
    "when 3 then null "
    f"when 4 then concat(' ( 22.', {_SIZE}, ' , -114.', {_KEY}, ' ) ') "
    f"when 5 then concat('(22.', {_SIZE}, ', 114.1, 7)') "
    f"else concat('(22.', {_SIZE}, ', 114.', {_KEY}, ')') end",
    "description_highlights": "concat(p_name, ' by ', p_type, repeat(' tasty', p_size * 3))",
    "why_recommended": "case when p_partkey % 13 = 5 then null "
    "else concat('liked', repeat(' by locals', p_size)) end",
    "unique_tips": "repeat('go early ', p_size % 20)",
    "source_platform": "case when p_partkey % 7 = 2 then null else 'web' end",
    "source_title": "concat('Guide ', p_type)",
    "source_url": f"concat('https://example.org/watch?v=', {_KEY}, '&t=3')",
    "channel_account": "p_brand",
    "last_checked_date": "'2025-10-01'",
    "cost_estimate_breakfast": "case p_partkey % 7 "
    f"when 0 then concat('HKD ', {_PRICE}) "
    f"when 1 then concat('HKD ', {_SIZE}, '-100') "
    f"when 2 then concat('$', {_PRICE}, ' each') "
    "when 3 then 'HKD 1,200' when 4 then '平民價' when 5 then null "
    f"else concat('HKD $', {_SIZE}, ' ') end",
    "cost_estimate_lunch": f"concat('HKD ', {_SIZE}, '–60 lunch')",
    "cost_estimate_dinner": f"concat('HKD ', {_PRICE})",
}

RECORD = {
    "ord": "ord",
    "Name": "name",
    "Location": "district",
    "Description/Highlights": "description_highlights",
    "Why Recommended": "why_recommended",
    "Cost Estimate": "cost_estimate_breakfast",
    "Unique Tips": "unique_tips",
}


def _quoted(name: str, mark: str) -> str:
    return name if name.replace("_", "").isalnum() else f"{mark}{name}{mark}"


def select_list(columns: dict[str, str], mark: str) -> str:
    return ", ".join(f"{expr} as {_quoted(name, mark)}" for name, expr in columns.items())


def venues(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.selectExpr(*[f"{e} as `{n}`" for n, e in VENUE.items()])


def records(spark: SparkSession, sf: str) -> DataFrame:
    return venues(spark, sf).selectExpr(*[f"{e} as `{n}`" for n, e in RECORD.items()])


VENUES_SQL = f"(select {select_list(VENUE, chr(34))} from part)"
RECORDS_SQL = f"(select {select_list(RECORD, chr(34))} from {VENUES_SQL} as v)"

# Captions: every text line becomes a cue of its own.
CAPTIONS = {
    "doc_id": "doc_id",
    "value": "concat('WEBVTT', chr(10), chr(10), '1', chr(10), "
    "'00:00:01.000 --> 00:00:02.500', chr(10), "
    "replace(text, chr(10), concat(chr(10), chr(10), '2', chr(10), "
    "'00:00:03.000  -->  00:01:02.500', chr(10))), "
    "chr(10), '00:00:03,000 --> 00:01:02,500 align:start', chr(10), '  last ')",
}


def captions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.selectExpr(*[f"{e} as {n}" for n, e in CAPTIONS.items()])


CAPTIONS_SQL = f"(select {select_list(CAPTIONS, chr(34))} from documents)"

# Model answers: the whole text as a JSON string inside chatter; some answers are broken.
_JSON_TEXT = (
    "replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), "
    "concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), "
    "chr(9), concat(chr(92), 't'))"
)
_OBJECT = (
    "concat('{\"Name\": \"', source, '\", \"Location\": \"', lang, "
    "'\", \"Cost Estimate\": \"HKD ', cast(n_chars as string), "
    f"'\", \"Description/Highlights\": \"', {_JSON_TEXT}, '\"}}')"
)
ANSWERS = {
    "doc_id": "doc_id",
    "answer": "case doc_id % 6 "
    f"when 0 then concat('[', {_OBJECT}, ']') "
    f"when 1 then concat('Here you are: [ ', {_OBJECT}, ',', chr(10), "
    "'{\"Name\": \"second\"} ] Enjoy.') "
    "when 2 then concat('[{\"Name\": \"', source) "
    "when 3 then '[]' "
    "when 4 then concat('No list here, only ', source) "
    "else concat('[', chr(10), '  {\"Name\": ', source, '} ]') end",
}


def answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.selectExpr(*[f"{e} as {n}" for n, e in ANSWERS.items()])


ANSWERS_SQL = f"(select {select_list(ANSWERS, chr(34))} from documents)"
