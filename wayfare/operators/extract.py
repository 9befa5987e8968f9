"""Model output to typed records: find the JSON list, parse it, split off the failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.parse import find_json_list, json_list
from wayfare.functions.text import sentence, url_parameter
from wayfare.schema import EXTRACTED_FIELDS, EXTRACTED_LIST

# Marker of a watchable URL, search results read, ids kept.
WATCH_MARK = "youtube.com/watch?v="
RESULTS_READ = 20
IDS_KEPT = 10

# Default wording of the extraction request; callers may pass their own.
EXTRACTION_PROMPT = """Read the transcript below (Chinese or English) and list every restaurant it
recommends. Answer with one JSON array only; use [] when there is none. Give each object these
string fields: {fields}.

Transcript: {transcript}
"""


def extraction_prompts(
    df: DataFrame, body: str = "transcript", template: str = EXTRACTION_PROMPT
) -> DataFrame:
    fields = F.lit(", ".join(EXTRACTED_FIELDS))
    return df.withColumn("prompt", sentence(template, fields=fields, transcript=F.col(body)))


def parse_outputs(
    df: DataFrame, body: str, element: T.ArrayType = EXTRACTED_LIST
) -> tuple[DataFrame, DataFrame]:
    """(rows with parsed ``records``, rejects with the raw text): together the whole input."""
    parsed = df.withColumn("records", json_list(find_json_list(body), element))
    good = parsed.filter(F.col("records").isNotNull())
    return good.drop(body), parsed.filter(F.col("records").isNull()).drop("records")


def flatten_records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record, with its position in the list."""
    spread = parsed.select(*keys, F.posexplode("records").alias("pos", "record"))
    return spread.select(*keys, "pos", "record.*")


def run_model(
    df: DataFrame,
    model: Callable[[Iterator], Iterator],
    schema: str | T.StructType,
) -> DataFrame:
    """Batch plug point for a text model: pandas batches in, pandas batches out."""
    return df.mapInPandas(model, schema)


def watch_ids(
    results: DataFrame,
    order: str,
    url: str = "url",
    mark: str = WATCH_MARK,
    parameter: str = "v",
    read: int = RESULTS_READ,
    kept: int = IDS_KEPT,
) -> DataFrame:
    """(order, video_id): of the first ``read`` results, the first ``kept`` that carry the mark.

    The read limit applies before the URL test.
    """
    first = results.select(order, url).orderBy(order).limit(read)
    marked = first.filter(F.contains(F.col(url), F.lit(mark)))
    return (
        marked.select(order, url_parameter(url, parameter).alias("video_id"))
        .orderBy(order)
        .limit(kept)
    )
