"""Record curation: dedup, validation with reasons, projections, point payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import parse, text
from wayfare.functions.vectors import let
from wayfare.operators.grouping import keep_last
from wayfare.schema import VENUE, VENUE_HEADERS, VENUE_REQUIRED, require_columns

# Token bounds per field of an extracted record.
TOKEN_BOUNDS = {
    "Description/Highlights": (5, 100),
    "Why Recommended": (3, 50),
    "Unique Tips": (2, 30),
    "Cost Estimate": (1, 50),
}
# Fields of the index texts and the sentence form of a record.
VENUE_INDEX_FIELDS = ["name", "cuisine", "address", "description_highlights"]
RECORD_INDEX_FIELDS = [
    "Name",
    "Location",
    "Description/Highlights",
    "Why Recommended",
    "Cost Estimate",
    "Unique Tips",
]
RECORD_SENTENCE = (
    "{Name} in {Location}: {Description/Highlights}. Why: {Why Recommended}. "
    "Cost: {Cost Estimate}. Tips: {Unique Tips}."
)


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def venue_columns(df: DataFrame) -> DataFrame:
    """Rename spreadsheet headers, check the required ones, add absent optional ones as null."""
    for header, name in VENUE_HEADERS.items():
        if header in df.columns:
            df = df.withColumnRenamed(header, name)
    require_columns(df.columns, VENUE_REQUIRED)
    absent = [f.name for f in VENUE if f.name not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in absent}) if absent else df


def dedup_keep_last(df: DataFrame, keys=("name",), order="ord") -> tuple[DataFrame, DataFrame]:
    """Keep the last row per normalised key; rows with a null key are returned apart."""
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    key = F.struct(*[text.normal_key(k).alias(k) for k in keys])
    return keep_last(df.filter(usable), key, order), df.filter(~usable)


def venue_text(fields=None) -> Column:
    """Index text of a venue row."""
    return text.join_fields(*(fields or VENUE_INDEX_FIELDS))


def record_text() -> Column:
    """Index text of an extracted record; unlike the venue text it is not trimmed."""
    return F.concat_ws(" ", *[text.text_or_empty(_field(f)) for f in RECORD_INDEX_FIELDS])


def record_sentence() -> Column:
    return text.sentence(RECORD_SENTENCE, **{f: _field(f) for f in RECORD_INDEX_FIELDS})


def violations(bounds: dict[str, tuple[int, int]] | None = None) -> Column:
    """Array of messages, one per field whose token count is out of bounds."""

    def check(field: str, low: int, high: int) -> Column:
        def message(count: Column) -> Column:
            short = F.concat(F.lit(f"{field} too short: "), count, F.lit(f" tokens (min {low})"))
            long = F.concat(F.lit(f"{field} too long: "), count, F.lit(f" tokens (max {high})"))
            return F.when(count < low, short).when(count > high, long)

        # Tokens are counted once per field, not once per comparison.
        return let(text.token_count(_field(field)), message)

    fields = (bounds or TOKEN_BOUNDS).items()
    return F.array_compact(F.array(*[check(f, *limits) for f, limits in fields]))


def split_valid(df: DataFrame, bounds=None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with ``reasons``); together they are the whole input."""
    checked = df.withColumn("reasons", violations(bounds))
    kept = checked.filter(F.size("reasons") == 0).drop("reasons")
    return kept, checked.filter(F.size("reasons") > 0)


def split_filled(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows whose text is null or empty)."""
    filled = F.coalesce(F.col(column), F.lit("")) != ""
    return df.filter(filled), df.filter(~filled)


def venue_payload(df: DataFrame) -> DataFrame:
    """Stable id, typed coordinates and costs next to the text columns of a venue."""
    where = parse.coordinates("coordinates")
    return df.select(
        parse.stable_id("name", "district").alias("id"),
        *[F.col(c).cast("string").alias(c) for c in ("name", "cuisine", "district", "address")],
        where["latitude"].alias("latitude"),
        where["longitude"].alias("longitude"),
        *[
            F.col(c).cast("string").alias(c)
            for c in (
                "description_highlights",
                "why_recommended",
                "unique_tips",
                "source_platform",
                "source_title",
                "source_url",
                "channel_account",
                "last_checked_date",
            )
        ],
        *[
            column
            for meal in ("breakfast", "lunch", "dinner")
            for column in (
                F.col(f"cost_estimate_{meal}").cast("string").alias(f"cost_estimate_{meal}"),
                parse.lenient_cost(f"cost_estimate_{meal}").alias(f"parsed_cost_{meal}"),
            )
        ],
    )


def record_payload(df: DataFrame, *carry: str) -> DataFrame:
    """Payload of an extracted record: strict cost, source with a default."""
    source = F.col("Source").cast("string") if "Source" in df.columns else F.lit(None)
    return df.select(
        *carry,
        *[_field(f).cast("string").alias(f) for f in RECORD_INDEX_FIELDS if f != "Cost Estimate"],
        text.strip(_field("Cost Estimate")).alias("Cost Estimate"),
        parse.strict_cost(_field("Cost Estimate")).alias("Parsed Cost"),
        F.coalesce(source, F.lit("Unknown")).alias("Source"),
    )


def display_rows(hits: DataFrame, fields: list[str], body: str, limit: int = 3) -> DataFrame:
    """Printable hits: first ``limit`` per query, short body, score with four decimals."""
    return hits.filter(F.col("rank") <= limit).select(
        "query_id",
        "rank",
        *fields,
        F.format_string("%.4f", F.col("score")).alias("score"),
        F.concat(text.snippet(body), F.lit("...")).alias("snippet"),
    )


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count per named stage, in the order given."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows"
        )
        for i, (name, df) in enumerate(stages.items())
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


class StageCounter:
    """Row counts of stages, taken while one plan runs, without a pass of their own."""

    def __init__(self) -> None:
        self.observed: list[tuple[Observation, list[str]]] = []

    def mark(self, df: DataFrame, **stages: Column) -> DataFrame:
        """``df``, counting the rows for which each stage's condition holds as they pass here."""
        seen = Observation()
        self.observed.append((seen, list(stages)))
        return df.observe(seen, *[F.count_if(c).alias(n) for n, c in stages.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, stage, rows) in the order marked, once an action has run the marked plan to its end."""
        rows = []
        for seen, names in self.observed:
            rows += [(len(rows) + i, n, seen.get[n]) for i, n in enumerate(names)]
        return spark.createDataFrame(rows, "step int, stage string, rows bigint")
