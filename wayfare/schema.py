"""Explicit schemas and column names of the record tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Field names of an extracted record.
EXTRACTED_FIELDS = [
    "Name",
    "Location",
    "Description/Highlights",
    "Why Recommended",
    "Cost Estimate",
    "Unique Tips",
]
EXTRACTED = _strings(*EXTRACTED_FIELDS)
EXTRACTED_LIST = T.ArrayType(EXTRACTED)
EXTRACTED_WITH_SOURCE = _strings(*EXTRACTED_FIELDS, "Source")

# Spreadsheet headers and the column names used here.
VENUE_HEADERS = {
    "店名": "name",
    "菜系": "cuisine",
    "所在區": "district",
    "地址": "address",
    "座標（lat, lon）": "coordinates",
    "餐廳亮點": "description_highlights",
    "推薦原因": "why_recommended",
    "獨門貼士": "unique_tips",
    "來源平台": "source_platform",
    "來源標題": "source_title",
    "來源連結（URL）": "source_url",
    "頻道／帳號": "channel_account",
    "最後核對日期（YYYY-MM-DD）": "last_checked_date",
    "消費預算—早餐（HKD/人）": "cost_estimate_breakfast",
    "消費預算—午餐（HKD/人）": "cost_estimate_lunch",
    "消費預算—晚餐（HKD/人）": "cost_estimate_dinner",
}
VENUE_REQUIRED = [
    "name",
    "district",
    "description_highlights",
    "why_recommended",
    "cost_estimate_breakfast",
    "cost_estimate_lunch",
    "cost_estimate_dinner",
    "unique_tips",
]
VENUE = _strings(*VENUE_HEADERS.values())
VENUE_RAW = _strings(*VENUE_HEADERS.keys())

SPARSE = T.StructType(
    [
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
VOCABULARY = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("term_id", T.IntegerType()),
        T.StructField("df", T.LongType()),
        T.StructField("cf", T.LongType()),
        T.StructField("idf", T.DoubleType()),
    ]
)


def require_columns(columns, required) -> None:
    """Raise with the list of absent columns; called before any job runs."""
    present = set(columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"missing columns: {missing}")
