"""Record tables, caption files, JSON arrays and the sinks for results and rejects."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.text import clean_captions
from wayfare.schema import (
    EXTRACTED,
    VENUE_HEADERS,
    VENUE_RAW,
    VENUE_REQUIRED,
    require_columns,
)

TABULAR = ("csv", "json", "parquet", "orc")
# Fixed value: caption file endings.
CAPTION_FILES = "*.{vtt,srt}"
HEAD_BYTES = 64 * 1024


def _head(spark: SparkSession, path) -> list[str]:
    """The first record of a CSV file, read from its first bytes alone, packed or not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    size = HEAD_BYTES
    while True:
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
            plain = codec.createInputStream(stream) if codec is not None else stream
            bounded = jvm.org.apache.commons.io.input.BoundedInputStream(plain, size)
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
        finally:
            stream.close()
        # The reader takes lines as long as a quoted cell is open, so cells may hold line breaks.
        lines = csv.reader(io.StringIO(head.decode("utf-8-sig", "ignore"), newline=""))
        columns = next(lines, [])
        if len(head) < size or next(lines, None) is not None:
            return columns
        size *= 16


def _csv_files(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a CSV folder by their header, in order; the driver holds names of files and of columns.

    Of each file only the first bytes are read, of many at a time. Files without bytes are left out.
    """
    listed = spark.read.text(path).inputFiles()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in sorted(listed)]
    with ThreadPoolExecutor(32) as pool:
        heads = list(pool.map(lambda p: _head(spark, p), paths))
    files: dict[tuple[str, ...], list[str]] = {}
    for file, columns in zip(paths, heads, strict=True):
        files.setdefault(tuple(columns), []).append(file.toString())
    return files


def read_table(
    spark: SparkSession,
    path: str,
    format: str = "csv",
    schema: T.StructType | None = None,
    required: list[str] | None = None,
    multi_line: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """A record table with an explicit schema.

    CSV columns are taken by the name in each file's own header, so order and extra columns may
    differ between files; required columns are checked against every header before any job reads
    rows. Large CSV files are split over tasks; ``multi_line`` reads cells with line breaks, one
    task per file. ``ordered`` adds ``ord``, see ``input_order``.
    """
    if format not in TABULAR:
        raise ValueError(f"format must be one of {TABULAR}")
    reader = spark.read
    if format == "csv":
        options = dict(header=True, multiLine=multi_line, escape='"', encoding="UTF-8")
        parts = []
        for columns, files in _csv_files(spark, path).items():
            require_columns(columns, required or [])
            given = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            part = reader.options(**options).schema(given).csv(files)
            parts.append(_shaped(part, schema, ordered))
        if parts:
            return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        plain = reader.options(**options).csv(path)
    elif format == "json":
        plain = reader.schema(schema).json(path) if schema else reader.json(path)
    else:
        plain = reader.format(format).load(path)
    require_columns(plain.columns, required or [])
    return _shaped(plain, schema, ordered)


def _shaped(plain: DataFrame, schema: T.StructType | None, ordered: bool) -> DataFrame:
    """The columns of ``schema``, absent ones null, and the input order if asked."""
    have = set(plain.columns)
    if schema is None:
        columns = [F.col(f"`{c}`") for c in plain.columns]
    else:
        columns = [
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    return plain.select(*columns, *([input_order().alias("ord")] if ordered else []))


def read_venues(
    spark: SparkSession, path: str, format: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Venue table with spreadsheet headers, renamed to column names.

    ``ord`` is the position in the input: file name, then place within the file.
    """
    back = {v: k for k, v in VENUE_HEADERS.items()}
    needed = [back[c] for c in VENUE_REQUIRED]
    raw = read_table(spark, path, format, VENUE_RAW, needed, multi_line, ordered=True)
    return raw.select(*[F.col(f"`{h}`").alias(n) for h, n in VENUE_HEADERS.items()], "ord")


def input_order() -> Column:
    """(file, start of the block, row): orders rows of a file scan however its blocks are dealt."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_input_order(df: DataFrame) -> DataFrame:
    """``ord`` of rows that come from no file: Spark's partition-major row number."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_records(spark: SparkSession, path: str, schema: T.StructType = EXTRACTED) -> DataFrame:
    """JSON files that hold an array of records each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_captions(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(path, transcript) of every caption file in a folder, cleaned to one paragraph."""
    raw = (
        spark.read.option("pathGlobFilter", CAPTION_FILES)
        .option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
    )
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        clean_captions("value", strict).alias("transcript"),
    )


def literal_rows(spark: SparkSession, values: list[str], column: str = "text") -> DataFrame:
    """A short literal list as a table with its positions."""
    schema = T.StructType(
        [T.StructField("ord", T.LongType(), False), T.StructField(column, T.StringType())]
    )
    return spark.createDataFrame(list(enumerate(values)), schema)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One UTF-8 object per line; non-ASCII text stays as it is."""
    df.write.mode(mode).json(path)


def write_rejects(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rejected rows, raw text included, for a later look."""
    df.write.mode(mode).parquet(path)
