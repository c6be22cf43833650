"""Scans of the raw sources and of the stored layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Settings, SourceSpec
from oreworks.operators.quarantine import ROW_ID
from oreworks.sinks import tables
from oreworks.sinks.published import published, scan
from oreworks.sources.pages import read_split_records_json

FILE = "_metadata.file_path"


def read_delimited(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Delimited text with a header; every column stays text.

    Columns are named by the header.  ``enforceSchema`` off makes Spark compare the
    header of every file with it, so a file with another layout stops the read
    instead of filling the wrong columns.
    """
    options = {"header": "true", "inferSchema": "false", "enforceSchema": "false", **spec.options}
    reader = spark.read.options(**options)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return _with_file(reader.csv(path))


def read_records_json(spark: SparkSession, path: str, spec: SourceSpec, records: str = "data") -> DataFrame:
    """Documents that hold their records in one array; one row per record.

    A multi-line document cannot be split, so one task reads one file; ``split_records_json`` splits flat ones.
    """
    pages = _json(spark, path, spec)
    rows = pages.select(F.explode(records).alias("record"), F.col(FILE).alias("_source_file"))
    return rows.select("record.*", "_source_file")


def read_document_json(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Whole documents with their nesting kept."""
    return _with_file(_json(spark, path, spec))


def read_parquet(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    reader = spark.read.options(**spec.options)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return _with_file(reader.parquet(path))


READERS = {
    "delimited": read_delimited,
    "records_json": read_records_json,
    "split_records_json": read_split_records_json,
    "document_json": read_document_json,
    "parquet": read_parquet,
}


def raw_path(spec: SourceSpec, settings: Settings) -> str:
    return settings.folder("raw", spec.name, spec.pattern)


def read_source(spark: SparkSession, spec: SourceSpec, settings: Settings, path: str | None = None) -> DataFrame:
    """The raw rows of one registered source, with ``_source_file``."""
    return READERS[spec.kind](spark, path or raw_path(spec, settings), spec)


def with_identity(df: DataFrame) -> DataFrame:
    """Rows of stored files plus an identity per row: its file and its position there.

    The identity does not change when a task runs again or other columns are read.
    """
    identity = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return df.select("*", identity.alias(ROW_ID))


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """A stored Parquet folder with the identity of its rows."""
    return with_identity(spark.read.parquet(path))


def read_bronze(spark: SparkSession, settings: Settings, spec: SourceSpec, leaves: Sequence[str] | None = None) -> DataFrame:
    """The stored rows of one source, or those of some of its folders only."""
    if leaves is None:
        leaves = published(spark, settings.root).get(settings.bronze_table(spec))
    if leaves is None:
        return spark.read.parquet(settings.bronze_folder(spec))
    return scan(spark, settings.root, leaves)


def adopt_names(df: DataFrame) -> DataFrame:
    """Column names on disk -> names used in this library."""
    return df.withColumnsRenamed({disk: name for name, disk in C.PUBLISHED_COLUMNS.items()})


def read_layer(
    spark: SparkSession,
    settings: Settings,
    table: str,
    months: tuple[str, str] | None = None,
) -> DataFrame:
    """A stored layer under this library's column names; ``months`` prunes partitions.

    Sales tables are read by their declared layout, so an empty one is a table too.
    """
    layout = C.STORED_LAYOUTS.get(table)
    leaves = published(spark, settings.root).get(table)
    if leaves is None:
        df = adopt_names(tables.read(spark, settings.folder(table), layout))
    else:
        df = adopt_names(scan(spark, settings.root, leaves, layout))
    if months is not None:
        df = df.filter(F.col("year_month").between(*months))
    return df


def _json(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    # A document that does not parse stops the read instead of vanishing.
    reader = spark.read.options(**{"mode": "FAILFAST", **spec.options})
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return reader.json(path, multiLine=True)


def _with_file(df: DataFrame) -> DataFrame:
    return df.select("*", F.col(FILE).alias("_source_file"))
