"""Is a source there, and does it have the columns it owes?"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreworks.config import Settings, SourceSpec
from oreworks.operators.normalize import unite


class SchemaDriftError(Exception):
    """A source came without columns its contract asks for."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required).difference(df.columns))


def require_columns(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """The frame itself, or an error naming what is missing.  Extra columns are fine."""
    missing = missing_columns(df, spec.required)
    if missing:
        raise SchemaDriftError(f"{spec.name}: required columns are missing: {missing}")
    return df


def column_report(frames: Mapping[str, DataFrame], specs: Iterable[SourceSpec]) -> DataFrame:
    """(source, column, present, filled) for every column a contract asks for.

    ``filled`` counts the rows with a value: a column that is there but empty in
    every row has drifted just as well.
    """
    return unite(_columns_of(frames[spec.name], spec) for spec in specs)


def _columns_of(df: DataFrame, spec: SourceSpec) -> DataFrame:
    def filled(column: str):
        return F.count(column) if column in df.columns else F.lit(0).cast("bigint")

    counted = df.agg(F.count("*").alias("_rows"), *[filled(c).alias(c) for c in spec.required])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(c).alias("filled"))
        for c in spec.required
    ]
    return counted.select(F.lit(spec.name).alias("source"), F.inline(F.array(*entries)))


def file_inventory(spark: SparkSession, root: str, folder: str, pattern: str) -> DataFrame:
    """Name and size of the files of one source; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(f"{root.rstrip('/')}/{folder}" if folder else root)
        .select("path", "length")
    )


def readiness(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected source: files, bytes and whether at least one file has content.

    ``inventory`` is (source, length); ``expected`` lists the sources, so one that
    has no file at all is reported too.
    """
    found = inventory.groupBy("source").agg(
        F.count_if(F.col("length") > 0).alias("files"), F.sum("length").alias("bytes")
    )
    filled = expected.join(found, "source", "left").fillna({"files": 0, "bytes": 0})
    return filled.withColumn("ready", F.col("files") > 0)


def sources_ready(spark: SparkSession, settings: Settings) -> DataFrame:
    """Readiness of all registered raw sources, from one listing of the raw folder."""
    root = settings.folder("raw")
    names = [s.name for s in settings.sources]
    expected = spark.createDataFrame([(n,) for n in names], "source string")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, length bigint")  # no folder, so no file
    belongs = F.lit(None).cast("string")
    for spec in settings.sources:
        name = spec.pattern.replace(".", r"\.").replace("*", "[^/]*")
        belongs = F.when(F.col("path").rlike(f"/{spec.name}/{name}$"), F.lit(spec.name)).otherwise(belongs)
    inventory = files.select(belongs.alias("source"), "length").filter(F.col("source").isNotNull())
    return readiness(inventory, expected)
