"""Counts that describe the layers and the quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks.functions import columns as X
from oreworks.operators.normalize import unite


def quarantine_by_rule(quarantine: DataFrame) -> DataFrame:
    """Failures per rule, most frequent first; a row counts once for every rule it failed."""
    return (
        quarantine.select(F.explode("_reasons").alias("rule"))
        .groupBy("rule").agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "rule")
    )


def rows_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("_source").agg(F.count("*").alias("rows"))


def source_stats(bronze: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct physical files per source; an expected source without rows has 0 of both."""
    per_file = bronze.groupBy("_source", "_source_file").agg(F.count("*").alias("n"))
    stats = per_file.groupBy("_source").agg(F.sum("n").alias("rows"), F.count("_source_file").alias("files"))
    if not expected:
        return stats
    names = bronze.sparkSession.createDataFrame([(name,) for name in expected], "_source string")
    return names.join(stats, "_source", "full").fillna(0, ["rows", "files"])


def null_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Number of rows without a value, per field, in one pass."""
    return df.agg(*empty_counts(df, fields))


def empty_counts(df: DataFrame, fields: Sequence[str], prefix: str = "") -> list[Column]:
    """Aggregates counting missing values; only text can also be blank."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [
        F.count_if(~X.has_value(f) if f in text else F.col(f).isNull()).alias(prefix + f) for f in fields
    ]


def duplicate_count(df: DataFrame, key: str, long_text: bool = False) -> DataFrame:
    """Rows, distinct keys and rows beyond the first of their key.

    A long text is compared by its SHA-256 digest, so whole texts decide but only
    their digests are shuffled.
    """
    compared = F.sha2(F.col(key), 256) if long_text else F.col(key)
    return df.agg(F.count("*").alias("rows"), F.count_distinct(compared).alias("distinct_keys")).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_keys")
    )


def tagged_count(df: DataFrame, layer: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), "n")


def layer_flow(bronze: DataFrame, silver: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: rows per layer, quarantine rate and whether no row was lost."""
    counts = unite(
        [tagged_count(bronze, "bronze"), tagged_count(silver, "silver"), tagged_count(quarantine, "quarantine")]
    )
    one = counts.agg(
        *[F.sum(F.when(F.col("layer") == name, F.col("n"))).alias(name) for name in ("bronze", "silver", "quarantine")]
    )
    return flow_figures(one)


def flow_figures(counts: DataFrame) -> DataFrame:
    """Rate and conservation flag of a row with bronze, silver and quarantine counts."""
    return counts.withColumns(
        {
            "quarantine_rate": F.round(
                F.try_divide(F.col("quarantine").cast("double"), F.col("bronze").cast("double")), 4
            ),
            "conserved": F.col("bronze") == F.col("silver") + F.col("quarantine"),
        }
    )
