"""Run metrics as a table: (run_id, data_ref, stage, metric, key, value, recorded_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreworks.config import Settings
from oreworks.sinks import tables

SCHEMA = (
    "run_id string, data_ref string, stage string, metric string, key string, value string, "
    "recorded_at timestamp"
)


def metric_rows(df: DataFrame, stage: str, run_id: str, data_ref: str, key: str | None = None) -> DataFrame:
    """Every column of a small frame as one metric row per input row.

    ``key`` names the column that tells the rows apart, e.g. the rule or the source.
    """
    measured = [c for c in df.columns if c != key]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in measured]
    )
    label = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(label.alias("key"), F.inline(pairs)).select(
        F.lit(run_id).alias("run_id"),
        F.lit(data_ref).alias("data_ref"),
        F.lit(stage).alias("stage"),
        "metric",
        "key",
        "value",
        F.current_timestamp().alias("recorded_at"),
    )


def save_metrics(rows: DataFrame, settings: Settings) -> None:
    tables.append(rows.coalesce(1), settings.folder("metrics"))


def read_metrics(spark: SparkSession, settings: Settings, stage: str | None = None) -> DataFrame:
    """The metrics of one run; when a stage ran again, only its latest figures."""
    rows = tables.read(spark, settings.folder("metrics"), SCHEMA).filter(F.col("run_id") == settings.run_id)
    if stage is not None:
        rows = rows.filter(F.col("stage") == stage)
    return latest(rows)


def latest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("run_id", "stage").agg(F.max("recorded_at").alias("recorded_at"))
    return rows.join(last, ["run_id", "stage", "recorded_at"], "left_semi").select(*rows.columns)
