"""The gated chain from raw files to marts, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreworks.config import Settings, pin_time_zone
from oreworks.operators import profile
from oreworks.operators.normalize import unite
from oreworks.plans.bronze import run_bronze
from oreworks.plans.gate import run_gate
from oreworks.plans.gold import run_gold
from oreworks.plans.silver import run_silver
from oreworks.sinks import metrics
from oreworks.sources.checks import sources_ready
from oreworks.sources.readers import read_layer


class SourcesNotReady(Exception):
    """At least one raw source has no file with content."""


def run(spark: SparkSession, settings: Settings) -> DataFrame:
    """readiness -> Bronze -> Silver -> gate -> Gold -> gate -> summary.

    Gold is not built when the Silver gate fails: the gate raises first.
    """
    pin_time_zone(spark, settings)
    waiting = [r["source"] for r in sources_ready(spark, settings).filter(~F.col("ready")).collect()]
    if waiting:
        raise SourcesNotReady(f"no files yet for: {sorted(waiting)}")
    run_bronze(spark, settings)
    run_silver(spark, settings)
    run_gate(spark, settings, "silver")
    run_gold(spark, settings)
    run_gate(spark, settings, "gold")
    return summary(spark, settings)


def summary(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row about the run: flow, gate verdicts, KPIs and rows of each mart, all from its metrics."""
    every = metrics.read_metrics(spark, settings)
    mart = F.when((F.col("stage") == "gold") & (F.col("metric") == "mart_rows"), F.concat_ws("=", "key", "value"))
    rows = every.filter(F.col("key").isNull() | mart.isNotNull())

    def pick(stage: str, metric: str, as_type: str = "string"):
        wanted = (F.col("stage") == stage) & (F.col("metric") == metric) & F.col("key").isNull()
        return F.max(F.when(wanted, F.col("value"))).cast(as_type)

    flow = [pick("silver", m, "bigint").alias(m) for m in ("bronze", "silver", "quarantine")]
    verdicts = [
        F.format_string(
            "%s (%s/%s)", *[pick(f"gate_{layer}", m) for m in ("verdict", "checks_ok", "checks_total")]
        ).alias(f"{layer}_gate")
        for layer in ("silver", "gold")
    ]
    kpis = [
        pick("gold", m, t).alias(m)
        for m, t in (
            ("revenue", "double"), ("orders_billable", "bigint"), ("avg_ticket", "double"),
            ("active_customers", "bigint"), ("top_state", "string"), ("top_share_pct", "double"),
        )
    ]
    marts = F.array_join(F.array_sort(F.collect_list(mart)), ",").alias("marts")
    return rows.agg(*flow, pick("silver", "conserved", "boolean").alias("conserved"), *verdicts, *kpis, marts)


def quarantine_alert(spark: SparkSession, settings: Settings) -> DataFrame:
    return alert_rows(read_layer(spark, settings, "quarantine"))


def alert_rows(rejected: DataFrame) -> DataFrame:
    """(about, item, rows): totals, by rule and by source.  No rows, no alert."""
    total = profile.tagged_count(rejected, "total").select(
        F.lit("total").alias("about"), F.lit("").alias("item"), F.col("n").alias("rows")
    )
    by_rule = profile.quarantine_by_rule(rejected).select(F.lit("rule").alias("about"), F.col("rule").alias("item"), "rows")
    by_source = profile.rows_by_source(rejected).select(
        F.lit("source").alias("about"), F.col("_source").alias("item"), "rows"
    )
    return unite([total, by_rule, by_source]).filter(F.col("rows") > 0)
