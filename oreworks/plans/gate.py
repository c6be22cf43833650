"""Gate runs over the stored layers."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from oreworks import contract as C
from oreworks.config import Settings, pin_time_zone
from oreworks.operators import content, gates, normalize
from oreworks.plans.gold import MARTS
from oreworks.plans.silver import bronze_counts, bronze_sales
from oreworks.sinks import metrics, tables
from oreworks.sources.readers import read_layer


def evaluate(spark: SparkSession, settings: Settings, layer: str) -> DataFrame:
    """The checks of one layer, not yet stored.

    ``content`` compares Silver and quarantine with Bronze row by row, by digests: one more scan of all three.
    """
    silver = read_layer(spark, settings, "silver_sales")
    if layer == "silver":
        return gates.silver_gate(
            bronze_counts(spark, settings),
            silver,
            read_layer(spark, settings, "quarantine"),
            read_layer(spark, settings, "silver_customers"),
            settings.domains,
            settings.limits,
        )
    if layer == "gold":
        return gates.gold_gate(
            silver, *[read_layer(spark, settings, m) for m in MARTS], settings.domains, settings.limits
        )
    if layer == "content":
        sides = [silver, read_layer(spark, settings, "quarantine")]
        return content.content_gate(bronze_sales(spark, settings), sides, (*C.SALES_FIELDS, "order_ts", *normalize.LINEAGE))
    raise ValueError(f"no gate for layer {layer!r}")


def read_checks(spark: SparkSession, settings: Settings, layer: str) -> DataFrame:
    """The stored checks of one run and layer, with what they expected and whether they block."""
    place = f"{settings.folder('checks')}/run_id={quote(settings.run_id, safe='')}/layer={layer}"
    return tables.read(spark, place, gates.CHECK_LAYOUT).orderBy("position").drop("position", "data_ref", "executed_at")


def run_gate(spark: SparkSession, settings: Settings, layer: str) -> DataFrame:
    """Store the checks and the verdict, then stop the run if a blocking check failed."""
    pin_time_zone(spark, settings)
    stored = gates.stored_checks(evaluate(spark, settings, layer), layer, settings.run_id, settings.data_ref)
    # A run's checks are few rows, in a folder of their own; the same run's next ones replace them.
    place = f"{settings.folder('checks')}/run_id={quote(settings.run_id, safe='')}/layer={layer}"
    tables.overwrite_small(stored.drop("run_id", "layer"), place)
    checks = read_checks(spark, settings, layer)
    outcome = gates.verdict(checks)
    stage = f"gate_{layer}"
    metrics.save_metrics(metrics.metric_rows(outcome, stage, settings.run_id, settings.data_ref), settings)
    tables.append(
        tables.publish_names(gates.history_rows(checks, layer, settings.run_id, settings.data_ref)).coalesce(1),
        settings.folder("history"),
    )
    result = outcome.first()
    if result["verdict"] == gates.FAILED:
        raise gates.QualityGateError(f"quality gate {layer} failed: {result['blocking_failures']}")
    return checks
