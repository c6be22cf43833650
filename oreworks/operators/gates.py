"""Quality gates: every check is one row of
(check, dimension, status, value, expected, blocking)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Domains, Limits
from oreworks.functions import columns as X
from oreworks.operators import lookups, profile
from oreworks.operators.normalize import unite
from oreworks.operators.rules import passes_all, sales_rules

PASS, FAIL = "PASS", "FAIL"
PASSED, FAILED = "PASSED", "FAILED"


class QualityGateError(Exception):
    """A blocking check failed."""


@dataclass(frozen=True)
class Check:
    name: str
    dimension: str
    passes: Column
    value: Column
    expected: Column
    blocking: bool = True

    def row(self) -> Column:
        return F.struct(
            F.lit(self.name).alias("check"),
            F.lit(self.dimension).alias("dimension"),
            F.when(F.coalesce(self.passes, F.lit(False)), PASS).otherwise(FAIL).alias("status"),
            F.coalesce(self.value.cast("string"), F.lit("")).alias("value"),
            self.expected.cast("string").alias("expected"),
            F.lit(self.blocking).alias("blocking"),
        )


def facts(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns, merged into one row."""
    merged = unite(frames)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def check_rows(measured: DataFrame, checks: Sequence[Check]) -> DataFrame:
    return measured.select(F.inline(F.array(*[c.row() for c in checks])))


def silver_facts(
    bronze: DataFrame, silver: DataFrame, quarantine: DataFrame, customers: DataFrame, d: Domains
) -> DataFrame:
    """All figures of the Silver gate.

    Row checks share one scan without a shuffle; only the two checks that need keys
    (uniqueness, orphans) shuffle, and only their key column.
    """
    rules = sales_rules(d, integrity=False)
    rows = silver.agg(
        F.count("*").alias("silver"),
        F.count_if(~passes_all(rules)).alias("outside_domain"),
        *profile.empty_counts(silver, d.required, "empty_"),
    )
    keys = silver.agg(F.count_distinct("order_id").alias("distinct_orders"))
    orphans = lookups.orphan_rows(silver, customers).agg(
        F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans")
    )
    return facts(
        bronze.agg(F.count("*").alias("bronze")),
        quarantine.agg(F.count("*").alias("quarantine")),
        rows,
        keys,
        orphans,
    )


def silver_checks(measured: DataFrame, d: Domains, limits: Limits) -> DataFrame:
    n = F.col
    empty = [n(f"empty_{f}") for f in d.required]
    total_empty = sum(empty[1:], empty[0])
    per_field = F.map_filter(
        F.create_map(*[x for f in d.required for x in (F.lit(f), n(f"empty_{f}"))]), lambda _, v: v > 0
    )
    rate = F.coalesce(F.try_divide(n("quarantine").cast("double"), n("bronze").cast("double")), F.lit(1.0))
    duplicates = n("silver") - n("distinct_orders")
    return check_rows(
        measured,
        [
            Check(
                C.CHECK_CONSERVATION, C.CONSERVATION, n("bronze") == n("silver") + n("quarantine"),
                F.to_json(F.struct("bronze", "silver", "quarantine")), F.lit(C.EXPECT_CONSERVATION),
            ),
            Check(C.CHECK_COMPLETENESS, C.COMPLETENESS, total_empty == 0, F.to_json(per_field), F.lit(C.EXPECT_COMPLETENESS)),
            Check(C.CHECK_UNIQUENESS, C.UNIQUENESS, duplicates == 0, duplicates, F.lit(0)),
            Check(C.CHECK_DOMAIN, C.DOMAIN, n("outside_domain") == 0, n("outside_domain"), F.lit(0)),
            Check(C.CHECK_INTEGRITY, C.INTEGRITY, n("orphans") == 0, n("orphans"), F.lit(C.EXPECT_INTEGRITY)),
            Check(
                C.CHECK_QUARANTINE_RATE, C.MONITORING, rate <= limits.quarantine_rate_max,
                F.round(rate, 4), F.lit(f"<= {limits.quarantine_rate_max}"),
            ),
            Check(
                C.CHECK_VOLUME, C.VOLUME, n("silver") >= limits.silver_rows_min,
                n("silver"), F.lit(f">= {limits.silver_rows_min}"),
            ),
        ],
    )


def silver_gate(
    bronze: DataFrame, silver: DataFrame, quarantine: DataFrame, customers: DataFrame, d: Domains, limits: Limits
) -> DataFrame:
    return silver_checks(silver_facts(bronze, silver, quarantine, customers, d), d, limits)


def gold_facts(
    silver: DataFrame, by_state: DataFrame, by_month: DataFrame, by_payment: DataFrame, by_category: DataFrame,
    d: Domains,
) -> DataFrame:
    """All figures of the Gold gate: one scan of two Silver columns, one of each mart."""
    sold = X.billable(d.cancelled)

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.col(column).cast("decimal(30,2)")), F.lit(0))

    def below_zero(name: str) -> Column:
        return F.count_if(F.col("revenue") < 0).alias(name)

    unlabelled = (F.col("category_name") == C.NO_CATEGORY) | (F.col("segment") == C.NO_SEGMENT)
    return facts(
        silver.agg(
            F.coalesce(F.round(F.sum(F.when(sold, X.money("total_amount"))), 2), F.lit(0))
            .cast("decimal(30,2)").alias("silver_revenue"),
            F.count_if(sold).alias("silver_orders"),
        ),
        by_state.agg(
            total("revenue").alias("state_revenue"), F.count("*").alias("states"), below_zero("negative_states")
        ),
        by_month.agg(
            total("revenue").alias("month_revenue"),
            F.coalesce(F.sum("orders_billable"), F.lit(0)).alias("month_orders"),
            below_zero("negative_months"),
        ),
        by_payment.agg(total("revenue").alias("payment_revenue")),
        by_category.agg(total("revenue").alias("category_revenue"), F.count_if(unlabelled).alias("unlabelled")),
    )


def gold_checks(measured: DataFrame, d: Domains, limits: Limits) -> DataFrame:
    n = F.col

    def reconciles(name: str, mart: str) -> Check:
        gap = F.abs(n(mart) - n("silver_revenue"))
        return Check(
            name, C.CONSISTENCY, gap < F.lit(limits.reconcile_tolerance).cast("decimal(18,6)"),
            n(mart), n("silver_revenue"),
        )

    negative = n("negative_states") + n("negative_months")
    return check_rows(
        measured,
        [
            reconciles(C.CHECK_STATE_REVENUE, "state_revenue"),
            reconciles(C.CHECK_MONTH_REVENUE, "month_revenue"),
            reconciles(C.CHECK_PAYMENT_REVENUE, "payment_revenue"),
            reconciles(C.CHECK_CATEGORY_REVENUE, "category_revenue"),
            Check(C.CHECK_KNOWN_DIMENSIONS, C.INTEGRITY, n("unlabelled") == 0, n("unlabelled"), F.lit(0)),
            Check(
                C.CHECK_MONTH_ORDERS, C.CONSISTENCY, n("month_orders") == n("silver_orders"),
                n("month_orders"), n("silver_orders"),
            ),
            Check(
                C.CHECK_STATES, C.COMPLETENESS, n("states") == len(d.states), n("states"), F.lit(len(d.states)),
                blocking=False,
            ),
            Check(C.CHECK_NEGATIVE_REVENUE, C.DOMAIN, negative == 0, negative, F.lit(0)),
        ],
    )


def gold_gate(
    silver: DataFrame, by_state: DataFrame, by_month: DataFrame, by_payment: DataFrame, by_category: DataFrame,
    d: Domains, limits: Limits,
) -> DataFrame:
    return gold_checks(gold_facts(silver, by_state, by_month, by_payment, by_category, d), d, limits)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: FAILED when any blocking check failed."""
    failing = F.col("status") == FAIL
    blocking = failing & F.col("blocking")
    return checks.agg(
        F.when(F.count_if(blocking) > 0, FAILED).otherwise(PASSED).alias("verdict"),
        F.count("*").alias("checks_total"),
        F.count_if(~failing).alias("checks_ok"),
        F.array_join(F.array_sort(F.collect_list(F.when(blocking, F.col("check")))), ",").alias("blocking_failures"),
    )


def failed_checks(checks: DataFrame) -> DataFrame:
    """The checks a failure report lists."""
    return checks.filter(F.col("status") == FAIL)


#: Stored checks; run and layer are folders.
CHECK_LAYOUT = (
    "position int, executed_at timestamp, data_ref string, `check` string, dimension string, status string, value string, "
    "expected string, blocking boolean"
)


def stored_checks(checks: DataFrame, layer: str, run_id: str, data_ref: str) -> DataFrame:
    """Checks in full, in their order, as a failure report reads them later."""
    return checks.select(
        F.monotonically_increasing_id().cast("int").alias("position"),
        F.current_timestamp().alias("executed_at"),
        F.lit(data_ref).alias("data_ref"),
        F.lit(run_id).alias("run_id"),
        F.lit(layer).alias("layer"),
        *("check", "dimension", "status", "value", "expected", "blocking"),
    )


def history_rows(checks: DataFrame, layer: str, run_id: str, data_ref: str) -> DataFrame:
    """Checks as rows of the append-only quality history."""
    return checks.select(
        F.current_timestamp().alias("executed_at"),
        F.lit(data_ref).alias("data_ref"),
        F.lit(run_id).alias("run_id"),
        F.lit(layer).alias("layer"),
        "check",
        "dimension",
        "status",
        "value",
    )
