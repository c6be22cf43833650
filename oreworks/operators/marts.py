"""Business marts: conditional aggregates first, windows only over their few result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Domains
from oreworks.functions import columns as X
from oreworks.operators import lookups

def measures(cancelled: str) -> list[Column]:
    """Order counts, revenue, distinct paying customers and items of a group of sales."""
    sold = X.billable(cancelled)
    return [
        F.count("*").alias("orders_total"),
        F.count_if(sold).alias("orders_billable"),
        F.count_if(~sold).alias("orders_cancelled"),
        _cents(F.sum(F.when(sold, X.money("total_amount")))).alias("revenue"),
        F.count_distinct(F.when(sold, F.col("customer_id"))).alias("unique_customers"),
        F.coalesce(F.sum(F.when(sold, F.col("quantity"))), F.lit(0)).cast("bigint").alias("items_sold"),
    ]


def _cents(total: Column) -> Column:
    return F.round(F.coalesce(total, F.lit(0)), 2).cast("decimal(38,2)")


def base_metrics(sales: DataFrame, keys: Sequence[str], cancelled: str) -> DataFrame:
    return sales.groupBy(*keys).agg(*measures(cancelled))


def ratios(df: DataFrame) -> DataFrame:
    """Average ticket and cancellation rate; NULL where there is nothing to divide by."""
    out = {
        "avg_ticket": F.round(F.try_divide(F.col("revenue").cast("double"), F.col("orders_billable")), 2),
    }
    if "orders_total" in df.columns:
        out["cancel_rate_pct"] = X.percent(F.col("orders_cancelled"), F.col("orders_total"))
    return df.withColumns(out)


def share(name: str, *within: str) -> dict[str, Column]:
    """Revenue in percent of the revenue of all rows, or of the rows of one group."""
    whole = F.sum("revenue").over(Window.partitionBy(*within))
    return {name: X.percent(F.col("revenue"), whole)}


def _finish(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed column order; exact amounts leave as doubles."""
    amounts = {"revenue", "previous_revenue", "running_revenue"}
    return df.select(*[F.col(c).cast("double").alias(c) if c in amounts else F.col(c) for c in columns])


def shape_by_state(metrics: DataFrame, regions: Mapping[str, Sequence[str]]) -> DataFrame:
    """State mart from metrics keyed by ``shipping_state``."""
    ranked = ratios(metrics).withColumns(
        {
            "region": X.region_of("shipping_state", regions),
            **share("share_pct"),
            "revenue_rank": F.dense_rank().over(Window.orderBy(F.desc("revenue"))),
        }
    )
    return _finish(ranked.withColumnRenamed("shipping_state", "state"), C.STATE_COLUMNS).orderBy("revenue_rank", "state")


def shape_by_month(metrics: DataFrame) -> DataFrame:
    """Monthly mart from metrics keyed by ``year_month``; growth is against the row before."""
    by_time = Window.orderBy("year_month")
    previous = F.lag("revenue").over(by_time)
    trended = ratios(metrics).withColumns(
        {
            "previous_revenue": previous,
            "growth_pct": F.round(
                (F.try_divide(F.col("revenue").cast("double"), previous.cast("double")) - 1) * 100, 2
            ),
            "running_revenue": F.sum("revenue").over(
                by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            **share("year_share_pct"),
        }
    )
    return _finish(trended, C.MONTH_COLUMNS).orderBy("year_month")


def on_calendar(metrics: DataFrame) -> DataFrame:
    """Monthly metrics with a row for every month from the first to the last, zeros where nothing was sold.

    Growth against a month without revenue is NULL, that of such a month itself -100 %.  A
    metric without a month stays as it is.
    """
    day = lambda month: F.to_date(F.concat(month, F.lit("-01")))
    span = metrics.agg(F.min("year_month").alias("first"), F.max("year_month").alias("last")).filter(F.col("first").isNotNull())
    months = span.select(F.explode(F.sequence(day(F.col("first")), day(F.col("last")), F.expr("interval 1 month"))).alias("day"))
    calendar = months.select(F.date_format("day", "yyyy-MM").alias("year_month"))
    counted = [c for c in metrics.columns if c != "year_month"]
    filled = calendar.join(metrics, "year_month", "full")
    return filled.select("year_month", *[F.coalesce(c, F.lit(0).cast(metrics.schema[c].dataType)).alias(c) for c in counted])


def shape_by_payment(metrics: DataFrame) -> DataFrame:
    """Payment mart from metrics keyed by ``payment_method``."""
    shared = ratios(metrics).withColumns(share("share_pct")).withColumnRenamed("payment_method", "payment")
    return _finish(shared, C.PAYMENT_COLUMNS).orderBy(F.desc("revenue"), "payment")


def revenue_by_state(sales: DataFrame, d: Domains) -> DataFrame:
    return shape_by_state(base_metrics(sales, ["shipping_state"], d.cancelled), d.regions)


def monthly_analysis(sales: DataFrame, d: Domains, calendar: bool = False) -> DataFrame:
    """Monthly mart; with ``calendar`` months without sales are rows too, so that growth is month on month."""
    metrics = base_metrics(sales, ["year_month"], d.cancelled)
    return shape_by_month(on_calendar(metrics) if calendar else metrics)


def revenue_by_payment(sales: DataFrame, d: Domains) -> DataFrame:
    return shape_by_payment(base_metrics(sales, ["payment_method"], d.cancelled))


def category_customers(sales: DataFrame, categories: DataFrame, cancelled: str) -> DataFrame:
    """Sales added up per category and customer.

    What meets the customer table afterwards is one row per pair, never the sales of
    a hot customer, and distinct customers become a count of pairs.
    """
    return summed(lookups.with_category_name(sales, categories), ("category_name", "customer_id"), cancelled)


def name_pairs(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """Sums per ``category_id`` and customer under the category's name; parts of one pair are added up."""
    named = lookups.with_category_name(pairs, categories)
    return named.groupBy("category_name", "customer_id").agg(*[F.sum(c).alias(c) for c in _SUMS])


def shape_by_category(pairs: DataFrame, customers: DataFrame) -> DataFrame:
    """Category x segment mart from category-customer pairs; ``customers`` has one row per id."""
    labelled = lookups.label_unmatched(lookups.with_segment(pairs, customers))
    paying = (F.col("n_sold") > 0) & F.col("customer_id").isNotNull()
    metrics = labelled.groupBy("category_name", "segment").agg(
        F.sum("n").alias("orders_total"),
        F.sum("n_sold").alias("orders_billable"),
        F.sum("n_cancelled").alias("orders_cancelled"),
        _cents(F.sum("amount")).alias("revenue"),
        F.count_if(paying).alias("unique_customers"),
    )
    shared = ratios(metrics).withColumns(share("category_share_pct", "category_name"))
    return _finish(shared, C.CATEGORY_COLUMNS).orderBy("category_name", F.desc("revenue"), "segment")


def category_by_segment(sales: DataFrame, customers: DataFrame, categories: DataFrame, d: Domains) -> DataFrame:
    return shape_by_category(category_customers(sales, categories, d.cancelled), customers)


# ---------------------------------------------------------------------------
# One pass for the marts that share their input
# ---------------------------------------------------------------------------
ROLLUP_KEYS = ("shipping_state", "year_month", "payment_method")
_SUMS = ("n", "n_sold", "n_cancelled", "amount", "items")


def summed(sales: DataFrame, keys: Sequence[str], cancelled: str) -> DataFrame:
    """Sales added up per keys, exactly; such sums add up further."""
    sold = X.billable(cancelled)
    return sales.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(sold).alias("n_sold"), F.count_if(~sold).alias("n_cancelled"),
        F.sum(F.when(sold, X.money("total_amount"))).alias("amount"), F.sum(F.when(sold, F.col("quantity"))).alias("items"),
    )


def paying(sales: DataFrame, keys: Sequence[str], cancelled: str) -> DataFrame:
    """Keys and customer of every billable order."""
    return sales.filter(X.billable(cancelled) & F.col("customer_id").isNotNull()).select(*keys, "customer_id")


def rollup(sales: DataFrame, cancelled: str) -> DataFrame:
    """Metrics by state, by month, by payment and in total."""
    return rollup_of(summed(sales, ROLLUP_KEYS, cancelled), paying(sales, ROLLUP_KEYS, cancelled))


def rollup_of(sums: DataFrame, buyers: DataFrame) -> DataFrame:
    """Metrics of all grouping sets from sums and paying customers, which may repeat, per state, month and payment.

    ``_level`` tells the grouping sets apart (3, 5, 6 and 7: the bits of the keys that are
    summed over).  Sums are few rows, whatever the number of sales: they collapse in every
    task, and only they are repeated for each set.  Customers are counted apart, from
    distinct pairs.
    """
    sets = [[F.col(k)] for k in ROLLUP_KEYS] + [[]]
    keys = [F.col(k) for k in ROLLUP_KEYS]
    totals = sums.groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS]).groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_level"), *[F.sum(c).alias(c) for c in _SUMS], F.lit(0).cast("bigint").alias("customers")
    )
    counted = buyers.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_level"), F.count_distinct("customer_id").alias("customers")
    )
    both = totals.unionByName(counted, allowMissingColumns=True)
    return both.groupBy("_level", *ROLLUP_KEYS).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orders_total"),
        F.coalesce(F.sum("n_sold"), F.lit(0)).alias("orders_billable"),
        F.coalesce(F.sum("n_cancelled"), F.lit(0)).alias("orders_cancelled"),
        _cents(F.sum("amount")).alias("revenue"),
        F.sum("customers").alias("unique_customers"),
        F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("items_sold"),
    )


def from_rollup(rolled: DataFrame, key: str | None) -> DataFrame:
    """The metrics of one grouping set; ``None`` is the grand total."""
    bits = sum(1 << (len(ROLLUP_KEYS) - 1 - i) for i, k in enumerate(ROLLUP_KEYS) if k != key)
    level = rolled.filter(F.col("_level") == bits)
    return level.drop("_level", *[k for k in ROLLUP_KEYS if k != key])


# ---------------------------------------------------------------------------
# KPIs and top-k views
# ---------------------------------------------------------------------------
def kpis(sales: DataFrame, state_mart: DataFrame, cancelled: str) -> DataFrame:
    """One row: revenue, billable orders, distinct customers, ticket, leading state.

    ``active_customers`` counts every ordering customer, ``paying_customers`` only
    those with a billable order.
    """
    sold = X.billable(cancelled)
    per_customer = sales.groupBy("customer_id").agg(
        F.count_if(sold).alias("n_sold"), F.sum(F.when(sold, X.money("total_amount"))).alias("amount")
    )
    return kpis_by_customer(per_customer, state_mart)


def kpis_by_customer(per_customer: DataFrame, state_mart: DataFrame) -> DataFrame:
    """KPIs from sales already added up per customer, so a hot customer is one row by now."""
    totals = per_customer.agg(
        _cents(F.sum("amount")).alias("revenue"),
        F.coalesce(F.sum("n_sold"), F.lit(0)).alias("orders_billable"),
        F.count("customer_id").alias("active_customers"),
        F.count_if((F.col("n_sold") > 0) & F.col("customer_id").isNotNull()).alias("paying_customers"),
    )
    lead = top_states(state_mart, 1).select(
        F.col("state").alias("top_state"), F.col("share_pct").alias("top_share_pct")
    )
    # two one-row frames, merged into one row
    both = ratios(totals).unionByName(lead, allowMissingColumns=True)
    merged = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return merged.withColumn("revenue", F.col("revenue").cast("double"))


def top_states(state_mart: DataFrame, k: int = 10) -> DataFrame:
    return state_mart.orderBy("revenue_rank", "state").limit(k)


def top_category_segments(category_mart: DataFrame, k: int = 10) -> DataFrame:
    return category_mart.orderBy(F.desc("revenue"), "category_name", "segment").limit(k)
