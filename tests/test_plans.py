"""Shapes of the physical plans: what must hold when the data is a million times larger."""

import pytest

from oreworks.config import Domains
from oreworks.operators import lookups, marts, normalize, quarantine
from oreworks.operators.rules import sales_rules
from testprofile import tables as P

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mart_reads_only_its_columns(spark, tmp_path, sales):
    path = str(tmp_path / "silver")
    normalize.enrich(sales({}), 500).write.parquet(path)
    text = plan(marts.revenue_by_state(spark.read.parquet(path), Domains()))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "customer_id", "quantity", "total_amount", "shipping_state", "status"
    }


def test_windows_of_marts_see_aggregated_rows_only(spark, sales):
    df = normalize.enrich(sales({}), 500)
    for mart in (marts.revenue_by_state(df, Domains()), marts.monthly_analysis(df, Domains())):
        text = optimized(mart)
        assert text.index("Window") < text.index("Aggregate")


def test_rules_run_once_per_row(spark, sales, registry):
    """A filter on the verdict reads the computed mask and does not repeat the rules."""
    rows = quarantine.with_row_id(sales({}))
    tag = quarantine.tag_by_unknown(lookups.unknown_keys(rows, registry))
    lists = quarantine.Exceptions(tag, rows.select("_row_id").filter("false"))
    judged = quarantine.judge_by_exceptions(rows, lists, sales_rules(Domains()))
    for side in (quarantine.valid_rows(judged), quarantine.quarantined_rows(judged)):
        assert optimized(side).count("IN (credit_card") == 1


def test_big_way_moves_no_wide_row(spark, sales, registry, tmp_path):
    """With both exception lists small, tagging needs no shuffle at all."""
    from pyspark.sql import functions as F

    rows = quarantine.with_row_id(sales({})).withColumn("_source_priority", F.lit(0))
    tag = quarantine.tag_by_unknown(F.broadcast(lookups.unknown_keys(rows, registry)))
    listed = F.broadcast(rows.select("_row_id").filter("false"))
    judged = quarantine.judge_by_exceptions(rows, quarantine.Exceptions(tag, listed), sales_rules(Domains()))
    wide = [
        line for line in plan(quarantine.valid_rows(judged)).splitlines()
        if "Exchange hashpartitioning" in line and "shipping_city" in line
    ]
    assert wide == []


def test_sample_is_cut_before_the_shuffle(spark):
    df = quarantine.sample_per_reason(P.rejected(spark, SF), ["order_id", "l_partkey", "l_suppkey", "total_amount"])
    assert "WindowGroupLimit" in plan(df)


def test_category_mart_adds_up_before_it_meets_the_customers(spark):
    text = optimized(
        marts.category_by_segment(P.silver_sales(spark, SF), P.customers(spark, SF), P.categories(spark, SF), P.DOMAINS)
    )
    before_customers = text.index("Aggregate [category_name")
    assert text.index("Aggregate [category_name", before_customers + 1) > before_customers


@pytest.mark.parametrize("name", ["a3_revenue_by_state", "q9_valid", "a8_by_rule", "j4_orphans"])
def test_no_cross_join_and_no_python_worker(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
