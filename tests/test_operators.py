import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Domains, Scale
from oreworks.functions import columns as X
from oreworks.operators import gates, lookups, marts, normalize, profile, quarantine
from oreworks.operators.rules import failure_counts, sales_rules, total_matches


def one(spark, expression, **values):
    """Value of an expression over a single row of text columns."""
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("text, clean", [(" a b ", "a b"), ("   ", None), ("", None), (None, None)])
def test_clean_text(spark, text, clean):
    assert one(spark, X.clean_text("t"), t=text) == clean


@pytest.mark.parametrize(
    "product, category",
    [("PROD_0001", "CAT_01"), ("PROD_0500", "CAT_01"), ("PROD_0501", "CAT_02"), ("PROD_50000", "CAT_100"),
     ("ITEM_1", None), ("PROD_", None), ("PROD_99999999999", "CAT_200000000"), (None, None)],
)
def test_category_of(spark, product, category):
    assert one(spark, X.category_of("p", 500), p=product) == category


def test_region_of(spark):
    assert one(spark, X.region_of("s", C.REGIONS), s="AM") == "Norte"
    assert one(spark, X.region_of("s", C.REGIONS), s="??") == "Desconhecida"
    assert one(spark, X.region_of("s", C.REGIONS), s=None) == "Desconhecida"
    assert len(Domains().states) == 27


def test_malformed_values_become_null(spark):
    row = {f: "x" for f in C.SALES_FIELDS} | {"quantity": "3.0", "order_date": "31/12/2023"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    typed = normalize.type_sales(df).first()
    assert typed["quantity"] is None and typed["unit_price"] is None and typed["order_date"] is None
    assert typed["order_ts"] is None and typed["order_id"] == "X" and typed["status"] == "x"


def test_native_types_survive(spark, sales):
    typed = normalize.type_sales(sales({"order_id": "a"})).first()
    assert typed["quantity"] == 3 and typed["order_date"] == dt.date(2023, 8, 31) and typed["order_id"] == "A"


def test_conform_adds_only_what_is_absent(spark):
    df = normalize.conform(spark.range(1).select(F.lit("1").alias("order_id")))
    assert set(df.columns) == set(C.SALES_FIELDS)


def test_unite_fills_missing_columns(spark):
    a, b = spark.sql("select 1 x, 2 y"), spark.sql("select 3 y")
    assert sorted(map(tuple, normalize.unite([a, b]).collect()), key=str) == [(1, 2), (None, 3)]


def test_one_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", None)], "k string, v int").repartition(3)
    assert sorted(map(tuple, normalize.one_per_key(df, "k").collect())) == [("a", 1), ("b", None)]


# --- tolerance: the shortcut must agree with exact decimals ------------------
cents = st.integers(-10_000_000, 10_000_000).map(lambda n: Decimal(n) / 100)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(cents, st.integers(1, 500), cents, st.integers(-3, 3)), min_size=20, max_size=60))
def test_total_matches_equals_decimal_arithmetic(spark, rows):
    cases = [(float(q * p + Decimal(off) / 100) if i % 2 else float(t), q, float(p))
             for i, (t, q, p, off) in enumerate(rows)]
    df = spark.createDataFrame(cases, "total_amount double, quantity int, unit_price double")
    got = [r["ok"] for r in df.coalesce(1).select(total_matches(Decimal("0.01")).alias("ok")).collect()]
    want = [abs(Decimal(repr(t)) - q * Decimal(repr(p))) <= Decimal("0.01") for t, q, p in cases]
    assert got == want


# --- properties of the split ---------------------------------------------------
raw_sale = st.fixed_dictionaries(
    {
        "order_id": st.sampled_from(["A", "B", "C", None, " "]),
        "customer_id": st.sampled_from(["C1", "C9", None]),
        "status": st.sampled_from(["delivered", "erro", None]),
        "quantity": st.sampled_from([2, 0, None]),
        "order_ts": st.sampled_from([dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2)]),
    }
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(raw_sale, min_size=1, max_size=30))
def test_split_properties(spark, sales, registry, rows):
    valid, rejected = quarantine.split(sales(*rows), registry, sales_rules(Domains()))
    good, bad = valid.collect(), rejected.collect()
    assert len(good) + len(bad) == len(rows)
    assert len({r["order_id"] for r in good}) == len(good)
    for r in bad:
        assert r["_reasons"] and r["_main_reason"] == r["_reasons"][0]
        assert r["_dimension"] == r["_main_reason"].split(".")[0]
        if r["status"] is None:  # a missing value is reported once
            assert [x for x in r["_reasons"] if x.endswith(".status")] == ["completude.status"]
        if C.RULE_UNIQUENESS in r["_reasons"]:
            assert r["_reasons"] == [C.RULE_UNIQUENESS] and r["order_id"] in {g["order_id"] for g in good}


def test_failure_counts(spark, sales):
    rules = sales_rules(Domains(), integrity=False)
    counts = {r["rule"]: r["failures"] for r in failure_counts(sales({"status": None}, {"quantity": -1}), rules).collect()}
    assert counts["completude.status"] == 1 and counts["dominio.quantity_positiva"] == 1 and counts["dominio.status"] == 0


# --- marts ----------------------------------------------------------------------
def test_marts_without_billable_orders_give_null_not_an_error(spark, sales):
    df = normalize.enrich(sales({"status": "cancelled"}), 500)
    row = marts.revenue_by_state(df, Domains()).first()
    assert (row["revenue"], row["avg_ticket"], row["share_pct"], row["cancel_rate_pct"]) == (0.0, None, None, 100.0)
    month = marts.monthly_analysis(df, Domains()).first()
    assert month["growth_pct"] is None and month["running_revenue"] == 0.0


def test_kpis_of_nothing(spark, sales):
    df = normalize.enrich(sales({}), 500).filter("false")
    row = marts.kpis(df, marts.revenue_by_state(df, Domains()), "cancelled").first()
    assert row["top_state"] is None and row["avg_ticket"] is None and row["orders_billable"] == 0


def test_growth_is_against_the_row_before(spark, sales):
    df = normalize.enrich(
        sales({"order_date": dt.date(2023, 1, 5)}, {"order_date": dt.date(2023, 4, 5), "total_amount": 45.0}), 500
    )
    got = [(r["year_month"], r["growth_pct"]) for r in marts.monthly_analysis(df, Domains()).collect()]
    assert got == [("2023-01", None), ("2023-04", 100.0)]


def test_unmatched_dimensions_are_labelled(spark, sales):
    df = normalize.enrich(sales({"product_id": "ODD"}, {"customer_id": "C7"}), 500)
    customers = spark.createDataFrame([("K77", "Varejo")], "customer_id string, segment string")
    categories = spark.createDataFrame([("CAT_03", "Moda")], "category_id string, category_name string")
    mart = marts.category_by_segment(df, customers, categories, Domains())
    assert sorted((r["category_name"], r["segment"]) for r in mart.collect()) == [
        ("Moda", C.NO_SEGMENT), (C.NO_CATEGORY, "Varejo")
    ]


def test_two_categories_of_one_name_count_a_customer_once(spark, sales):
    df = normalize.enrich(sales({"product_id": "PROD_1"}, {"product_id": "PROD_501"}), 500)
    customers = spark.createDataFrame([("C1", "Varejo")], "customer_id string, segment string")
    categories = spark.createDataFrame([("CAT_01", "Moda"), ("CAT_02", "Moda")], "category_id string, category_name string")
    assert marts.category_by_segment(df, customers, categories, Domains()).first()["unique_customers"] == 1


# --- lookups, profiles, gates -------------------------------------------------------
def test_broadcast_only_within_the_bound(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.range(100).write.parquet(path)
    df = spark.read.parquet(path)
    assert lookups.fits_broadcast(df, Scale(broadcast_rows=100))
    assert not lookups.fits_broadcast(df, Scale(broadcast_rows=99))
    assert not lookups.fits_broadcast(df, Scale(broadcast_bytes=10))


def test_orphans_count_rows_and_null_keys(spark, sales, registry):
    df = sales({"customer_id": "C8"}, {"customer_id": "C8"}, {"customer_id": None}, {})
    got = {r["customer_id"]: r["orphans"] for r in lookups.orphan_rows(df, registry).collect()}
    assert got == {"C8": 2, None: 1}


def test_layer_flow(spark):
    row = profile.layer_flow(spark.range(10), spark.range(7), spark.range(3)).first()
    assert (row["bronze"], row["silver"], row["quarantine"], row["quarantine_rate"], row["conserved"]) == (10, 7, 3, 0.3, True)
    assert profile.layer_flow(spark.range(0), spark.range(0), spark.range(0)).first()["quarantine_rate"] is None


FACTS = {
    "bronze": 100, "silver": 95, "quarantine": 5, "outside_domain": 0, "distinct_orders": 95, "orphans": 0,
    **{f"empty_{f}": 0 for f in C.SALES_FIELDS},
}


@pytest.mark.parametrize(
    "change, failing",
    [
        ({}, []),
        ({"bronze": 101}, [C.CHECK_CONSERVATION]),
        ({"empty_status": 1}, [C.CHECK_COMPLETENESS]),
        ({"distinct_orders": 94}, [C.CHECK_UNIQUENESS]),
        ({"outside_domain": 1}, [C.CHECK_DOMAIN]),
        ({"orphans": 1}, [C.CHECK_INTEGRITY]),
        ({"silver": 80, "distinct_orders": 80, "quarantine": 20}, [C.CHECK_QUARANTINE_RATE]),
        ({"bronze": 9, "silver": 9, "distinct_orders": 9, "quarantine": 0}, [C.CHECK_VOLUME]),
        ({"bronze": 0, "silver": 0, "distinct_orders": 0, "quarantine": 0}, [C.CHECK_QUARANTINE_RATE, C.CHECK_VOLUME]),
    ],
)
def test_each_silver_check_can_fail(spark, change, failing):
    from oreworks.config import Limits

    facts = FACTS | change
    df = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} long" for k in facts))
    checks = gates.silver_checks(df, Domains(), Limits(silver_rows_min=10))
    assert [r["check"] for r in gates.failed_checks(checks).collect()] == failing
    outcome = gates.verdict(checks).first()
    assert outcome["verdict"] == ("FAILED" if failing else "PASSED") and outcome["checks_total"] == 7


GOLD = {
    "silver_revenue": Decimal("100.00"), "silver_orders": 10, "state_revenue": Decimal("100.00"), "states": 27,
    "negative_states": 0, "month_revenue": Decimal("100.99"), "month_orders": 10, "negative_months": 0,
    "payment_revenue": Decimal("99.01"), "category_revenue": Decimal("100.00"), "unlabelled": 0,
}


@pytest.mark.parametrize(
    "change, failing, verdict",
    [
        ({}, [], "PASSED"),
        ({"state_revenue": Decimal("101.00")}, [C.CHECK_STATE_REVENUE], "FAILED"),
        ({"month_revenue": Decimal("90.00")}, [C.CHECK_MONTH_REVENUE], "FAILED"),
        ({"payment_revenue": Decimal("0.00")}, [C.CHECK_PAYMENT_REVENUE], "FAILED"),
        ({"category_revenue": Decimal("0.00")}, [C.CHECK_CATEGORY_REVENUE], "FAILED"),
        ({"unlabelled": 2}, [C.CHECK_KNOWN_DIMENSIONS], "FAILED"),
        ({"month_orders": 9}, [C.CHECK_MONTH_ORDERS], "FAILED"),
        ({"states": 26}, [C.CHECK_STATES], "PASSED"),
        ({"negative_months": 1}, [C.CHECK_NEGATIVE_REVENUE], "FAILED"),
    ],
)
def test_each_gold_check_can_fail(spark, change, failing, verdict):
    from oreworks.config import Limits

    facts = GOLD | change
    kinds = {k: "decimal(30,2)" if k.endswith("revenue") else "long" for k in facts}
    df = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    checks = gates.gold_checks(df, Domains(), Limits())
    assert [r["check"] for r in gates.failed_checks(checks).collect()] == failing
    assert gates.verdict(checks).first()["verdict"] == verdict


def test_sets_in_tables_small_or_large(spark, sales):
    from oreworks.config import Scale
    from oreworks.operators.rules import domain_rules, failure_counts

    rows = sales({"shipping_state": "PE"}, {"shipping_state": "XX"}, {"shipping_state": None}, {"shipping_state": "SP"}, {"shipping_state": "SP"})
    table = spark.createDataFrame([("PE",), ("SP",), ("SP",), (None,), ("RJ",)], "code string")
    wanted = {r["rule"]: r["failures"] for r in failure_counts(rows, domain_rules(Domains())).collect()}
    for scale in (Scale(), Scale(broadcast_rows=0)):
        flagged = lookups.flag_members(rows, {"shipping_state": table}, scale)
        assert flagged.count() == 5
        found = failure_counts(flagged, domain_rules(Domains(), by_table=["shipping_state"])).collect()
        assert {r["rule"]: r["failures"] for r in found} == wanted


def test_months_without_sales_are_filled_in(spark, sales):
    import datetime as dt

    days = [dt.date(2023, 1, 5), dt.date(2023, 4, 5), dt.date(2023, 5, 1)]
    rows = normalize.enrich(sales(*({"order_id": str(d), "order_date": d} for d in days)), 500)
    found = marts.monthly_analysis(rows, Domains(), calendar=True).collect()
    assert [(r["year_month"], r["revenue"], r["growth_pct"]) for r in found] == [
        ("2023-01", 22.5, None), ("2023-02", 0.0, -100.0), ("2023-03", 0.0, None), ("2023-04", 22.5, None), ("2023-05", 22.5, 0.0)
    ]
    assert marts.monthly_analysis(rows.filter("false"), Domains(), calendar=True).isEmpty()
