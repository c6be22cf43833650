"""The registered queries: each has its SQL, and a cross-section is compared here.

``tools/compare.py`` compares all of them, also on larger tables.
"""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from testprofile import tables as P
from testprofile.layer_queries import TABLES
from testprofile.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="the test tables are not here")

SAMPLE = (
    "a3_revenue_by_state", "a4_monthly", "a6_category_segment", "a7_kpis", "q8_reasons", "q9_valid", "q9_quarantine",
    "q12_sample_per_reason", "w6_keep_first", "g1_g7_unclean_silver", "g8_g15_gold_gate", "l7_quarantine_alert",
    "p4_typed_projection", "p6_minimize_customers", "s2_paged_json", "s9_readiness", "l1_incremental_bronze", "t1_sorted_marts", "l3_gold_category", "l1_bronze", "s7_layer_reread", "l6_summary",
)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert by_name(df.columns, df.collect()) == by_name(columns, result.fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and set(entry.queries()) >= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_known_counts_of_the_quarantine(spark):
    judged = P.judged(spark, SF)
    reasons = judged.selectExpr("get(_reasons, 0) AS main").groupBy("main").count().collect()
    assert {r["main"]: r["count"] for r in reasons} == {
        None: 2501,
        "completude.payment_method": 1149,
        "consistencia.total_calculado": 939,
        "dominio.order_date_no_periodo": 378,
        "dominio.shipping_state": 175,
        "integridade.customer_id": 258,
        "unicidade.order_id": 600,
    }
