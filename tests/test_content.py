"""Digests of rows against the rows themselves."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Settings
from oreworks.operators import content
from oreworks.plans import gate, silver
from oreworks.plans.bronze import run_bronze
from oreworks.sinks import tables
from oreworks.sinks.published import publication
from oreworks.sources.readers import read_layer
from rawfiles import write_raw

LAYOUT = "_source string, a string, b int"
VALUE = st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from(["", "1", None]), st.sampled_from([0, 1, None]))
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(before=st.lists(VALUE, max_size=6), moved=st.lists(st.booleans(), min_size=6, max_size=6), extra=st.lists(VALUE, max_size=1), lost=st.booleans())
def test_same_exactly_when_the_rows_are_the_same(spark, before, moved, extra, lost):
    after = [[r for r, m in zip(before, moved) if m == side] for side in (False, True)]
    after[0] += extra
    if lost and after[1]:
        after[1].pop()
    compared = content.differences(
        spark.createDataFrame(before, LAYOUT), [spark.createDataFrame(a, LAYOUT) for a in after], ("a", "b")
    )
    got = {r["_source"]: (r["rows_before"], r["rows_after"], r["same"]) for r in compared.collect()}
    have, kept = Counter(before), Counter(after[0] + after[1])
    expected = {}
    for group in {r[0] for r in [*have, *kept]}:
        one, other = ({r: n for r, n in c.items() if r[0] == group} for c in (have, kept))
        expected[group] = (sum(one.values()), sum(other.values()), one == other)
    assert got == expected


def test_nulls_keep_their_place(spark):
    def made(*row):
        return content.digest(spark.createDataFrame([row], "a string, b string"), ("a", "b")).first()

    digests = {tuple(made(*r)) for r in [("v", None), (None, "v"), ("v", "v"), (None, None), ("", None), (None, "")]}
    assert len(digests) == 6


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "_source string, a string, _rows int, _sign int, _first int, same int")
    assert tuple(content.digest(empty, ("a",)).first()) == (0, 0, 0)
    gate = content.content_gate(empty, [empty, empty], ("a", "_rows")).first()
    assert (gate["status"], gate["value"]) == ("PASS", '{"groups":0,"missing":0}')
    row = spark.createDataFrame([("s", "v", 1, 5, 2, 3)], empty.schema)
    gate = content.content_gate(row, [empty], ("a", "_rows", "_sign")).first()
    assert (gate["check"], gate["status"], gate["value"]) == (C.CHECK_CONTENT, "FAIL", '{"groups":1,"missing":1}')
    assert content.content_gate(row, [empty, row], ("a", "same")).first()["status"] == "PASS"


def test_large_sums_stay_exact(spark):
    many = spark.range(200_000).selectExpr("'s' AS _source", "id AS a")
    other = many.selectExpr("_source", "CASE WHEN a = 7 THEN 8 ELSE a END AS a")
    assert content.content_gate(many, [many.filter("a % 3 = 0"), many.filter("a % 3 <> 0")], ("a",)).first()["status"] == "PASS"
    assert content.content_gate(many, [other], ("a",)).first()["value"] == '{"groups":1,"missing":0}'


def test_one_narrow_shuffle(spark):
    """Digests collapse in the tasks; no row of a table is moved."""
    table = spark.range(1000).selectExpr("'s' AS _source", "id AS a")
    plan = content.differences(table, [table], ("a",))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan and "Window" not in plan and "Python" not in plan


def test_a_run_keeps_its_rows(spark, tmp_path):
    """The gate over stored layers: passes after a run, fails when a stored row changed though counts did not."""
    run = Settings(str(tmp_path / "lake"), run_id="content")
    write_raw(spark, run.root)
    run_bronze(spark, run)
    silver.run_silver(spark, run)
    assert gate.run_gate(spark, run, "content").first()["status"] == "PASS"
    changed = read_layer(spark, run, "silver_sales").withColumn("quantity", F.expr("quantity + int(order_id = 'J1')"))
    with publication(spark, run.root) as new:
        rows = tables.in_layout(changed, "silver_sales").withColumn("_veredito", F.lit("valida")).write
        new.replace("silver_sales", new.write(rows, C.FOLDERS["silver_sales"], ["_veredito", "ano_mes"]))
    counts = {r["check"]: r["status"] for r in gate.evaluate(spark, run, "silver").collect()}
    assert counts[C.CHECK_CONSERVATION] == "PASS"
    failed = gate.evaluate(spark, run, "content").first()
    assert (failed["status"], failed["value"]) == ("FAIL", '{"groups":1,"missing":0}')
