"""What grows with the tables: rows that are moved, gathered or written on the way."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oreworks.config import Domains, Scale
from oreworks.operators import quarantine
from oreworks.operators.rules import sales_rules
from oreworks.sinks import tables
from oreworks.sources import readers
from oreworks.sources.readers import stored_rows
from testprofile import rawfiles as R
from testprofile import tables as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, sales, tmp_path):
    rows = sales(*({"order_id": f"N-{k % 700}", "quantity": k + 1, "total_amount": 7.5 * (k + 1)} for k in range(2000)))
    rows.repartition(3).write.parquet(str(tmp_path / "sales"))
    return stored_rows(spark, str(tmp_path / "sales")).withColumn("_source_priority", F.lit(0))


def test_a_long_list_of_rows_becomes_bits_and_moves_no_wide_row(spark, stored, registry):
    rules = sales_rules(Domains())
    tag = quarantine.tag_by_registry(registry)
    repeated = tables.stage(quarantine.repeated_rows(stored, tag, quarantine.repeat_suspects(stored), rules), "repeated")
    listed = quarantine.listed_rows(repeated, Scale(broadcast_rows=100), tables.stage)
    assert quarantine.BITS in listed.columns and listed.count() <= 3 < repeated.count()
    judged = quarantine.judge_by_exceptions(stored, quarantine.Exceptions(tag, listed), rules)
    wide = [x for x in plan(judged).splitlines() if "Exchange hashpartitioning" in x and "shipping_city" in x]
    assert wide == []
    got = {(r["file"], r["row"]) for r in judged.filter("_repeat").select("_row_id.*").collect()}
    assert got == {(r["file"], r["row"]) for r in repeated.select("_row_id.*").collect()} and len(got) == 1300
    assert judged.count() == 2000


def test_bits_of_positions_in_several_blocks(spark):
    """First and last positions of a byte and of a block, and files that the list doesn't name."""
    asked = [0, 1, 7, 8, 127, 128, 255, 32_767, 32_768, 65_535, 65_536, 100_000]
    rows = spark.createDataFrame([(f, k) for f in "ab" for k in asked], "file string, row bigint").select(
        F.struct("file", "row").alias("_row_id")
    )
    repeated = tables.stage(rows.filter("_row_id.file = 'a' AND _row_id.row NOT IN (1, 128, 32768)"), "repeated")
    listed = quarantine.listed_rows(repeated, Scale(broadcast_rows=5), tables.stage)
    assert quarantine.BITS in listed.columns
    found = quarantine._with_listed(rows, listed)
    assert found.count() == 24
    assert sorted(r["row"] for r in found.filter("_listed").select("_row_id.*").collect()) == sorted(set(asked) - {1, 128, 32_768})


def test_what_does_not_fit_as_bits_is_joined_as_it_is(spark, stored, registry):
    rules = sales_rules(Domains())
    tag = quarantine.tag_by_registry(registry)
    repeated = tables.stage(quarantine.repeated_rows(stored, tag, quarantine.repeat_suspects(stored), rules), "repeated")
    listed = quarantine.listed_rows(repeated, Scale(broadcast_bytes=10), tables.stage)
    assert listed.columns == ["_row_id"]
    judged = quarantine.judge_by_exceptions(stored, quarantine.Exceptions(tag, listed), rules)
    assert judged.filter("_repeat").count() == 1300


def test_many_suspects_do_not_shuffle_the_wide_rows(stored, registry):
    repeated = quarantine.repeated_rows(
        stored, quarantine.tag_by_registry(registry), quarantine.repeat_suspects(stored), sales_rules(Domains())
    )
    assert not [x for x in plan(repeated).splitlines() if "Exchange hashpartitioning" in x and "shipping_city" in x]


def test_lines_are_shuffled_once_however_many_customers_there_are(spark):
    """Without any broadcast, only the join with the orders moves the lines."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(R.sales_text(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    moved = [x for x in text.splitlines() if "Exchange hashpartitioning(" in x]
    assert len(moved) == 6 and sum("c_custkey" in x or "o_custkey" in x for x in moved) == 2


def test_stored_verdicts_are_the_lazy_ones_and_move_no_wide_row(spark, sales, registry, tmp_path):
    kinds = [{}, {"customer_id": "K1"}, {"status": "?"}, {"order_id": None}, {"quantity": None}]
    rows = sales(*(
        {"order_id": f"N-{k % 70}", "shipping_city": f"c{k % 9}", "quantity": 3, **kinds[k * k % 7 % 5]} for k in range(400)
    ))
    rows.repartition(3).write.parquet(str(tmp_path / "sales"))
    rows = stored_rows(spark, str(tmp_path / "sales")).withColumn("_source_priority", F.lit(0))
    rows = rows.unionByName(rows.filter("shipping_city = 'c2'"))  # copies that share an identity
    rules, few = sales_rules(Domains()), Scale(broadcast_rows=20)
    lazy = quarantine.judge(rows, registry, rules, ("shipping_city",))
    kept = quarantine.judge(rows, registry, rules, ("shipping_city",), stage=tables.stage, scale=few)
    facts = lambda df: sorted(map(str, df.select("_row_id", "shipping_city", "_repeat", "_reasons").collect()))
    assert facts(kept) == facts(lazy) == facts(
        quarantine.judge(rows, registry, rules, ("shipping_city",), stage=tables.stage)
    )
    assert kept.filter("_repeat").count() > 20 and quarantine.valid_rows(kept).count() > 5
    assert not [x for x in plan(kept).splitlines() if "Exchange hashpartitioning" in x and "shipping_city" in x]


def test_customers_are_flagged_before_the_lines_meet_them(spark):
    """However many customers there are, the joins move the lines once; what a gate stores moves them no more."""
    bound, sf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "/root/testdata/sf0.001"
    before = quarantine.judge(P.sales(spark, sf), P.registry(spark, sf), sales_rules(P.DOMAINS), P.ORDER)
    written = []

    def stage(df, name):
        written.append((name, plan(df)))
        return tables.stage(df, name)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        judged = P.judged(spark, sf, stage)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    moved = [x for x in dict(written)["checked"].splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("l_orderkey" in x.split(",")[0] for x in moved) == 1
    assert not [x for x in moved if "l_partkey" in x and "l_orderkey" not in x.split(",")[0]]
    columns = ["_row_id", "customer_id", "_customer_known", "_repeat", "_reasons"]
    assert sorted(map(str, judged.select(columns).collect())) == sorted(map(str, before.select(columns).collect()))


def test_pages_are_compressed_whole_documents_that_nothing_gathers(spark, tmp_path, monkeypatch):
    rows = spark.range(2500).select(F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, "x").alias("status")).repartition(3)
    monkeypatch.setattr("pyspark.sql.functions.collect_list", None)
    path = str(tmp_path / "pages")
    R.write_pages(rows, path, rows=400)
    spec = replace(R.SOURCES[1], schema=None)
    read = readers.read_records_json(spark, f"{path}/{spec.pattern}", spec)
    assert sorted((r["order_id"], r["status"]) for r in read.collect()) == [(k, None if k % 2 else "x") for k in range(2500)]
    sizes = [r["count"] for r in read.groupBy("_source_file").count().collect()]
    assert max(sizes) <= 400 and 7 <= len(sizes) <= 12 and all(f.endswith(".gz") for f in read.inputFiles())


def test_the_one_document_is_made_from_stored_rows(spark, tmp_path, monkeypatch):
    """The task that writes the document reads rows that many tasks have made; it runs no join itself."""
    staged = []
    monkeypatch.setattr(R, "stage", lambda df, name: staged.append(name) or tables.stage(df, name))
    left = spark.range(300).withColumnRenamed("id", "k")
    R.write_one_document(left.join(spark.range(300).withColumnRenamed("id", "k"), "k"), str(tmp_path / "document"))
    lines = spark.read.text(str(tmp_path / "document"))
    assert staged == ["document-rows"] and lines.count() == 301 and len(lines.inputFiles()) == 1


def test_derived_columns_are_made_behind_the_shuffle(stored, registry, tmp_path):
    from oreworks.config import Settings
    from oreworks.plans import silver

    judged = quarantine.judge_by_exceptions(
        stored.withColumns({c: F.lit("x") for c in ("_batch_id", "_data_ref")}),
        quarantine.Exceptions(quarantine.tag_by_registry(registry), stored.select("_row_id").limit(0)), sales_rules(Domains()),
    )
    text = silver.both_sides(judged, Settings(str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("RebalancePartitions")
    assert "_motivos" in above and "category_id" in above and "array_compact" not in below.lower() and "CAT_" not in below
