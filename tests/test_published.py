"""Publishing by pointer: a stop anywhere leaves old or new rows, and nothing stays behind for long."""

import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oreworks.config import Settings
from oreworks.operators.rules import sales_rules
from oreworks.operators import quarantine
from oreworks.plans import bronze, run, silver
from oreworks.sinks import published as P
from oreworks.sinks import tables
from oreworks.sources.readers import read_bronze, read_layer
from rawfiles import CSV_HEADER, CSV_LINES, write_raw


def versions(root):
    return sorted(str(p.relative_to(root)) for p in pathlib.Path(root).rglob("v=*"))


def test_versions_replace_add_and_retire(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        with P.publication(spark, root) as new:
            new.replace("t", new.write(spark.range(n + 1).write, "folder/t"))
    now = P.published(spark, root)
    assert P.scan(spark, root, now["t"]).count() == 5 and P.scan(spark, root, now["t"]).columns == ["id"]
    # Only the versions of the last two pointers are kept.
    assert len(versions(root)) == 2 and len(P._numbers(spark, root)) == 2
    with P.publication(spark, root) as new:
        new.add("t", new.write(spark.range(100, 103).write, "folder/t"))
    assert P.scan(spark, root, P.published(spark, root)["t"]).count() == 8


@pytest.mark.parametrize("step", ["write", "pointer", "retire"])
def test_a_stop_at_any_step_leaves_old_or_new_rows_of_all_tables(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)

    def fill(n):
        with P.publication(spark, root) as new:
            for table in "abc":
                new.replace(table, new.write(spark.range(n).write, table))

    fill(1), fill(2)
    calls = []

    def stop(real):
        def run(*arguments, **options):
            calls.append(1)
            if len(calls) == (2 if step == "write" else 1):
                raise KeyboardInterrupt
            return real(*arguments, **options)
        return run

    if step == "write":
        monkeypatch.setattr(P.Publication, "write", stop(P.Publication.write))
    else:
        monkeypatch.setattr(P, {"pointer": "_write_pointer", "retire": "_retire"}[step], stop(getattr(P, f"_{'write_pointer' if step == 'pointer' else 'retire'}")))
    if step == "retire":  # the pointer is written by then, so what it names must not be removed
        monkeypatch.setattr(P.Publication, "discard", lambda self: None)
    with pytest.raises(KeyboardInterrupt):
        fill(3)
    monkeypatch.undo()
    now = P.published(spark, root)
    assert {t: P.scan(spark, root, now[t]).count() for t in "abc"} == dict.fromkeys("abc", 3 if step == "retire" else 2)
    fill(4)
    assert {P.scan(spark, root, P.published(spark, root)[t]).count() for t in "abc"} == {4}


def test_two_who_publish_at_once_both_count(spark, tmp_path):
    root = str(tmp_path)
    first, second = P.Publication(spark, root), P.Publication(spark, root)
    first.replace("a", first.write(spark.range(1).write, "a"))
    second.replace("b", second.write(spark.range(2).write, "b"))

    def late(now):
        if not P.published(spark, root):
            first.commit()  # someone else is faster between reading and writing
        return {**now, "b": ["x"]}

    assert set(P.publish(spark, root, late)) == {"a", "b"}


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(30).select("id", F.concat(F.lit("p"), F.col("id") % 3).alias("part"))
    tables.overwrite_by_partition(rows, path, "part")
    tables.overwrite_by_partition(rows.where("part = 'p1' AND id > 20"), path, "part", "dynamic")
    found = tables.read(spark, path).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in found} == {"p0": 10, "p1": 3, "p2": 10}
    text = tables.read(spark, path).where("part = 'p2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text


def test_a_later_source_that_fails_leaves_all_five_as_they_were(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path))
    bronze.run_bronze(spark, settings)
    before = versions(tmp_path)
    (tmp_path / "raw" / "vendas_csv" / "more.csv").write_text(f"{CSV_HEADER}\n{CSV_LINES[0]}\n", encoding="ISO-8859-1")
    for file in (tmp_path / "raw" / "clientes").glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:200] + b"broken" * 20 + file.read_bytes()[320:])
    with pytest.raises(Exception):
        bronze.run_bronze(spark, settings)
    assert versions(tmp_path) == before
    assert read_bronze(spark, settings, settings.sources[0]).count() == 5


def test_silver_and_quarantine_come_from_one_scan(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path)).with_limits(silver_rows_min=10, quarantine_rate_max=0.2)
    run.run(spark, settings)
    now = P.published(spark, settings.root)
    # Both sides are partitions of one written version.
    assert len({P._version(leaf) for t in ("silver_sales", "quarantine") for leaf in now[t]}) == 1
    customers = read_layer(spark, settings, "silver_customers").select("customer_id")
    sales = silver.bronze_sales(spark, settings)
    found = silver.find_exceptions(sales, customers, settings)
    judged = quarantine.judge_by_exceptions(sales, found, sales_rules(settings.domains))
    text = silver.both_sides(judged, settings)._jdf.queryExecution().optimizedPlan().toString()
    # Each of the three sources is judged once.
    assert text.count("shipping_state") and text.count("IN (credit_card") == 1 and text.count("Relation") <= 3 + 3


def test_an_empty_side_is_a_table_too(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path))
    strict = replace(settings, domains=replace(settings.domains, period=("1990-01-01", "1990-01-02")))
    bronze.run_bronze(spark, strict)
    silver.run_silver(spark, strict)
    assert read_layer(spark, strict, "silver_sales").count() == 0
    assert read_layer(spark, strict, "quarantine").count() == 47
