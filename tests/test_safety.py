"""What must not be lost: stored layers when a run fails, rows when ways of loading meet, sources that bring nothing."""

import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks import contract as C
from oreworks.config import Settings
from oreworks.operators import lookups, normalize, profile
from oreworks.config import Scale, pin_time_zone
from oreworks.plans import bronze, gate, run
from oreworks.sinks import tables
from oreworks.sources.checks import sources_ready
from oreworks.sources.readers import read_bronze, read_layer, read_source
from oreworks.streaming import arrivals
from rawfiles import CSV_HEADER, CSV_LINES, write_raw


def test_a_late_header_leaves_every_stored_table(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path))
    bronze.run_bronze(spark, settings)
    odd = ";".join(reversed(CSV_HEADER.split(";")))
    (tmp_path / "raw" / "vendas_csv" / "z.csv").write_text(f"{odd}\n{';'.join('x' * 11)}\n", encoding="ISO-8859-1")
    with pytest.raises(Exception, match="(?i)header"):
        bronze.run_bronze(spark, settings)
    stats = {r["_source"]: r["rows"] for r in bronze.bronze_stats(spark, settings).collect()}
    assert stats == {"vendas_csv": 5, "vendas_json": 2, "vendas_parquet": 40, "clientes": 5, "categorias": 1}
    # What the failed run wrote is gone: one version of each source is left.
    assert len([p for p in (tmp_path / "bronze").rglob("v=*")]) == 5


def test_a_failing_write_keeps_the_table_and_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(spark.range(5), path)
    with pytest.raises(Exception):
        tables.overwrite(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert tables.read(spark, path).count() == 5
    tables.overwrite(tables.read(spark, path).filter("id > 2"), path)
    assert tables.read(spark, path).count() == 2


def test_a_document_that_does_not_parse_stops_the_read(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path))
    (tmp_path / "raw" / "vendas_json" / "page9.json").write_text('{"page": 9, "data": [{"order_id": ')
    with pytest.raises(Exception):
        read_source(spark, settings.sources[1], settings).collect()


@pytest.mark.parametrize("steps", ["batch stream", "stream batch", "stream batch stream", "batch stream batch stream"])
def test_batch_and_incremental_bronze_in_any_order(spark, tmp_path, steps):
    write_raw(spark, tmp_path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in CSV_HEADER.split(";")])
    settings = Settings(str(tmp_path))
    spec = replace(settings.sources[0], schema=text)
    expected = 5
    for k, step in enumerate(steps.split()):
        line = CSV_LINES[0].replace("p1", f"extra{k}")
        (tmp_path / "raw" / "vendas_csv" / f"n{k}.csv").write_text(f"{CSV_HEADER}\n{line}\n", encoding="ISO-8859-1")
        expected += 1
        if step == "batch":
            bronze.run_bronze(spark, settings)
        else:
            arrivals.append_new_files(spark, spec, settings)
        held = read_bronze(spark, settings, spec)
        assert held.count() == held.select("cod_pedido").distinct().count() == expected


def test_a_lake_without_raw_files_is_not_ready(spark, tmp_path):
    settings = Settings(str(tmp_path))
    assert [r["ready"] for r in sources_ready(spark, settings).collect()] == [False] * 5
    with pytest.raises(run.SourcesNotReady):
        run.run(spark, settings)


def test_a_source_without_rows_is_reported(spark):
    rows = spark.createDataFrame([("a", "f1"), ("a", "f2")], "_source string, _source_file string")
    found = sorted(tuple(r) for r in profile.source_stats(rows, ["a", "b"]).collect())
    assert found == [("a", 2, 2), ("b", 0, 0)]


def test_the_most_complete_and_latest_customer_stays(spark):
    rows = spark.createDataFrame(
        [("k1", None, "PE", None, "2023-01-01"), ("K1", "Olinda", "PE", "varejo", "2020-01-01"),
         ("K2", "A", "PE", "varejo", "2020-01-01"), ("k2", "B", "PE", "varejo", "2022-01-01")],
        "customer_id string, city string, state string, segment string, registration_date string",
    )
    found = {r["customer_id"]: r for r in normalize.customers_dimension(rows).collect()}
    assert (found["K1"]["customer_city"], found["K1"]["segment"]) == ("Olinda", "Varejo")
    assert found["K2"]["customer_city"] == "B" and len(found) == 2


def test_checks_are_stored_in_full_and_stages_go(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path), run_id="2023/a b").with_limits(silver_rows_min=10, quarantine_rate_max=0.2)
    row = run.run(spark, settings).first()
    assert row["marts"].split(",") == sorted(
        f"{m}={read_layer(spark, settings, m).count()}" for m in ("gold_state", "gold_month", "gold_payment", "gold_category")
    )
    stored = gate.read_checks(spark, settings, "silver").collect()
    assert [tuple(r) for r in stored] == [tuple(r) for r in gate.evaluate(spark, settings, "silver").collect()]
    assert {"expected", "blocking"} <= set(stored[0].asDict())
    assert not list(pathlib.Path(tmp_path, "_stage").iterdir())


def test_the_size_check_moves_no_row(spark):
    df = spark.range(1000)
    text = df.agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in text
    assert lookups.fits_broadcast(df, Scale(broadcast_rows=1000)) and not lookups.fits_broadcast(df, Scale(broadcast_rows=999))


def test_the_time_zone_is_a_setting(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, month in (("UTC", "2023-03"), ("America/Sao_Paulo", "2023-02")):
            pin_time_zone(spark, Settings("x", time_zone=zone))
            day = spark.range(1).select(F.lit("2023-03-01T01:00:00Z").alias("t")).select(F.to_timestamp("t").alias("t"))
            assert day.select(F.date_format("t", "yyyy-MM")).first()[0] == month
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    pin_time_zone(spark, Settings("x"))
    assert spark.conf.get("spark.sql.session.timeZone") == before


def test_product_numbers_beyond_an_int(spark):
    from oreworks.functions import columns as X

    rows = spark.createDataFrame([("PROD_5000000001",)], "p string")
    assert rows.select(X.category_of("p", 500)).first()[0] == f"{C.CATEGORY_PREFIX}10000001"
