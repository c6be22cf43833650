import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Settings
from oreworks.operators import gates, quarantine
from oreworks.operators.rules import sales_rules
from oreworks.plans import bronze, gate, run, silver
from oreworks.sinks import metrics
from oreworks.sources.checks import SchemaDriftError, column_report, sources_ready
from oreworks.sinks.published import published, scan
from oreworks.sources.readers import read_bronze, read_layer, read_source
from rawfiles import CSV_HEADER, write_raw


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """A whole run over small raw files."""
    root = str(tmp_path_factory.mktemp("lake"))
    write_raw(spark, root)
    settings = Settings(root, run_id="r1", data_ref="2023-12-31").with_limits(silver_rows_min=10, quarantine_rate_max=0.2)
    row = run.run(spark, settings).first()
    return settings, row


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bronze_keeps_text_and_counts_files(spark, finished):
    settings, _ = finished
    stats = {r["_source"]: (r["rows"], r["files"]) for r in bronze.bronze_stats(spark, settings).collect()}
    assert stats["vendas_csv"] == (5, 2) and stats["vendas_json"] == (2, 2) and stats["clientes"][0] == 5
    csv = read_bronze(spark, settings, settings.sources[0])
    assert csv.schema["qtd"].dataType.typeName() == "string"
    assert csv.filter("cod_pedido = ' p1 '").first()["cidade_entrega"] == "São Paulo"
    assert str(csv.first()["_data_ref"]) == "2023-12-31" and csv.first()["_batch_id"] == "r1"


def test_silver_and_quarantine(spark, finished):
    settings, row = finished
    assert (row["bronze"], row["silver"], row["quarantine"], row["conserved"]) == (47, 43, 4, True)
    rejected = read_layer(spark, settings, "quarantine")
    assert rows(rejected, "order_id", F.array_join("_reasons", ",")) == [
        ("P1", "unicidade.order_id"),
        ("P3", "completude.quantity"),
        ("P4", "completude.order_date"),
        ("P5", "integridade.customer_id"),
    ]
    # the delimited source comes first, so its copy of P1 stays
    kept = read_layer(spark, settings, "silver_sales").filter("order_id = 'P1'").first()
    assert kept["_source"] == "vendas_csv" and kept["category_id"] == "CAT_01"
    assert (kept["payment_method"], kept["shipping_state"], kept["status"]) == ("pix", "SP", "delivered")


def test_names_on_disk(spark, finished):
    settings, _ = finished
    now = published(spark, settings.root)
    assert "ano_mes" in scan(spark, settings.root, now["silver_sales"]).columns
    assert "_motivos" in scan(spark, settings.root, now["quarantine"]).columns
    assert scan(spark, settings.root, now["gold_state"]).columns[:4] == [
        "ranking_faturamento", "uf", "regiao", "faturamento"
    ]
    january = [leaf for leaf in now["silver_sales"] if leaf.endswith("/ano_mes=2023-01")]
    assert len(january) == 1 and january[0].startswith(f"{C.FOLDERS['silver_sales']}/")
    assert pathlib.Path(settings.root, january[0]).is_dir()


def test_customers_are_minimized_and_unique(spark, finished):
    settings, _ = finished
    df = read_layer(spark, settings, "silver_customers")
    assert not {"name", "email"} & set(df.columns)
    assert rows(df, "customer_id", "segment") == [("C1", "Varejo"), ("C2", "Atacado"), ("C3", "Varejo")]
    assert rows(df.filter("registration_date is null"), "customer_id") == [("C2",)]


def test_marts_reconcile(spark, finished):
    settings, row = finished
    state = read_layer(spark, settings, "gold_state")
    assert state.agg(F.round(F.sum("revenue"), 2)).first()[0] == row["revenue"]
    assert (row["silver_gate"], row["gold_gate"]) == ("PASSED (7/7)", "PASSED (7/8)")
    month = read_layer(spark, settings, "gold_month").orderBy("year_month").collect()
    assert month[0]["previous_revenue"] is None and month[-1]["running_revenue"] == pytest.approx(row["revenue"])
    categories = read_layer(spark, settings, "gold_category")
    assert {r["category_name"] for r in categories.collect()} == {"Eletrônicos", "Moda"}


def test_months_prune_partitions(spark, finished):
    settings, _ = finished
    df = read_layer(spark, settings, "silver_sales", months=("2023-02", "2023-03"))
    assert {r[0] for r in df.select("year_month").distinct().collect()} == {"2023-02", "2023-03"}
    assert "PartitionFilters: [isnotnull(ano_mes" in df._jdf.queryExecution().toString()


def test_one_pass_marts_equal_the_separate_ones(spark, finished):
    from oreworks.operators import marts

    settings, _ = finished
    sales = read_layer(spark, settings, "silver_sales")
    d = settings.domains
    for table, separate in (
        ("gold_state", marts.revenue_by_state(sales, d)),
        ("gold_month", marts.monthly_analysis(sales, d)),
        ("gold_payment", marts.revenue_by_payment(sales, d)),
    ):
        assert rows(read_layer(spark, settings, table), *separate.columns) == rows(separate, *separate.columns)


def test_lazy_way_equals_the_stored_result(spark, finished):
    settings, _ = finished
    customers = read_layer(spark, settings, "silver_customers")
    sales = silver.bronze_sales(spark, settings)
    judged = quarantine.judge(sales, customers, sales_rules(settings.domains))
    expect = rows(read_layer(spark, settings, "quarantine"), "order_id", "_source", F.array_join("_reasons", ","))
    assert rows(judged.filter(F.size("_reasons") > 0), "order_id", "_source", F.array_join("_reasons", ",")) == expect


def test_small_bounds_change_the_way_not_the_result(spark, finished):
    """With nothing allowed to be broadcast, the same rows are kept and rejected."""
    from oreworks.config import Scale

    settings, _ = finished
    strict = replace(settings, scale=Scale(broadcast_rows=0))
    customers = read_layer(spark, settings, "silver_customers").select("customer_id")
    sales = silver.bronze_sales(spark, settings)
    found = silver.find_exceptions(sales, customers, strict)
    judged = quarantine.judge_by_exceptions(sales, found, sales_rules(settings.domains))
    stored = read_layer(spark, settings, "quarantine")
    names = F.array_join("_reasons", ",")
    assert rows(quarantine.quarantined_rows(judged), "order_id", names) == rows(stored, "order_id", names)
    assert quarantine.valid_rows(judged).count() == 43


def test_rerun_changes_nothing_but_the_history(spark, finished):
    settings, _ = finished
    before = read_layer(spark, settings, "silver_sales").count()
    again = run.run(spark, settings).first()
    assert (again["bronze"], again["silver"], again["quarantine"]) == (47, before, 4)
    history = read_layer(spark, settings, "history")
    assert history.columns == ["executed_at", "data_ref", "run_id", "layer", "check", "dimension", "status", "value"]
    assert history.count() == 2 * (7 + 8)
    assert metrics.read_metrics(spark, settings, "silver").filter("metric = 'bronze'").count() == 1


def test_alert_rows(spark, finished):
    settings, _ = finished
    alert = run.quarantine_alert(spark, settings)
    assert ("total", "", 4) in rows(alert, "about", "item", "rows")
    assert ("source", "vendas_csv", 3) in rows(alert, "about", "item", "rows")
    empty = read_layer(spark, settings, "quarantine").filter("false")
    assert run.alert_rows(empty).count() == 0


def test_failed_gate_is_recorded_and_stops_gold(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path), run_id="r2").with_limits(silver_rows_min=1000, quarantine_rate_max=0.2)
    with pytest.raises(gates.QualityGateError, match="volume_minimo_silver"):
        run.run(spark, settings)
    history = read_layer(spark, settings, "history")
    assert rows(history.filter("status = 'FAIL'"), "check", "value") == [("volume_minimo_silver", "43")]
    assert not pathlib.Path(settings.folder("gold_state")).exists()
    failing = gates.failed_checks(gate.evaluate(spark, settings, "silver"))
    assert rows(failing, "check") == [("volume_minimo_silver",)]


def test_readiness_names_the_missing_source(spark, tmp_path):
    write_raw(spark, tmp_path)
    settings = Settings(str(tmp_path))
    assert all(r["ready"] for r in sources_ready(spark, settings).collect())
    (pathlib.Path(tmp_path) / "raw" / "categorias" / "categorias.json").write_text("")
    waiting = {r["source"] for r in sources_ready(spark, settings).filter("not ready").collect()}
    assert waiting == {"categorias"}
    with pytest.raises(run.SourcesNotReady, match="categorias"):
        run.run(spark, settings)


def test_drift_stops_before_anything_is_written(spark, tmp_path):
    write_raw(spark, tmp_path)
    folder = pathlib.Path(tmp_path) / "raw" / "vendas_csv"
    for name in ("a.csv", "b.csv"):
        text = (folder / name).read_text(encoding="ISO-8859-1")
        (folder / name).write_text(text.replace("situacao", "estado", 1), encoding="ISO-8859-1")
    settings = Settings(str(tmp_path))
    with pytest.raises(SchemaDriftError, match="situacao"):
        bronze.run_bronze(spark, settings)
    assert not pathlib.Path(settings.folder("bronze")).exists()
    csv = settings.sources[0]
    report = column_report({csv.name: read_source(spark, csv, settings)}, [csv])
    assert rows(report.filter("not present"), "column") == [("situacao",)]


def test_one_file_with_another_header_stops_the_read(spark, tmp_path):
    write_raw(spark, tmp_path)
    odd = pathlib.Path(tmp_path) / "raw" / "vendas_csv" / "c.csv"
    columns = CSV_HEADER.split(";")
    odd.write_text(";".join(reversed(columns)) + "\n" + ";".join("x" * 11) + "\n", encoding="ISO-8859-1")
    settings = Settings(str(tmp_path))
    with pytest.raises(Exception, match="(?i)header"):
        read_source(spark, settings.sources[0], settings).collect()


def test_limits_from_environment():
    from oreworks.config import Limits

    limits = Limits.from_env({C.SILVER_ROWS_ENV: "7", C.QUARANTINE_RATE_ENV: "0.5"})
    assert (limits.silver_rows_min, limits.quarantine_rate_max) == (7, 0.5)
