import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oreworks.config import Domains
from oreworks.operators import lookups, quarantine
from oreworks.operators.rules import sales_rules
from sales_layout import SALE


def verdicts(rows, registry, **options):
    valid, rejected = quarantine.split(rows, registry, sales_rules(Domains()), **options)
    return (
        [r["order_id"] for r in valid.collect()],
        {r["order_id"]: r["_reasons"] for r in rejected.collect()},
    )


def test_a_sound_sale_is_kept(sales, registry):
    assert verdicts(sales({}), registry) == (["N-1"], {})


# One way to break each field, and what is said about it.
BREAKS = {
    "unknown payment": ({"payment_method": "barter"}, ["dominio.payment_method"]),
    "blank payment": ({"payment_method": "   "}, ["completude.payment_method", "dominio.payment_method"]),
    "no state": ({"shipping_state": None}, ["completude.shipping_state"]),
    "foreign state": ({"shipping_state": "TX"}, ["dominio.shipping_state"]),
    "unknown status": ({"status": "lost"}, ["dominio.status"]),
    "no city": ({"shipping_city": None}, ["completude.shipping_city"]),
    "nothing sold": ({"quantity": 0, "total_amount": 0.0}, ["dominio.quantity_positiva", "dominio.total_amount_positivo"]),
    "refund": ({"quantity": -3, "total_amount": -22.5}, ["dominio.quantity_positiva", "dominio.total_amount_positivo"]),
    "free": ({"unit_price": 0.0, "total_amount": 0.0}, ["dominio.unit_price_positivo", "dominio.total_amount_positivo"]),
    "before the period": ({"order_date": dt.date(2022, 12, 31)}, ["dominio.order_date_no_periodo"]),
    "wrong sum": ({"total_amount": 2250.0}, ["consistencia.total_calculado"]),
    "stranger": ({"customer_id": "K78"}, ["integridade.customer_id"]),
    "no price": ({"unit_price": None}, ["completude.unit_price"]),
    "two gaps": ({"product_id": None, "order_date": None}, ["completude.product_id", "completude.order_date"]),
}


@pytest.mark.parametrize("change, reasons", BREAKS.values(), ids=BREAKS)
def test_a_broken_field_is_named(sales, registry, change, reasons):
    kept, rejected = verdicts(sales({"order_id": "N-9", **change}), registry)
    assert kept == [] and sorted(rejected["N-9"]) == sorted(reasons)


@pytest.mark.parametrize("price, quantity", [(7.5, 3), (1e12, 2), (0.1, 3), (123456789.12, 1000)])
def test_a_cent_is_tolerated_at_any_amount(sales, registry, price, quantity):
    from decimal import Decimal

    exact = Decimal(str(price)) * quantity
    totals = {"at": exact, "above": exact + Decimal("0.01"), "below": exact - Decimal("0.01"), "far": exact + Decimal("0.02")}
    rows = [{"order_id": k, "unit_price": price, "quantity": quantity, "total_amount": float(t)} for k, t in totals.items()]
    kept, rejected = verdicts(sales(*rows), registry)
    assert set(kept) == {"at", "above", "below"} and rejected == {"far": ["consistencia.total_calculado"]}


def test_amounts_beyond_a_decimal_are_compared_as_they_are(sales, registry):
    rows = [
        {"order_id": "huge", "unit_price": 1e35, "quantity": 2, "total_amount": 2e35},
        {"order_id": "off", "unit_price": 1e35, "quantity": 2, "total_amount": 3e35},
        {"order_id": "plus", "unit_price": 1e12, "quantity": 2, "total_amount": 2e12 + 1},
    ]
    kept, rejected = verdicts(sales(*rows), registry)
    assert kept == ["huge"] and set(rejected) == {"off", "plus"}


def test_one_row_of_a_number_is_kept(sales, registry):
    at = lambda hour: dt.datetime(2023, 8, 31, hour)
    rows = sales(
        {"order_id": "N-2", "order_ts": at(9)}, {"order_id": "N-2", "order_ts": at(7), "status": "lost"},
        {"order_id": "N-2", "order_ts": at(8)}, {"order_id": "N-3"}, {"order_id": "N-2", "order_ts": at(8)},
    )
    valid, rejected = quarantine.split(rows, registry, sales_rules(Domains()))
    kept = {(r["order_id"], r["order_ts"].hour) for r in valid.collect()}
    assert kept == {("N-2", 8), ("N-3", 22)}
    assert sorted(r["_main_reason"] for r in rejected.collect()) == ["dominio.status"] + ["unicidade.order_id"] * 2


def test_the_first_arrival_is_kept_whatever_its_source(sales, registry):
    from oreworks.config import Settings

    today, yesterday = dt.datetime(2023, 9, 2), dt.datetime(2023, 9, 1)
    rows = sales(
        {"order_id": "N-4", "_ingestion_ts": today, "_source": "vendas_csv"},
        {"order_id": "N-4", "_ingestion_ts": yesterday, "_source": "vendas_json"},
    ).withColumn("_source_priority", F.when(F.col("_source") == "vendas_csv", 0).otherwise(1))
    valid, _ = quarantine.split(rows, registry, sales_rules(Domains()), order_by=Settings("x").keep_first_by)
    assert [r["_source"] for r in valid.collect()] == ["vendas_json"]


def test_more_rules_than_bits(sales, registry):
    from oreworks.operators.rules import Rule

    many = [Rule(f"r.{k}", "r", "", ("quantity",), F.col("quantity") != k) for k in range(200)]
    rows = sales(*({"order_id": f"N-{q}", "quantity": q} for q in (5, 62, 63, 64, 150, 500)))
    valid, bad = quarantine.split(rows, registry, many)
    assert [r["order_id"] for r in valid.collect()] == ["N-500"]
    assert {r["order_id"]: r["_reasons"] for r in bad.collect()} == {f"N-{q}": [f"r.{q}"] for q in (5, 62, 63, 64, 150)}
    assert not any(c.startswith("_failed") for c in valid.columns + bad.columns)


def test_rejected_rows_tell_why_and_when(sales, registry):
    _, rejected = quarantine.split(sales({"unit_price": None, "status": "lost"}), registry, sales_rules(Domains()))
    row = rejected.first()
    assert (row["_main_reason"], row["_dimension"]) == ("completude.unit_price", "completude")
    assert row["_quarantined_at"] is not None
    assert not {"_row_id", "_customer_known", "_repeat"} & set(rejected.columns)


def messy_rows(sale, n=3000, seed=7):
    """Random sales: a third share one order, one customer or are exact copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        third = rng.random() < 1 / 3
        rows.append(
            sale(
                order_id="HOT" if third else f"O{rng.randrange(n)}",
                customer_id=rng.choice(["K77", "K77", "K77", "C2", None]),
                status=rng.choice(["delivered", "delivered", "cancelled", "erro"]),
                shipping_state=rng.choice(["SP", "RJ", "XX", None]),
                order_ts=dt.datetime(2023, 1, 1) + dt.timedelta(days=0 if third else rng.randrange(50)),
                _source_file=f"f{rng.randrange(3)}",
            )
        )
    return rows


def brute_force(rows, columns):
    """Row counts per (order, reasons) by a plain loop."""
    seen, out = set(), {}
    dicts = [dict(zip(columns, r)) for r in rows]
    order = sorted(range(len(dicts)), key=lambda i: (dicts[i]["_source_file"], dicts[i]["order_ts"]))
    for i in order:
        d = dicts[i]
        reasons = []
        if d["customer_id"] is None:
            reasons.append("completude.customer_id")
        if d["shipping_state"] is None:
            reasons.append("completude.shipping_state")
        if d["status"] == "erro":
            reasons.append("dominio.status")
        if d["shipping_state"] == "XX":
            reasons.append("dominio.shipping_state")
        if d["customer_id"] == "C2":
            reasons.append("integridade.customer_id")
        if not reasons:
            if d["order_id"] in seen:
                reasons = ["unicidade.order_id"]
            seen.add(d["order_id"])
        k = (d["order_id"], tuple(reasons))
        out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("way", ["lazy", "registry", "unknown"])
def test_hot_keys_and_both_ways_match_brute_force(spark, sale, registry, tmp_path, way):
    from oreworks.sources.readers import stored_rows

    rows = messy_rows(sale)
    spark.createDataFrame(rows, SALE).repartition(5).write.parquet(str(tmp_path / "sales"))
    stored = stored_rows(spark, str(tmp_path / "sales")).withColumn("_source_priority", F.lit(0))
    rules = sales_rules(Domains())
    if way == "lazy":
        judged = quarantine.judge(stored, registry, rules)
    else:
        if way == "registry":
            tag = quarantine.tag_by_registry(registry)
        else:
            tag = quarantine.tag_by_unknown(lookups.unknown_keys(stored, registry))
        suspects = quarantine.repeat_suspects(stored)
        repeated = quarantine.repeated_rows(stored, tag, suspects, rules)
        judged = quarantine.judge_by_exceptions(stored, quarantine.Exceptions(tag, repeated), rules)
    got = {
        (r["order_id"], tuple(r["_reasons"])): r["count"]
        for r in judged.groupBy("order_id", "_reasons").count().collect()
    }
    columns = [c.split()[0] for c in SALE.split(", ")]
    assert got == brute_force(rows, columns)


def test_sample_takes_the_first_row_per_main_reason(spark, sales, registry):
    rows = sales(
        {"order_id": "B", "status": "x"}, {"order_id": "A", "status": "x"}, {"order_id": "C", "customer_id": "C9"}
    )
    _, rejected = quarantine.split(rows, registry, sales_rules(Domains()))
    picked = quarantine.sample_per_reason(rejected, ["order_id"])
    assert sorted(r["order_id"] for r in picked.collect()) == ["A", "C"]
