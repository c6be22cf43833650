"""Missing and unreadable values told apart, in rules, quarantine and the report of a source."""

from oreworks import contract as C
from oreworks.config import Domains, SourceSpec
from oreworks.operators import normalize, quarantine
from oreworks.operators.rules import completeness_rules, sales_rules, typing_rules, with_reasons
from oreworks.sources.typed import type_report

GOOD = {
    "order_id": "n-1", "customer_id": "k77", "product_id": "prod_1204", "quantity": "3", "unit_price": "7.5",
    "total_amount": "22.5", "order_date": "2023-08-31 22:05:00", "payment_method": "boleto", "shipping_city": "Olinda",
    "shipping_state": "pe", "status": "shipped",
}
UNREADABLE = {"quantity": "3.0", "unit_price": "7,5", "total_amount": "n/a", "order_date": "31/08/2023"}


def text_sales(spark, *changes):
    rows = [tuple((GOOD | {"order_id": f"n-{i}"} | c).values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in GOOD))


def test_each_bad_value_has_one_reason(spark):
    cases = [({f: v}, f"tipo.{f}") for f, v in UNREADABLE.items()]
    cases += [({f: v}, f"completude.{f}") for f in C.NATIVE_FIELDS for v in (None, "", "  ")] + [({}, None)]
    df = normalize.type_sales(text_sales(spark, *(c for c, _ in cases)), raw=True)
    rules = [*completeness_rules(C.SALES_FIELDS, typed=True), *typing_rules()]
    found = {r["order_id"]: r["_reasons"] for r in with_reasons(df, rules).collect()}
    assert found == {f"N-{i}": [name] if name else [] for i, (_, name) in enumerate(cases)}


def test_quarantine_shows_what_was_sent(spark, registry):
    df = normalize.normalize_sales(text_sales(spark, {}, {"quantity": "few"}, {"order_date": None}), raw=True)
    stamped = df.selectExpr("*", "'s' AS _source", "'f' AS _source_file", "timestamp'2023-09-02' AS _ingestion_ts")
    valid, rejected = quarantine.split(stamped, registry, sales_rules(Domains(), typed=True))
    assert [r["order_id"] for r in valid.collect()] == ["N-0"]
    sent = {r["order_id"]: (r["quantity"], r["_raw"]["quantity"], r["_raw"]["order_date"]) for r in rejected.collect()}
    assert sent == {"N-1": (None, "few", GOOD["order_date"]), "N-2": (3, "3", None)}


def test_untyped_rules_stay_as_they_were(spark):
    names = [r.name for r in sales_rules(Domains())]
    assert not any(n.startswith(C.TYPING) for n in names) and normalize.RAW not in normalize.type_sales(text_sales(spark, {})).columns
    assert [n for n in (r.name for r in sales_rules(Domains(), typed=True)) if not n.startswith(C.TYPING)] == names


def report(df, **types):
    types = {path.replace("__", "[]."): kind for path, kind in types.items()}
    rows = type_report({"s": df}, [SourceSpec("s", "parquet", "*", (), types=types)]).collect()
    return {r["field"]: tuple(r)[3:] for r in rows}


def test_report_of_flat_and_nested_fields(spark):
    item = "struct<price:string,tags:array<struct<n:string>>>"
    df = spark.createDataFrame([
        ("1", 2.0, [("7", [("1",), ("x",)]), (" ", None), None]),
        ("x", None, [("dear", [(None,), None])]),
        ("", 3.5, []),
        (None, 1.0, None),
    ], f"a string, b double, items array<{item}>")
    types = dict(a="int", b="int", items__price="double", items__tags__n="int", items__gone="int", c="date", items="int")
    expected = {
        "a": ("string", True, 4, 2, 1),
        "b": ("double", True, 4, 1, 0),
        "items[].price": ("string", True, 4, 2, 1),
        "items[].tags[].n": ("string", True, 4, 2, 1),
        "items[].gone": (None, False, 0, 0, 0),
        "c": (None, False, 0, 0, 0),
        "items": (f"array<{item}>", True, 4, 1, 3),
    }
    assert report(df, **types) == expected
    empty = report(df.limit(0), **types)
    assert {f: row[2:] for f, row in empty.items()} == {f: (0, 0, 0) for f in expected}
    assert report(df, **{"items": f"array<{item}>"})["items"][2:] == (4, 1, 0)
