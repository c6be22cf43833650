"""Scans, sinks, projections and whole runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks import contract as C
from oreworks.config import Settings, SourceSpec
from oreworks.functions import columns as X
from oreworks.operators import gates, marts, normalize
from oreworks.operators.rules import completeness_rules, failure_counts, typing_rules, with_reasons
from oreworks.plans import bronze, gate, run
from oreworks.sinks import appended, metrics, tables
from oreworks.sinks.published import size_of
from oreworks.sources import checks, pages, readers, typed
from oreworks.streaming import arrivals
from testprofile import oracle as O
from testprofile import rawfiles as R
from testprofile import tables as P
from testprofile.registry import query
from testprofile.rule_queries import gold_gate_sql, silver_gate_sql

D = P.DOMAINS
CSV, JSON, PARQUET, CUSTOMERS, CATEGORIES = R.SOURCES
AT = "yyyy-MM-dd HH:mm:ss"
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in C.CSV_RENAMES])


def _scratch(spark, name):
    return tables.scratch_path(spark, name)


# --- sources -----------------------------------------------------------------
@query("s1_delimited", O.with_sales("""
SELECT order_id AS cod_pedido, customer_id AS cod_cliente, product_id AS cod_produto, quantity::varchar AS qtd,
  unit_price AS preco_unit, total_amount AS valor_total, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS data_pedido,
  payment_method AS forma_pagamento, shipping_city AS cidade_entrega, shipping_state AS uf_entrega, status AS situacao
FROM sales"""))
def s1(spark, sf):
    path = _scratch(spark, "csv")
    R.write_delimited(R.sales_text(spark, sf), path)
    df = readers.read_delimited(spark, f"{path}/{CSV.pattern}", CSV).drop("_source_file")
    return df.withColumns({c: F.col(c).cast("double") for c in ("preco_unit", "valor_total")})


@query("s2_paged_json", O.with_sales("""
SELECT order_id, customer_id, product_id, quantity::bigint AS quantity, unit_price, total_amount,
  strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_date, payment_method, shipping_city, shipping_state, status
FROM sales"""))
def s2(spark, sf):
    path = _scratch(spark, "pages")
    R.write_pages(R.sales_text(spark, sf), path)
    return readers.read_records_json(spark, f"{path}/{JSON.pattern}", JSON).drop("_source_file")


@query("s2_split_json", O.with_sales("""
SELECT order_id, customer_id, product_id, quantity::bigint AS quantity, unit_price, total_amount,
  strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_date, payment_method, shipping_city, shipping_state, status, true AS by_many_tasks
FROM sales"""))
def s2_split(spark, sf):
    """All sales in one document, which several tasks read."""
    path = _scratch(spark, "document")
    rows = R.sales_text(spark, sf)
    R.write_one_document(rows, path)
    layout = T.StructType([T.StructField(f.name, T.LongType() if f.name == "quantity" else f.dataType) for f in rows.schema])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Several parts of a small document too; a compressed one is small sooner.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(256 * 1024, max(size_of(spark, [path])[1] // 4, 1))))
    try:
        read = readers.READERS["split_records_json"](spark, path, replace(JSON, schema=pages.document_of(layout)))
        parts = read.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return read.drop("_source_file").withColumn("by_many_tasks", F.lit(parts > 1))


@query("s3_parquet_sales", "SELECT *, true AS from_file FROM lineitem")
def s3(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/lineitem.parquet", PARQUET)
    return df.withColumn("from_file", F.col("_source_file").endswith("lineitem.parquet")).drop("_source_file")


@query("s4_parquet_customers", "SELECT * FROM customer")
def s4(spark, sf):
    return readers.read_parquet(spark, f"{sf}/customer.parquet", CUSTOMERS).drop("_source_file")


@query("s5_nested_json", """
SELECT printf('CAT_%02d', ceil((p_partkey + 1) / 500)::int) AS category_id,
  'SUB_' || (p_partkey + 1) AS subcategory_id, min(p_name) AS subcategory_name FROM part GROUP BY p_partkey""")
def s5(spark, sf):
    path = _scratch(spark, "categories")
    R.write_documents(P.nested_categories(spark, sf), path)
    documents = readers.read_document_json(spark, f"{path}/*.json", CATEGORIES)
    entries = documents.select(F.explode("categorias").alias("c"))
    return entries.select("c.category_id", F.explode("c.subcategories").alias("s")).select(
        "category_id", "s.subcategory_id", "s.subcategory_name"
    )


PER_SOURCE = """
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'vendas_csv' WHEN 1 THEN 'vendas_json' ELSE 'vendas_parquet' END AS source,
  count(*)::bigint AS rows FROM lineitem GROUP BY 1
UNION ALL SELECT 'clientes', count(*) FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'categorias', count(DISTINCT p_partkey // 25000) FROM part"""


@query("s6_registry", O.with_sales(f"""
SELECT source, rows, keys, amount FROM ({PER_SOURCE}) JOIN (
  SELECT CASE split_part(order_id, '-', 2)::int % 3 WHEN 0 THEN 'vendas_csv' WHEN 1 THEN 'vendas_json' ELSE 'vendas_parquet' END AS source,
    count(DISTINCT order_id)::bigint AS keys, sum(total_amount::decimal(18,2))::double AS amount FROM sales GROUP BY 1
  UNION ALL SELECT 'clientes', count(DISTINCT c_custkey), NULL FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'categorias', count(DISTINCT ceil((p_partkey + 1) / 500)), NULL FROM part) USING (source)"""))
def s6(spark, sf):
    """Rows of every registered source, the keys among them and, of sales, their amount."""
    settings = R.finished(spark, sf)
    prepared = bronze.prepare(spark, settings)
    found = []
    for spec in settings.sources:
        df = prepared[spec.name]
        if spec.is_sales:
            df = normalize.normalize_sales(df, spec.renames)
        elif spec.name == C.CATEGORIES:
            df = df.select(F.col("categorias.category_id").alias("category_id"))
        amount = F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double") if spec.is_sales else F.lit(None).cast("double")
        # Category documents are one row each; their keys are those of all categories in them.
        keys = F.sum(F.size("category_id")) if spec.name == C.CATEGORIES else F.count_distinct("order_id" if spec.is_sales else "customer_id")
        found.append(df.agg(F.count("*").alias("rows"), keys.alias("keys"), amount.alias("amount")).withColumn("source", F.lit(spec.name)))
    return normalize.unite(found)


# The whole run keeps the first row by source and then by the fields a source sends.
RUN_ORDER = "order_ts, product_id, total_amount, quantity, status, customer_id"


_SOLD = """order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date,
  lower(payment_method) AS payment_method, shipping_city, shipping_state, lower(status) AS status"""


@query("s7_layer_reread", O.with_judged(f"""
SELECT 'silver' AS layer, {_SOLD}, category_id, year_month FROM valid
UNION ALL BY NAME SELECT 'quarantine' AS layer, {_SOLD}, array_to_string(reasons, ',') AS reasons FROM rejected
UNION ALL BY NAME SELECT 'customers' AS layer, * FROM (
  SELECT 'C' || c_custkey AS customer_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS customer_city,
    n_name AS customer_state, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2020-01-01' + (c_custkey % 365)::int END AS registration_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0)
UNION ALL BY NAME SELECT 'categories' AS layer, printf('CAT_%02d', c) AS category_id, 'Category ' || printf('%02d', c) AS category_name,
  count(DISTINCT p_partkey)::int AS subcategory_count
  FROM (SELECT p_partkey, ceil((p_partkey + 1) / 500)::int AS c FROM part) GROUP BY c""", order=RUN_ORDER))
def s7_layers(spark, sf):
    """Every row of every Silver layer, with all that does not depend on when and where the run was."""
    settings = R.finished(spark, sf)
    layers = {
        "silver": ("silver_sales", [*C.SALES_FIELDS, "category_id", "year_month"]),
        "quarantine": ("quarantine", [*C.SALES_FIELDS, F.array_join("_reasons", ",").alias("reasons")]),
        "customers": ("silver_customers", ["customer_id", "customer_city", "customer_state", "segment", "registration_date"]),
        "categories": ("silver_categories", ["category_id", "category_name", "subcategory_count"]),
    }
    return normalize.unite(
        readers.read_layer(spark, settings, layer).select(F.lit(name).alias("layer"), *columns)
        for name, (layer, columns) in layers.items()
    )


@query("s7_month_range", O.with_judged(
    f"SELECT {_SOLD}, category_id, year_month FROM valid WHERE year_month BETWEEN '1996-02' AND '1996-05'", order=RUN_ORDER))
def s7(spark, sf):
    kept = readers.read_layer(spark, R.finished(spark, sf), "silver_sales", months=("1996-02", "1996-05"))
    return kept.select(*C.SALES_FIELDS, "category_id", "year_month")


OWED = {"lineitem": ("l_orderkey", "l_quantity", "order_id"), "customer": ("c_custkey", "segment")}


@query("s8_contract", """
SELECT 'lineitem' AS source, 'l_orderkey' AS "column", true AS present, count(l_orderkey)::bigint AS filled FROM lineitem
UNION ALL SELECT 'lineitem', 'l_quantity', true, count(l_quantity) FROM lineitem
UNION ALL SELECT 'lineitem', 'order_id', false, 0
UNION ALL SELECT 'customer', 'c_custkey', true, count(c_custkey) FROM customer
UNION ALL SELECT 'customer', 'segment', false, 0""")
def s8(spark, sf):
    specs = [SourceSpec(name, "parquet", "*.parquet", columns) for name, columns in OWED.items()]
    return checks.column_report({name: P.table(spark, sf, name) for name in OWED}, specs)


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query("s9_readiness", f"""
SELECT source, rows > 0 AS has_files, rows > 0 AS ready FROM ({PER_SOURCE})
UNION ALL SELECT 'devolucoes', false, false""")
def s9(spark, sf):
    """Readiness as a run asks for it, of all sources and of one that never came."""
    settings = R.finished(spark, sf)
    owed = replace(settings, sources=(*settings.sources, SourceSpec("devolucoes", "parquet", "*.parquet", ())))
    return checks.sources_ready(spark, owed).select("source", (F.col("files") > 0).alias("has_files"), "ready")


# --- sinks ---------------------------------------------------------------------
@query("k1_overwrite", O.with_sales("SELECT status, count(*)::bigint AS rows FROM sales GROUP BY 1"))
def k1(spark, sf):
    path = _scratch(spark, "overwrite")
    rows = P.sales(spark, sf).select("order_id", "status")
    tables.overwrite(rows, path)
    tables.overwrite(rows, path)
    return tables.read(spark, path).groupBy("status").agg(F.count("*").alias("rows"))


@query("k2_partitioned_overwrite", O.with_sales(
    "SELECT year_month, count(*)::bigint AS rows FROM sales "
    "WHERE NOT (year_month LIKE '1996%' AND status = 'R') GROUP BY 1"))
def k2(spark, sf):
    """Static write of all months, then a dynamic one that replaces the months of one year."""
    path = _scratch(spark, "by-month")
    rows = P.silver_sales(spark, sf).select("order_id", "status", "year_month")
    tables.overwrite_by_partition(rows, path, "year_month", "static")
    corrected = rows.filter(F.col("year_month").like("1996%") & X.billable(D.cancelled))
    tables.overwrite_by_partition(corrected, path, "year_month", "dynamic")
    return tables.read(spark, path).groupBy("year_month").agg(F.count("*").alias("rows"))


@query("k3_single_file", O.with_sales(
    f"SELECT payment, revenue, orders_total, 1::bigint AS files FROM ({O.PAYMENT_SELECT})", O.metrics("payment_method")))
def k3(spark, sf):
    path = _scratch(spark, "mart")
    tables.overwrite_small(marts.revenue_by_payment(P.silver_sales(spark, sf), D), path)
    written = tables.read(spark, path).select("*", F.col("_metadata.file_path").alias("file"))
    return written.groupBy("payment", "revenue", "orders_total").agg(F.count_distinct("file").alias("files"))


@query("k4_history", O.with_sales("""
SELECT layer, run_id, "check", status, count(*)::bigint AS entries FROM (
  SELECT 'silver' AS layer, unnest(['a', 'b']) AS run_id, 'volume_minimo_silver' AS "check",
    CASE WHEN count(*) >= 1000 THEN 'PASS' ELSE 'FAIL' END AS status FROM sales)
GROUP BY ALL"""))
def k4(spark, sf):
    path = _scratch(spark, "history")
    n = F.col("silver")
    counted = P.sales(spark, sf).agg(F.count("*").alias("silver"))
    check = gates.Check(C.CHECK_VOLUME, C.VOLUME, n >= P.LIMITS.silver_rows_min, n, F.lit("enough"))
    rows = gates.check_rows(counted, [check])
    for run_id in ("a", "b"):
        tables.append(tables.publish_names(gates.history_rows(rows, "silver", run_id, "2000-12-31")), path)
    history = readers.adopt_names(tables.read(spark, path))
    return history.groupBy("layer", "run_id", "check", "status").agg(F.count("*").alias("entries"))


@query("k4_merged_appends", O.with_sales(
    "SELECT shipping_state, count(*)::bigint AS rows, sum(quantity)::bigint AS quantity, true AS few_files FROM sales GROUP BY 1"))
def k4_merged(spark, sf):
    """Sales appended in twenty parts, and merged whenever four folders are alike."""
    path = _scratch(spark, "appends")
    part = F.col("l_partkey") % 20
    rows = tables.stage(P.sales(spark, sf).select("shipping_state", "quantity", part.alias("part")), "parts")
    for i in range(20):
        appended.append(rows.filter(F.col("part") == i).drop("part").coalesce(1), path, fan=4)
    stored = tables.read(spark, path)
    files = len(stored.inputFiles())
    return stored.groupBy("shipping_state").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("quantity")
    ).withColumn("few_files", F.lit(files < 10))


@query("k5_metrics", O.with_sales(
    "SELECT 'demo' AS stage, 'rows' AS metric, _source AS key, count(*)::varchar AS value FROM sales GROUP BY _source"))
def k5(spark, sf):
    settings = Settings(_scratch(spark, "metrics"), run_id="k5")
    counted = P.sales(spark, sf).groupBy("_source").agg(F.count("*").alias("rows"))
    for _ in range(2):  # a stage that ran twice shows its latest figures only
        metrics.save_metrics(metrics.metric_rows(counted, "demo", "k5", "2000-12-31", key="_source"), settings)
    return metrics.read_metrics(spark, settings, "demo").select("stage", "metric", "key", "value")


# --- projections ------------------------------------------------------------------
@query("p1_lineage",
       "SELECT 'lines' AS _source, 'b1' AS _batch_id, DATE '2000-12-31' AS _data_ref, l_returnflag, true AS stamped, "
       "count(*)::bigint AS rows FROM lineitem GROUP BY l_returnflag")
def p1(spark, sf):
    df = normalize.add_lineage(P.table(spark, sf, "lineitem"), "lines", "b1", "2000-12-31")
    stamped = F.col("_ingestion_ts").isNotNull() & F.col("_source_file").endswith(".parquet")
    return df.groupBy("_source", "_batch_id", "_data_ref", "l_returnflag", stamped.alias("stamped")).agg(
        F.count("*").alias("rows")
    )


@query("p2_rename", O.with_sales("SELECT order_id, customer_id, status, total_amount FROM sales"))
def p2(spark, sf):
    foreign = R.sales_text(spark, sf).withColumnsRenamed({new: old for old, new in C.CSV_RENAMES.items()})
    return normalize.rename_fields(foreign, C.CSV_RENAMES).select("order_id", "customer_id", "status", "total_amount")


@query("p3_conform", O.with_sales(
    "SELECT order_id, total_amount, NULL::varchar AS shipping_city, NULL::varchar AS status FROM sales"))
def p3(spark, sf):
    short = R.sales_text(spark, sf).drop("shipping_city", "status")
    return normalize.conform(short).select("order_id", "total_amount", "shipping_city", "status")


def _sloppy(spark, sf):
    """Sales as text, with blanks, mixed case and values that do not parse."""
    key = F.regexp_extract("product_id", r"(\d+)", 1).cast("int")
    return R.sales_text(spark, sf).select(
        F.concat(F.lit(" o"), "order_id", F.lit(" ")).alias("order_id"),
        F.lower("customer_id").alias("customer_id"),
        F.lower("product_id").alias("product_id"),
        F.when(key % 7 == 0, F.lit("3.0")).when(key % 7 == 1, F.lit("few")).otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(key % 11 == 0, F.lit("n/a")).otherwise(F.col("unit_price").cast("string")).alias("unit_price"),
        F.col("total_amount").cast("string").alias("total_amount"),
        F.when(key % 13 == 0, F.lit("soon")).when(key % 13 == 1, F.substring("order_date", 1, 10)).otherwise(F.col("order_date")).alias("order_date"),
        F.concat(F.col("payment_method"), F.lit(" ")).alias("payment_method"),
        F.when(key % 5 == 0, F.lit("   ")).otherwise(F.col("shipping_city")).alias("shipping_city"),
        F.lower("shipping_state").alias("shipping_state"),
        F.upper("status").alias("status"),
    )


@query("p4_typed_projection", O.with_sales("""
SELECT upper('o' || order_id) AS order_id, customer_id, product_id,
  CASE WHEN (l_partkey + 1) % 7 IN (0, 1) THEN NULL ELSE quantity END AS quantity,
  CASE WHEN (l_partkey + 1) % 11 = 0 THEN NULL ELSE unit_price END AS unit_price, total_amount,
  CASE WHEN (l_partkey + 1) % 13 = 0 THEN NULL ELSE order_date END AS order_date,
  CASE WHEN (l_partkey + 1) % 13 = 0 THEN NULL ELSE strftime(order_ts, '%Y-%m-%d %H:%M:%S') END AS order_ts,
  lower(payment_method) AS payment_method, CASE WHEN (l_partkey + 1) % 5 = 0 THEN NULL ELSE shipping_city END AS shipping_city,
  shipping_state, lower(status) AS status
FROM sales"""))
def p4(spark, sf):
    return normalize.type_sales(_sloppy(spark, sf)).withColumn("order_ts", F.date_format("order_ts", AT))


def _spoilt(spark, sf):
    """Sloppy sales where some totals are blank and some dates are missing."""
    key = F.regexp_extract("product_id", r"(\d+)", 1).cast("int")
    return _sloppy(spark, sf).withColumns({
        "total_amount": F.when(key % 17 == 0, F.lit("  ")).otherwise(F.col("total_amount")),
        "order_date": F.when(key % 19 != 0, F.col("order_date")),
    })


def _typed_rules():
    return [*completeness_rules(D.required, typed=True), *typing_rules()]


# (rule, condition of a good spoilt row), where k is the product's number
TYPED_CONDITIONS = {
    **{f"completude.{f}": "true" for f in D.required}, **{f"tipo.{f}": "true" for f in C.NATIVE_FIELDS},
    "completude.total_amount": "k % 17 <> 0", "completude.order_date": "k % 19 <> 0",
    "completude.payment_method": "payment_method IS NOT NULL", "completude.shipping_city": "k % 5 <> 0",
    "tipo.quantity": "k % 7 NOT IN (0, 1)", "tipo.unit_price": "k % 11 <> 0",
    "tipo.order_date": "k % 13 <> 0 OR k % 19 = 0",
}
KEYED = "keyed AS (SELECT *, l_partkey + 1 AS k FROM sales)"
TYPED_LIST = ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in TYPED_CONDITIONS.items())


@query("q1_typing_rules", O.with_sales(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({c}))::bigint AS failures FROM keyed" for n, c in TYPED_CONDITIONS.items()
), KEYED))
def q1_typing(spark, sf):
    """Missing values and values that did not parse, counted apart for each field."""
    return failure_counts(normalize.type_sales(_spoilt(spark, sf), raw=True), _typed_rules())


@query("q8_typed_reasons", O.with_sales(f"""
SELECT upper('o' || order_id) AS order_id, product_id,
  CASE k % 7 WHEN 0 THEN '3.0' WHEN 1 THEN 'few' ELSE quantity::varchar END AS sent_quantity,
  CASE WHEN k % 7 NOT IN (0, 1) THEN quantity END AS quantity,
  array_to_string(list_filter([{TYPED_LIST}], lambda x: x IS NOT NULL), ',') AS reasons
FROM keyed""", KEYED))
def q8_typed(spark, sf):
    """Every row with the quantity as it came, as it was read, and its reasons."""
    rows = with_reasons(normalize.type_sales(_spoilt(spark, sf), raw=True), _typed_rules())
    sent = F.col(f"{normalize.RAW}.quantity").alias("sent_quantity")
    return rows.select("order_id", "product_id", sent, "quantity", F.array_join("_reasons", ",").alias("reasons"))


SUBCATEGORIES = "array<struct<subcategory_id:string,subcategory_name:string>>"
TYPES = {
    C.SALES_JSON: {"quantity": "int", "unit_price": "double", "total_amount": "double", "order_date": "date", "discount": "double"},
    C.CATEGORIES: {
        "categorias[].category_id": "string", "categorias[].subcategories": SUBCATEGORIES,
        "categorias[].subcategories[].subcategory_id": "int", "categorias[].subcategories[].price": "double",
    },
}


def _typed_sql():
    def line(source, path, physical, values, missing="0", unparsed="0", origin=""):
        known = f"'{physical}'" if physical else "NULL::varchar"
        return (
            f"SELECT '{source}' AS source, '{path}' AS field, '{TYPES[source][path]}' AS expected, {known} AS physical, "
            f"{str(bool(physical)).lower()} AS present, {values}::bigint AS \"values\", {missing}::bigint AS missing, "
            f"{unparsed}::bigint AS unparsed {origin}"
        )

    def bad(condition):
        return f"count(*) FILTER ({condition})"

    sales, item, part = (C.SALES_JSON, "categorias[].subcategories", "FROM part")
    codes = "count(DISTINCT ceil((p_partkey + 1) / 500))"
    return O.with_sales(" UNION ALL ".join([
        line(sales, "quantity", "string", "count(*)", "0", bad("k % 7 IN (0, 1)"), "FROM keyed"),
        line(sales, "unit_price", "string", "count(*)", "0", bad("k % 11 = 0"), "FROM keyed"),
        line(sales, "total_amount", "string", "count(*)", bad("k % 17 = 0"), "0", "FROM keyed"),
        line(sales, "order_date", "string", "count(*)", bad("k % 19 = 0"), bad("k % 13 = 0 AND k % 19 <> 0"), "FROM keyed"),
        line(sales, "discount", "", "0"),
        line(C.CATEGORIES, "categorias[].category_id", "string", codes, origin=part),
        line(C.CATEGORIES, item, SUBCATEGORIES, codes, origin=part),
        line(C.CATEGORIES, f"{item}[].subcategory_id", "string", "count(DISTINCT p_partkey)", "0", "count(DISTINCT p_partkey)", part),
        line(C.CATEGORIES, f"{item}[].price", "", "0"),
    ]), KEYED)


@query("s8_typed_contract", _typed_sql())
def s8_typed(spark, sf):
    """Declared and physical types, missing values and values that did not parse, nested fields included."""
    frames = {C.SALES_JSON: _spoilt(spark, sf), C.CATEGORIES: P.nested_categories(spark, sf)}
    return typed.type_report(frames, [replace(spec, types=TYPES[spec.name]) for spec in (JSON, CATEGORIES)])


@query("p5_text_normalize", """
SELECT c_custkey, nullif(trim(t), '') AS clean, upper(nullif(trim(t), '')) AS upper_case,
  lower(nullif(trim(t), '')) AS lower_case,
  upper(nullif(trim(t), '')[1]) || lower(nullif(trim(t), '')[2:]) AS initial
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '   ' ELSE '  ' || lower(c_mktsegment) || ' ' END AS t FROM customer)""")
def p5(spark, sf):
    spaced = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    )
    clean = X.clean_text(spaced)
    return P.table(spark, sf, "customer").select(
        "c_custkey", clean.alias("clean"), F.upper(clean).alias("upper_case"), F.lower(clean).alias("lower_case"),
        F.initcap(clean).alias("initial"),
    )


MINIMIZED = """
SELECT 'C' || c_custkey AS customer_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS customer_city,
  n_name AS customer_state, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2020-01-01' + (c_custkey % 365)::int END AS registration_date
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query("p6_minimize_customers", MINIMIZED)
def p6(spark, sf):
    return normalize.minimize_customers(P.raw_customers(spark, sf))


@query("p7_flatten_categories", """
SELECT printf('CAT_%02d', c) AS category_id, 'Category ' || printf('%02d', c) AS category_name,
  count(DISTINCT p_partkey)::int AS subcategory_count
FROM (SELECT p_partkey, ceil((p_partkey + 1) / 500)::int AS c FROM part) GROUP BY c""")
def p7(spark, sf):
    return normalize.flatten_categories(P.nested_categories(spark, sf))


@query("p8_category_derivation", """
SELECT product_id, CASE WHEN product_id LIKE 'PROD%' THEN printf('CAT_%02d', ceil((l_partkey + 1) / 500)::int) END AS category_id,
  count(*)::bigint AS rows
FROM (SELECT l_partkey, CASE WHEN l_partkey % 10 = 9 THEN 'ITEM_' ELSE 'PROD_' END || (l_partkey + 1) AS product_id FROM lineitem)
GROUP BY ALL""")
def p8(spark, sf):
    odd = F.when(F.col("l_partkey") % 10 == 9, F.lit("ITEM_")).otherwise(F.lit("PROD_"))
    coded = P.table(spark, sf, "lineitem").select(F.concat(odd, F.col("l_partkey") + 1).alias("product_id"))
    return coded.groupBy("product_id", X.category_of("product_id", D.products_per_category).alias("category_id")).agg(
        F.count("*").alias("rows")
    )


@query("p9_month_derivation", "SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*)::bigint AS rows FROM orders GROUP BY 1")
def p9(spark, sf):
    dated = P.table(spark, sf, "orders").select(X.year_month(F.to_date("o_orderdate")).alias("year_month"))
    return dated.groupBy("year_month").agg(F.count("*").alias("rows"))


@query("p10_region", O.with_sales(f"SELECT shipping_state, {O.REGION} AS region, count(*)::bigint AS rows FROM sales GROUP BY ALL"))
def p10(spark, sf):
    return P.sales(spark, sf).groupBy("shipping_state", X.region_of("shipping_state", D.regions).alias("region")).agg(
        F.count("*").alias("rows")
    )


@query("p11_billable", O.with_sales("SELECT order_id, l_partkey, l_suppkey, status FROM sales WHERE status <> 'R'"))
def p11(spark, sf):
    return P.sales(spark, sf).filter(X.billable(D.cancelled)).select("order_id", "l_partkey", "l_suppkey", "status")


@query("p12_nonnull_key", O.with_sales(
    "SELECT payment_method, count(*)::bigint AS rows FROM sales WHERE payment_method IS NOT NULL GROUP BY 1"))
def p12(spark, sf):
    return normalize.with_key(P.sales(spark, sf), "payment_method").groupBy("payment_method").agg(
        F.count("*").alias("rows")
    )


@query("a13_dimension_dedup", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice "
       "FROM orders GROUP BY o_custkey")
def a13(spark, sf):
    orders = P.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return normalize.one_per_key(orders, "o_custkey", order_by=["o_orderkey"])


# --- whole runs over raw files made from the tables --------------------------------
BRONZE_SQL = PER_SOURCE.replace("AS source", "AS _source")


@query("l1_bronze", f"SELECT _source, rows, true AS all_files, _source NOT IN ('clientes', 'categorias') AS is_sales FROM ({BRONZE_SQL})")
def l1(spark, sf):
    """Rows per source, and whether they came from all raw files that hold any."""
    settings = R.finished(spark, sf)
    raw = normalize.unite(
        df.select(F.lit(name).alias("_source"), "_source_file").distinct()
        for name, df in bronze.prepare(spark, settings).items()
    ).groupBy("_source").agg(F.count("*").alias("raw_files"))
    stats = bronze.bronze_stats(spark, settings).join(raw, "_source")
    return stats.select("_source", "rows", (F.col("files") == F.col("raw_files")).alias("all_files"), "is_sales")


@query("l1_incremental_bronze", O.with_sales(
    "SELECT status, run_id, count(*)::bigint AS rows FROM (SELECT status, CASE _source WHEN 'source_0' THEN 'first' "
    "WHEN 'source_1' THEN 'second' ELSE 'third' END AS run_id FROM sales) GROUP BY ALL"))
def l1_incremental(spark, sf):
    """Three deliveries into one folder; every run picks up its own and none is read twice."""
    root = _scratch(spark, "arrivals")
    settings = Settings(root, run_id="first")
    spec = replace(CSV, schema=TEXT)
    path = settings.folder("raw", spec.name)
    for part, run_id in ((0, "first"), (1, "second"), (2, "third")):
        R.write_delimited(R.sales_text(spark, sf, part), path, "append")
        arrivals.append_new_files(spark, spec, replace(settings, run_id=run_id))
    stored = readers.read_bronze(spark, settings, spec)
    return stored.groupBy(F.col("situacao").alias("status"), F.col("_batch_id").alias("run_id")).agg(
        F.count("*").alias("rows")
    )


@query("l2_silver", O.with_judged("""
SELECT reasons[1] AS main_reason, count(*)::bigint AS rows, sum(total_amount::decimal(18,2))::double AS amount
FROM judged GROUP BY 1""", order=RUN_ORDER))
def l2(spark, sf):
    settings = R.finished(spark, sf)
    kept = readers.read_layer(spark, settings, "silver_sales").select(
        F.lit(None).cast("string").alias("main_reason"), "total_amount"
    )
    lost = readers.read_layer(spark, settings, "quarantine").select(F.col("_main_reason").alias("main_reason"), "total_amount")
    return kept.unionByName(lost).groupBy("main_reason").agg(
        F.count("*").alias("rows"), F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("amount")
    )


@query("l3_gold", O.with_judged(O.STATE_SELECT, O.metrics("shipping_state", "valid"), order=RUN_ORDER))
def l3(spark, sf):
    return readers.read_layer(spark, R.finished(spark, sf), "gold_state").withColumnRenamed("uf", "state")


@query("l3_gold_month", O.with_judged(O.MONTH_SELECT, O.metrics("year_month", "valid"), order=RUN_ORDER))
def l3_month(spark, sf):
    return readers.read_layer(spark, R.finished(spark, sf), "gold_month")


@query("l3_gold_payment", O.with_judged(
    f"SELECT * REPLACE (lower(payment) AS payment) FROM ({O.PAYMENT_SELECT})", O.metrics("payment_method", "valid"), order=RUN_ORDER))
def l3_payment(spark, sf):
    return readers.read_layer(spark, R.finished(spark, sf), "gold_payment")


@query("l3_gold_category", O.with_judged(
    f"SELECT * REPLACE (upper(left(segment, 1)) || lower(substr(segment, 2)) AS segment) FROM ({O.CATEGORY_SELECT})",
    *O.category_parts("valid"), order=RUN_ORDER))
def l3_category(spark, sf):
    return readers.read_layer(spark, R.finished(spark, sf), "gold_category")


_SILVER_CHECKS, _SILVER_FIGURES = silver_gate_sql("valid", R.LIMITS)
_GOLD_CHECKS, *_GOLD_PARTS = gold_gate_sql()


@query("l4_gate_run", O.with_judged(
    f"SELECT 'silver' AS layer, * FROM ({_SILVER_CHECKS}) UNION ALL SELECT 'gold', * FROM ({_GOLD_CHECKS})",
    _SILVER_FIGURES, *_GOLD_PARTS, order=RUN_ORDER))
def l4(spark, sf):
    """Every check of both gates as the run stored them."""
    settings = R.finished(spark, sf)
    return normalize.unite(
        gate.read_checks(spark, settings, layer).withColumn("layer", F.lit(layer)) for layer in ("silver", "gold")
    )


RUN_KPI = f"""
SELECT (SELECT count(*) FROM judged)::bigint AS bronze, count(*)::bigint AS silver,
  (SELECT count(*) FROM rejected)::bigint AS quarantine, true AS conserved,
  {O.REVENUE}::double AS revenue, count(*) FILTER (status <> 'R')::bigint AS orders_billable,
  {O.half_up(f"{O.REVENUE}::double / nullif(count(*) FILTER (status <> 'R'), 0)")} AS avg_ticket,
  count(DISTINCT customer_id)::bigint AS active_customers,
  (SELECT state FROM mart ORDER BY revenue_rank, state LIMIT 1) AS top_state,
  (SELECT share_pct FROM mart ORDER BY revenue_rank, state LIMIT 1) AS top_share_pct {{extra}}
FROM valid"""
_RUN_PARTS = (O.metrics("shipping_state", "valid"), f"mart AS ({O.STATE_SELECT})")


@query("l5_gated_chain", O.with_judged(RUN_KPI.format(extra=""), *_RUN_PARTS, order=RUN_ORDER))
def l5(spark, sf):
    return run.summary(spark, R.finished(spark, sf)).drop("silver_gate", "gold_gate", "marts")


_MART_ROWS = """'gold_category=' || (SELECT count(*) FROM (SELECT DISTINCT category_name, segment FROM labelled)) ||
  ',gold_month=' || count(DISTINCT year_month) || ',gold_payment=' || count(DISTINCT payment_method) ||
  ',gold_state=' || count(DISTINCT shipping_state) AS marts"""


@query("l6_summary", O.with_judged(
    RUN_KPI.format(extra=f", 'PASSED (7/7)' AS silver_gate, 'PASSED (8/8)' AS gold_gate, {_MART_ROWS}"),
    *_RUN_PARTS, O.CUSTOMERS, O.CATEGORIES, O.LABELLED.format(source="valid"), order=RUN_ORDER))
def l6(spark, sf):
    return run.summary(spark, R.finished(spark, sf))


# --- the same by delivery ----------------------------------------------------------
_STORED = """order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date,
  lower(payment_method) AS payment_method, shipping_city, shipping_state, lower(status) AS status, category_id, year_month"""


@query("l2_incremental_silver", O.with_judged(f"""
SELECT {_STORED}, '' AS reasons FROM valid
UNION ALL SELECT * REPLACE (NULL AS category_id, NULL AS year_month) FROM (
  SELECT {_STORED}, array_to_string(reasons, ',') AS reasons FROM rejected)""", order=RUN_ORDER))
def l2_incremental(spark, sf):
    """Silver and quarantine after three deliveries, row by row: those of one run over all rows."""
    settings = R.delivered(spark, sf)
    columns = [*C.SALES_FIELDS, "category_id", "year_month"]
    kept = readers.read_layer(spark, settings, "silver_sales").select(*columns, F.lit("").alias("reasons"))
    lost = readers.read_layer(spark, settings, "quarantine").select(*C.SALES_FIELDS, F.array_join("_reasons", ",").alias("reasons"))
    return kept.unionByName(lost, allowMissingColumns=True)


_MERGED = "revenue, orders_billable, orders_cancelled, avg_ticket, cancel_rate_pct, unique_customers"


@query("l3_merged_marts", O.with_judged(f"""
SELECT 'state' AS mart, state AS key, share_pct AS share, {_MERGED} FROM ({O.STATE_SELECT.replace("FROM metrics", "FROM by_state")})
UNION ALL SELECT 'month', year_month, year_share_pct, {_MERGED} FROM ({O.MONTH_SELECT.replace("FROM metrics", "FROM by_month")})
UNION ALL SELECT 'payment', lower(payment), share_pct, {_MERGED} FROM ({O.PAYMENT_SELECT.replace("FROM metrics", "FROM by_payment")})
UNION ALL SELECT 'category', category_name || '/' || upper(left(segment, 1)) || lower(substr(segment, 2)), category_share_pct, {_MERGED}
FROM ({O.CATEGORY_SELECT.replace("FROM metrics", "FROM by_category")})""",
    O.metrics("shipping_state", "valid").replace("metrics AS", "by_state AS", 1),
    O.metrics("year_month", "valid").replace("metrics AS", "by_month AS", 1),
    O.metrics("payment_method", "valid").replace("metrics AS", "by_payment AS", 1),
    *O.category_parts("valid")[:-1], O.metrics("category_name, segment", "labelled").replace("metrics AS", "by_category AS", 1),
    order=RUN_ORDER))
def l3_merged(spark, sf):
    """All four marts after three deliveries, from states that were merged month by month."""
    settings = R.delivered(spark, sf)
    marts_by = {
        "gold_state": ("state", F.col("state"), "share_pct"), "gold_month": ("month", F.col("year_month"), "year_share_pct"),
        "gold_payment": ("payment", F.col("payment"), "share_pct"),
        "gold_category": ("category", F.concat_ws("/", "category_name", "segment"), "category_share_pct"),
    }
    columns = [c.strip() for c in _MERGED.split(",")]
    return normalize.unite(
        readers.read_layer(spark, settings, layer).select(
            F.lit(name).alias("mart"), key.alias("key"), F.col(share).alias("share"), *columns
        )
        for layer, (name, key, share) in marts_by.items()
    )
