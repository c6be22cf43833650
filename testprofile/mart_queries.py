"""Aggregates, windows, marts, top-k and joins over the sales rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreworks.operators import lookups, marts, profile
from oreworks.operators.normalize import unite
from oreworks.sinks import tables
from oreworks.sinks.tables import publish_names
from testprofile import oracle as O
from testprofile import tables as P
from testprofile.registry import query

D = P.DOMAINS


def _metrics(spark, sf, key):
    return marts.base_metrics(P.silver_sales(spark, sf), [key], D.cancelled)


def _categories(spark, sf):
    return P.categories(spark, sf)


def _category_mart(spark, sf):
    return marts.category_by_segment(P.silver_sales(spark, sf), P.customers(spark, sf), _categories(spark, sf), D)


# --- marts -----------------------------------------------------------------
@query("a1_base_metrics", O.with_sales("SELECT status, shipping_state, _source, " + O.MEASURES
       + " FROM sales GROUP BY status, shipping_state, _source").replace("AS revenue", "::double AS revenue"))
def a1(spark, sf):
    df = marts.base_metrics(P.silver_sales(spark, sf), ["status", "shipping_state", "_source"], D.cancelled)
    return df.withColumn("revenue", F.col("revenue").cast("double"))


@query("a2_derived_ratios", O.with_sales(
    f"SELECT status, shipping_state, {O.RATIOS} FROM metrics", O.metrics("status, shipping_state")))
def a2(spark, sf):
    df = marts.base_metrics(P.silver_sales(spark, sf), ["status", "shipping_state"], D.cancelled)
    return marts.ratios(df).select("status", "shipping_state", "avg_ticket", "cancel_rate_pct")


@query("a3_revenue_by_state", O.with_sales(O.STATE_SELECT, O.metrics("shipping_state")))
def a3(spark, sf):
    return marts.revenue_by_state(P.silver_sales(spark, sf), D)


@query("a4_monthly", O.with_sales(O.MONTH_SELECT, O.metrics("year_month")))
def a4(spark, sf):
    return marts.monthly_analysis(P.silver_sales(spark, sf), D)


@query("w3_calendar_growth", O.with_sales(
    "SELECT year_month, revenue, previous_revenue, growth_pct, running_revenue, orders_total FROM ("
    + O.MONTH_SELECT.replace("FROM metrics", "FROM filled") + ")",
    O.metrics("year_month", "(SELECT * FROM sales WHERE year_month NOT IN ('1996-03', '1997-11', '1997-12'))"),
    """filled AS (
  SELECT strftime(c.m, '%Y-%m') AS year_month, coalesce(orders_total, 0)::bigint AS orders_total,
    coalesce(orders_billable, 0)::bigint AS orders_billable, coalesce(orders_cancelled, 0)::bigint AS orders_cancelled,
    coalesce(revenue, 0)::decimal(30,2) AS revenue, coalesce(unique_customers, 0)::bigint AS unique_customers,
    coalesce(items_sold, 0)::bigint AS items_sold
  FROM (SELECT unnest(generate_series((SELECT min(year_month) || '-01' FROM metrics)::timestamp,
    (SELECT max(year_month) || '-01' FROM metrics)::timestamp, INTERVAL 1 MONTH)) AS m) c
  LEFT JOIN metrics ON year_month = strftime(c.m, '%Y-%m'))"""))
def w3_calendar(spark, sf):
    """Growth month on month where three months have no sales."""
    sold = P.silver_sales(spark, sf).filter(~F.col("year_month").isin("1996-03", "1997-11", "1997-12"))
    return marts.monthly_analysis(sold, D, calendar=True).select(
        "year_month", "revenue", "previous_revenue", "growth_pct", "running_revenue", "orders_total"
    )


@query("a5_by_payment", O.with_sales(O.PAYMENT_SELECT, O.metrics("payment_method")))
def a5(spark, sf):
    return marts.revenue_by_payment(P.silver_sales(spark, sf), D)


@query("a6_category_segment", O.with_sales(O.CATEGORY_SELECT, *O.category_parts()))
def a6(spark, sf):
    return _category_mart(spark, sf)


KPI_SQL = f"""
SELECT {O.REVENUE}::double AS revenue, count(*) FILTER (status <> 'R')::bigint AS orders_billable,
  {O.half_up(f"{O.REVENUE}::double / nullif(count(*) FILTER (status <> 'R'), 0)")} AS avg_ticket,
  count(DISTINCT customer_id)::bigint AS active_customers,
  count(DISTINCT CASE WHEN status <> 'R' THEN customer_id END)::bigint AS paying_customers,
  (SELECT state FROM mart ORDER BY revenue_rank, state LIMIT 1) AS top_state,
  (SELECT share_pct FROM mart ORDER BY revenue_rank, state LIMIT 1) AS top_share_pct
FROM sales"""


@query("a7_kpis", O.with_sales(KPI_SQL, O.metrics("shipping_state"), f"mart AS ({O.STATE_SELECT})"))
def a7(spark, sf):
    sales = P.silver_sales(spark, sf)
    return marts.kpis(sales, marts.revenue_by_state(sales, D), D.cancelled)


@query("a3_a4_a5_one_pass", O.with_sales(f"""
SELECT 'state' AS mart, shipping_state AS item, {O.REVENUE}::double AS revenue,
  count(DISTINCT CASE WHEN status <> 'R' THEN customer_id END)::bigint AS unique_customers FROM sales GROUP BY ALL
UNION ALL SELECT 'month', year_month, {O.REVENUE}::double,
  count(DISTINCT CASE WHEN status <> 'R' THEN customer_id END)::bigint FROM sales GROUP BY ALL
UNION ALL SELECT 'payment', payment_method, {O.REVENUE}::double,
  count(DISTINCT CASE WHEN status <> 'R' THEN customer_id END)::bigint FROM sales GROUP BY ALL"""))
def one_pass(spark, sf):
    rolled = marts.rollup(P.silver_sales(spark, sf), D.cancelled)
    names = F.create_map(F.lit(3), F.lit("state"), F.lit(5), F.lit("month"), F.lit(6), F.lit("payment"))
    level = F.col("_level").cast("int")
    return rolled.filter(level != 7).select(
        F.try_element_at(names, level).alias("mart"),
        F.when(level == 3, F.col("shipping_state")).when(level == 5, F.col("year_month"))
        .otherwise(F.col("payment_method")).alias("item"),
        F.col("revenue").cast("double").alias("revenue"),
        "unique_customers",
    )


# --- windows over aggregated rows -------------------------------------------
@query("w1_share_of_total", O.with_sales(
    f"SELECT payment_method, {O.share('share_pct')} FROM metrics", O.metrics("payment_method")))
def w1(spark, sf):
    return _metrics(spark, sf, "payment_method").withColumns(marts.share("share_pct")).select("payment_method", "share_pct")


@query("w2_dense_rank", O.with_sales(
    "SELECT shipping_state, dense_rank() OVER (ORDER BY revenue DESC)::int AS revenue_rank FROM metrics",
    O.metrics("shipping_state")))
def w2(spark, sf):
    return marts.revenue_by_state(P.silver_sales(spark, sf), D).select(
        F.col("state").alias("shipping_state"), "revenue_rank"
    )


@query("w3_growth", O.with_sales(f"""
SELECT year_month, (lag(revenue) OVER (ORDER BY year_month))::double AS previous_revenue, {O.GROWTH} AS growth_pct
FROM metrics""", O.metrics("year_month")))
def w3(spark, sf):
    return a4(spark, sf).select("year_month", "previous_revenue", "growth_pct")


@query("w4_running_total", O.with_sales(
    "SELECT year_month, (sum(revenue) OVER (ORDER BY year_month ROWS UNBOUNDED PRECEDING))::double AS running_revenue "
    "FROM metrics", O.metrics("year_month")))
def w4(spark, sf):
    return a4(spark, sf).select("year_month", "running_revenue")


@query("w5_share_in_group", O.with_sales(
    f"SELECT category_name, segment, {O.share('category_share_pct', 'PARTITION BY category_name')} FROM metrics",
    *O.category_parts()))
def w5(spark, sf):
    return _category_mart(spark, sf).select("category_name", "segment", "category_share_pct")


# --- sorts, limits, set operations -------------------------------------------
@query("t1_sorted_marts", O.with_sales(f"""
SELECT 'state' AS mart, state AS key, row_number() OVER (ORDER BY revenue_rank, state)::bigint AS position
FROM ({O.STATE_SELECT.replace("metrics", "by_state")})
UNION ALL SELECT 'month', year_month, row_number() OVER (ORDER BY year_month) FROM ({O.MONTH_SELECT.replace("metrics", "by_month")})
UNION ALL SELECT 'payment', payment, row_number() OVER (ORDER BY revenue DESC, payment)
FROM ({O.PAYMENT_SELECT.replace("metrics", "by_payment")})
UNION ALL SELECT 'category', category_name || '/' || segment, row_number() OVER (ORDER BY category_name, revenue DESC, segment)
FROM ({O.CATEGORY_SELECT.replace("metrics", "by_category")})""",
    *(O.metrics(k, source).replace("metrics AS", f"{name} AS", 1) for k, source, name in (
        ("shipping_state", "sales", "by_state"), ("year_month", "sales", "by_month"), ("payment_method", "sales", "by_payment"))),
    *O.category_parts()[:3], O.category_parts()[3].replace("metrics AS", "by_category AS", 1)))
def t1(spark, sf):
    """The place of each row in the stored file of its mart."""
    marts_by_key = {
        "state": (a3(spark, sf), F.col("state")), "month": (a4(spark, sf), F.col("year_month")),
        "payment": (a5(spark, sf), F.col("payment")),
        "category": (_category_mart(spark, sf), F.concat_ws("/", "category_name", "segment")),
    }
    placed = []
    for name, (mart, key) in marts_by_key.items():
        path = tables.scratch_path(spark, f"sorted-{name}")
        tables.overwrite_small(mart, path)
        row = (F.col("_metadata.row_index") + 1).alias("position")
        placed.append(tables.read(spark, path).select(F.lit(name).alias("mart"), key.alias("key"), row))
    return unite(placed)


@query("t2_top_state", O.with_sales(
    f"SELECT state, share_pct FROM ({O.STATE_SELECT}) ORDER BY revenue_rank, state LIMIT 1", O.metrics("shipping_state")))
def t2(spark, sf):
    return marts.top_states(a3(spark, sf), 1).select("state", "share_pct")


@query("t3_top10_states", O.with_sales(
    f"SELECT * FROM ({O.STATE_SELECT}) ORDER BY revenue_rank, state LIMIT 10", O.metrics("shipping_state")))
def t3(spark, sf):
    return marts.top_states(a3(spark, sf), 10)


@query("t3_top10_category_segments", O.with_sales(
    f"SELECT * FROM ({O.CATEGORY_SELECT}) ORDER BY revenue DESC, category_name, segment LIMIT 10", *O.category_parts()))
def t3_categories(spark, sf):
    return marts.top_category_segments(_category_mart(spark, sf), 10)


@query("u1_union", O.with_sales(
    "SELECT _source, count(*)::bigint AS rows, sum(quantity)::bigint AS items, count(status)::bigint AS with_status "
    "FROM (SELECT _source, quantity, CASE WHEN _source <> 'source_2' THEN status END AS status FROM sales) GROUP BY _source"))
def u1(spark, sf):
    sales = P.sales(spark, sf)
    parts = [
        sales.filter("_source = 'source_0'").select("_source", "quantity", "status"),
        sales.filter("_source = 'source_1'").select("status", "quantity", "_source"),
        sales.filter("_source = 'source_2'").select("quantity", "_source"),
    ]
    return unite(parts).groupBy("_source").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("items"), F.count("status").alias("with_status")
    )


# --- joins --------------------------------------------------------------------
@query("j1_exists_flag", O.with_sales(
    "SELECT shipping_state, known, count(*)::bigint AS rows FROM flagged GROUP BY ALL", O.FLAGGED))
def j1(spark, sf):
    flagged = lookups.flag_known(P.sales(spark, sf), P.registry(spark, sf))
    return flagged.groupBy("shipping_state", F.col("_customer_known").alias("known")).agg(F.count("*").alias("rows"))


@query("j2_category_lookup", O.with_sales(
    "SELECT order_id, l_partkey, l_suppkey, category_name FROM sales LEFT JOIN categories USING (category_id)",
    O.CATEGORIES))
def j2(spark, sf):
    return lookups.with_category_name(P.silver_sales(spark, sf), _categories(spark, sf)).select(
        "order_id", "l_partkey", "l_suppkey", "category_name"
    )


@query("j3_segment_lookup", O.with_sales(
    "SELECT segment, status, count(*)::bigint AS rows FROM sales LEFT JOIN customers USING (customer_id) GROUP BY ALL",
    O.CUSTOMERS))
def j3(spark, sf):
    return lookups.with_segment(P.sales(spark, sf), P.customers(spark, sf)).groupBy("segment", "status").agg(
        F.count("*").alias("rows")
    )


@query("j4_orphans", O.with_sales(
    "SELECT customer_id, count(*)::bigint AS orphans FROM sales s "
    "WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.customer_id = s.customer_id) GROUP BY customer_id", O.REGISTRY))
def j4(spark, sf):
    return lookups.orphan_rows(P.sales(spark, sf), P.registry(spark, sf))


@query("p13_null_fill", O.with_sales("""
SELECT coalesce(category_name, 'Sem categoria') AS category_name, coalesce(segment, 'Sem segmento') AS segment,
  count(*)::bigint AS rows
FROM sales LEFT JOIN (SELECT * FROM categories WHERE category_id <> 'CAT_01') USING (category_id)
  LEFT JOIN (SELECT customers.* FROM customers JOIN registry USING (customer_id)) USING (customer_id)
GROUP BY ALL""", O.CUSTOMERS, O.CATEGORIES, O.REGISTRY))
def p13(spark, sf):
    known = P.customers(spark, sf).join(P.registry(spark, sf), "customer_id", "left_semi")
    some = _categories(spark, sf).filter("category_id <> 'CAT_01'")
    joined = lookups.with_segment(lookups.with_category_name(P.silver_sales(spark, sf), some), known)
    return lookups.label_unmatched(joined).groupBy("category_name", "segment").agg(F.count("*").alias("rows"))


_PUBLISHED = """
  revenue AS faturamento, orders_billable AS pedidos_faturados, orders_cancelled AS pedidos_cancelados,
  cancel_rate_pct AS taxa_cancelamento_pct, avg_ticket AS ticket_medio, unique_customers AS clientes_unicos"""
# Columns of the marts on disk, in order.
_ON_DISK = {
    "estado": "ranking_faturamento,uf,regiao,faturamento,participacao_pct,pedidos_faturados,pedidos_cancelados,pedidos_total,"
              "taxa_cancelamento_pct,ticket_medio,clientes_unicos,itens_vendidos",
    "mes": "ano_mes,faturamento,faturamento_mes_anterior,crescimento_mom_pct,faturamento_acumulado,participacao_ano_pct,"
           "pedidos_faturados,pedidos_cancelados,pedidos_total,taxa_cancelamento_pct,ticket_medio,clientes_unicos,itens_vendidos",
    "pagamento": "forma_pagamento,faturamento,participacao_pct,pedidos_faturados,pedidos_cancelados,pedidos_total,"
                 "taxa_cancelamento_pct,ticket_medio,clientes_unicos",
    "categoria": "category_name,segment,faturamento,participacao_na_categoria_pct,pedidos_faturados,pedidos_cancelados,"
                 "taxa_cancelamento_pct,ticket_medio,clientes_unicos",
}


def _renamed(mart: str, columns: str, select: str, metrics: str) -> str:
    inner = select.replace("FROM metrics", f"FROM {metrics}")
    return f"SELECT '{mart}' AS mart, '{_ON_DISK[mart]}' AS colunas, {columns}, {_PUBLISHED} FROM ({inner})"


@query("p14_rename_order", O.with_sales(" UNION ALL BY NAME ".join((
    _renamed("estado", "revenue_rank AS ranking_faturamento, state AS uf, region AS regiao, share_pct AS participacao_pct, "
             "orders_total AS pedidos_total, items_sold AS itens_vendidos", O.STATE_SELECT, "by_state"),
    _renamed("mes", "year_month AS ano_mes, previous_revenue AS faturamento_mes_anterior, growth_pct AS crescimento_mom_pct, "
             "running_revenue AS faturamento_acumulado, year_share_pct AS participacao_ano_pct, orders_total AS pedidos_total, "
             "items_sold AS itens_vendidos", O.MONTH_SELECT, "by_month"),
    _renamed("pagamento", "payment AS forma_pagamento, share_pct AS participacao_pct, orders_total AS pedidos_total",
             O.PAYMENT_SELECT, "by_payment"),
    _renamed("categoria", "category_name, segment, category_share_pct AS participacao_na_categoria_pct", O.CATEGORY_SELECT, "by_category"),
)), *(O.metrics(key).replace("metrics AS", f"{name} AS", 1) for key, name in (
    ("shipping_state", "by_state"), ("year_month", "by_month"), ("payment_method", "by_payment"))),
    *O.category_parts()[:-1], O.metrics("category_name, segment", "labelled").replace("metrics AS", "by_category AS", 1)))
def p14(spark, sf):
    """All four marts under their names on disk, and the order of those."""
    built = {"estado": a3(spark, sf), "mes": a4(spark, sf), "pagamento": a5(spark, sf), "categoria": _category_mart(spark, sf)}
    named = {mart: publish_names(df) for mart, df in built.items()}
    return unite(df.withColumns({"mart": F.lit(mart), "colunas": F.lit(",".join(df.columns))}) for mart, df in named.items())


# --- profiles -------------------------------------------------------------------
@query("a10_source_stats",
       "SELECT 'source_' || (l_linenumber % 3) AS _source, count(*)::bigint AS rows, 1::bigint AS files "
       "FROM lineitem GROUP BY 1")
def a10(spark, sf):
    lines = P.table(spark, sf, "lineitem").select(P.source(), F.col("_metadata.file_path").alias("_source_file"))
    return profile.source_stats(lines)


@query("a11_null_profile", O.with_sales("SELECT " + ", ".join(
    f"count(*) FILTER ({f} IS NULL OR trim({f}::varchar) = '')::bigint AS {f}" for f in D.required) + " FROM sales"))
def a11(spark, sf):
    return profile.null_profile(P.sales(spark, sf), D.required)


DOCUMENT_FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


@query("a11_document_profile",
       "SELECT " + ", ".join(f"count(*) FILTER ({f} IS NULL OR trim({f}::varchar) = '')::bigint AS {f}"
                             for f in DOCUMENT_FIELDS) + " FROM documents")
def a11_documents(spark, sf):
    return profile.null_profile(P.table(spark, sf, "documents"), DOCUMENT_FIELDS)


DUPLICATES = ("SELECT count(*)::bigint AS rows, count(DISTINCT {k})::bigint AS distinct_keys, "
              "(count(*) - count(DISTINCT {k}))::bigint AS duplicates FROM {t}")


@query("a12_dup_count", O.with_sales(DUPLICATES.format(k="order_id", t="sales")))
def a12(spark, sf):
    return profile.duplicate_count(P.table(spark, sf, "lineitem").select(P.order_id()), "order_id")


@query("a12_document_dups", DUPLICATES.format(k="text", t="documents"))
def a12_documents(spark, sf):
    return profile.duplicate_count(P.table(spark, sf, "documents"), "text", long_text=True)
