"""Rules, quarantine and gates over the sales rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Scale
from oreworks.operators import content, gates, lookups, marts, normalize, profile, quarantine
from oreworks.operators.rules import completeness_rules, consistency_rule, domain_rules, failure_counts, integrity_rule, sales_rules, with_reasons
from oreworks.sinks import tables
from testprofile import oracle as O
from testprofile import tables as P
from testprofile.registry import query

D = P.DOMAINS
ROW = ("order_id", "l_partkey", "l_suppkey", "total_amount")


def _flagged(spark, sf):
    return lookups.flag_known(P.sales(spark, sf), P.registry(spark, sf))


def _dirty(spark, sf):
    """Sales whose values are spoilt where the keys say so, to give every rule work."""
    key = F.col("l_partkey")
    return _flagged(spark, sf).withColumns(
        {
            "status": F.when(key % 11 == 0, F.lit("?")).otherwise(F.col("status")),
            "payment_method": F.when(key % 13 == 0, F.lit("cash")).otherwise(F.col("payment_method")),
            "shipping_city": F.when(key % 17 == 0, F.lit("  ")).otherwise(F.col("shipping_city")),
            "quantity": F.when(key % 19 == 0, -F.col("quantity")).otherwise(F.col("quantity")),
            "unit_price": F.when(key % 23 == 0, F.lit(0.0)).otherwise(F.col("unit_price")),
            "total_amount": F.when(key % 29 == 0, F.lit(None).cast("double")).otherwise(F.col("total_amount")),
        }
    )


DIRTY = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN l_partkey % 11 = 0 THEN '?' ELSE status END AS status,
    CASE WHEN l_partkey % 13 = 0 THEN 'cash' ELSE payment_method END AS payment_method,
    CASE WHEN l_partkey % 17 = 0 THEN '  ' ELSE shipping_city END AS shipping_city,
    CASE WHEN l_partkey % 19 = 0 THEN -quantity ELSE quantity END AS quantity,
    CASE WHEN l_partkey % 23 = 0 THEN 0.0 ELSE unit_price END AS unit_price,
    CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE total_amount END AS total_amount
  ) FROM flagged
)"""


def _failures_sql(*prefixes: str) -> str:
    picked = [(n, c) for n, c in O.CONDITIONS if n.startswith(prefixes)]
    body = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({c}, false))::bigint AS failures FROM dirty"
        for n, c in picked
    )
    return O.with_sales(body, O.FLAGGED, DIRTY)


@query("q1_completeness", _failures_sql("completude."))
def q1(spark, sf):
    return failure_counts(_dirty(spark, sf), completeness_rules(D.required))


@query("q2_null_guard", O.with_sales("""
SELECT count(*) FILTER (total_amount IS NULL)::bigint AS missing,
  count(*) FILTER (total_amount IS NULL AND len(f) = 1 AND f[1] = 'completude.total_amount')::bigint AS reported_once
FROM (SELECT total_amount, list_filter([%s], lambda x: x IS NOT NULL) AS f FROM dirty)
""" % ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in O.CONDITIONS
                if n in ("completude.total_amount", "dominio.total_amount_positivo", "consistencia.total_calculado")),
    O.FLAGGED, DIRTY))
def q2(spark, sf):
    rules = sales_rules(
        D, only=("completude.total_amount", C.RULE_TOTAL, C.RULE_CONSISTENCY), integrity=False
    )
    missing = F.col("total_amount").isNull()
    once = F.array_join("_reasons", ",") == "completude.total_amount"
    return with_reasons(_dirty(spark, sf), rules).agg(
        F.count_if(missing).alias("missing"), F.count_if(missing & once).alias("reported_once")
    )


@query("q3_q5_domain", _failures_sql("dominio."))
def q3_q5(spark, sf):
    return failure_counts(_dirty(spark, sf), domain_rules(D))


def _sets(spark, sf):
    """Allowed states and payments as tables, with repeated and missing values."""
    states = P.table(spark, sf, "nation").filter(F.col("n_name").isin(*D.states)).select("n_name")
    payments = P.table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("payment"))
    return {"shipping_state": states, "payment_method": payments}


@query("q3_sets_as_tables", _failures_sql("dominio."))
def q3_tables(spark, sf):
    """The domain rules with two of the sets in tables, one of them too large for a broadcast."""
    sets, dirty = _sets(spark, sf), _dirty(spark, sf)
    flagged = lookups.flag_members(dirty, {"shipping_state": sets["shipping_state"]})
    flagged = lookups.flag_members(flagged, {"payment_method": sets["payment_method"]}, Scale(broadcast_rows=1), tables.stage)
    return failure_counts(flagged, domain_rules(D, by_table=sets))


@query("q6_consistency", _failures_sql("consistencia."))
def q6(spark, sf):
    return failure_counts(_dirty(spark, sf), [consistency_rule(D)])


@query("q7_integrity", _failures_sql("integridade."))
def q7(spark, sf):
    return failure_counts(_dirty(spark, sf), [integrity_rule()])


@query("q8_reasons", O.with_sales(f"""
SELECT order_id, l_partkey, l_suppkey, l_shipdate::varchar AS shipped,
  array_to_string(list_filter([{O._LIST}], lambda x: x IS NOT NULL), ',') AS reasons
FROM dirty""", O.FLAGGED, DIRTY))
def q8(spark, sf):
    df = with_reasons(_dirty(spark, sf), sales_rules(D))
    return df.select(
        "order_id", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        F.array_join("_reasons", ",").alias("reasons"),
    )


@query("q9_valid", O.with_judged(
    "SELECT order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date, payment_method, "
    "shipping_state, status FROM valid"))
def q9_valid(spark, sf):
    return P.valid(spark, sf).select(
        "order_id", "customer_id", "product_id", "quantity", "unit_price", "total_amount", "order_date",
        "payment_method", "shipping_state", "status",
    )


@query("q9_quarantine", O.with_judged(
    "SELECT order_id, l_partkey, l_suppkey, total_amount, array_to_string(reasons, ',') AS reasons FROM rejected"))
def q9_quarantine(spark, sf):
    return P.rejected(spark, sf).select(*ROW, F.array_join("_reasons", ",").alias("reasons"))


@query("q10_uniqueness", O.with_judged(
    "SELECT order_id, count(*)::bigint AS later_copies FROM rejected WHERE main_reason = 'unicidade.order_id' GROUP BY 1"))
def q10(spark, sf):
    repeats = P.judged(spark, sf).filter(F.get("_reasons", F.lit(0)) == C.RULE_UNIQUENESS)
    return repeats.groupBy("order_id").agg(F.count("*").alias("later_copies"))


@query("q11_main_reason", O.with_judged(
    "SELECT main_reason, split_part(main_reason, '.', 1) AS dimension, count(*)::bigint AS rows FROM rejected GROUP BY ALL"))
def q11(spark, sf):
    return P.rejected(spark, sf).groupBy(
        F.col("_main_reason").alias("main_reason"), F.col("_dimension").alias("dimension")
    ).agg(F.count("*").alias("rows"))


@query("q12_sample_per_reason", O.with_judged("""
SELECT main_reason, order_id, l_partkey, l_suppkey, total_amount FROM (
  SELECT *, row_number() OVER (PARTITION BY main_reason ORDER BY order_id, l_partkey, l_suppkey, l_shipdate,
    total_amount, quantity, l_discount, l_tax) AS n FROM rejected) WHERE n = 1"""))
def q12(spark, sf):
    order = ["order_id", "l_partkey", "l_suppkey", "l_shipdate", "total_amount", "quantity", "l_discount", "l_tax"]
    picked = quarantine.sample_per_reason(P.rejected(spark, sf), order)
    return picked.select(F.col("_main_reason").alias("main_reason"), *ROW)


@query("w6_keep_first", O.with_sales(f"""
SELECT order_id, l_partkey, l_suppkey, total_amount, n > 1 AS later_copy
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {O.ORDER}) AS n FROM sales)"""))
def w6(spark, sf):
    rows = quarantine.with_row_id(P.sales(spark, sf))
    flagged = quarantine.flag_repeats(rows, "order_id", P.ORDER, F.lit(True))
    return flagged.select(*ROW, F.col(quarantine.REPEAT).alias("later_copy"))


@query("q9_by_exceptions", O.with_judged(
    "SELECT array_to_string(reasons, ',') AS reasons, count(*)::bigint AS rows, "
    "sum(total_amount::decimal(18,2))::double AS amount FROM judged GROUP BY 1"))
def q9_by_exceptions(spark, sf):
    sales, rules = P.sales(spark, sf), sales_rules(D)
    unknown = tables.stage(lookups.unknown_keys(sales, P.registry(spark, sf)), "unknown")
    tag = quarantine.tag_by_unknown(lookups.checked_broadcast(unknown, P.SCALE))
    suspects = tables.stage(quarantine.repeat_suspects(P.table(spark, sf, "lineitem").select(P.order_id())), "suspects")
    repeated = quarantine.repeated_rows(
        sales, tag, suspects, rules, P.ORDER, small=lookups.fits_broadcast(suspects, P.SCALE), stage=tables.stage
    )
    repeated = quarantine.listed_rows(tables.stage(repeated, "repeated"), P.SCALE, tables.stage)
    judged = quarantine.judge_by_exceptions(sales, quarantine.Exceptions(tag, repeated), rules)
    return judged.groupBy(F.array_join("_reasons", ",").alias("reasons")).agg(
        F.count("*").alias("rows"), F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("amount")
    )


# --- counts about the quarantine -------------------------------------------------
@query("a8_by_rule", O.with_judged(
    "SELECT rule, count(*)::bigint AS rows FROM (SELECT unnest(reasons) AS rule FROM rejected) GROUP BY rule"))
def a8(spark, sf):
    return profile.quarantine_by_rule(P.rejected(spark, sf))


@query("a9_by_source", O.with_judged("SELECT _source, count(*)::bigint AS rows FROM rejected GROUP BY 1"))
def a9(spark, sf):
    return profile.rows_by_source(P.rejected(spark, sf))


FLOW_SQL = O.with_judged("""
SELECT count(*)::bigint AS bronze, count(*) FILTER (len(reasons) = 0)::bigint AS silver,
  count(*) FILTER (len(reasons) > 0)::bigint AS quarantine,
  round(count(*) FILTER (len(reasons) > 0)::double / count(*), 4) AS quarantine_rate, true AS conserved
FROM judged""")


@query("a14_flow", FLOW_SQL)
def a14(spark, sf):
    judged = _stored(spark, sf)
    return profile.layer_flow(
        P.sales(spark, sf), quarantine.valid_rows(judged), quarantine.quarantined_rows(judged)
    )


@query("l7_quarantine_alert", O.with_judged("""
SELECT 'total' AS about, '' AS item, count(*)::bigint AS rows FROM rejected
UNION ALL SELECT 'rule', rule, count(*) FROM (SELECT unnest(reasons) AS rule FROM rejected) GROUP BY rule
UNION ALL SELECT 'source', _source, count(*) FROM rejected GROUP BY _source"""))
def l7(spark, sf):
    from oreworks.plans.run import alert_rows

    return alert_rows(quarantine.quarantined_rows(_stored(spark, sf)))


# --- gates -----------------------------------------------------------------------
def _stored(spark, sf):
    """Sales judged once and stored, as a gate finds them."""
    return P.judged(spark, sf, tables.stage)


def _silver_gate(spark, sf, clean=True):
    judged = _stored(spark, sf)
    silver = quarantine.valid_rows(judged) if clean else judged
    return gates.silver_gate(
        P.sales(spark, sf), silver, quarantine.quarantined_rows(judged), P.registry(spark, sf), D, P.LIMITS
    )


_EMPTY = " + ".join(f"count(*) FILTER (NOT {c})" for n, c in O.CONDITIONS if n.startswith("completude."))
_BAD = " AND ".join(c for n, c in O.CONDITIONS if not n.startswith("integridade."))


def silver_gate_sql(kept: str, limits=P.LIMITS) -> tuple[str, str]:
    """Checks of the Silver gate when ``kept`` is taken as Silver, and the figures behind them."""
    return f"""
SELECT "check", dimension, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, value, expected, true AS blocking
FROM (
  SELECT 'conservacao_bronze_silver_quarentena' AS "check", 'conservacao' AS dimension, b = s + q AS ok,
    '{{"bronze":' || b || ',"silver":' || s || ',"quarantine":' || q || '}}' AS value,
    'bronze == silver + quarentena' AS expected FROM f
  UNION ALL SELECT 'completude_silver', 'completude', empty = 0, empty_json, '0 nulos em campos obrigatórios' FROM f
  UNION ALL SELECT 'unicidade_order_id_silver', 'unicidade', dups = 0, dups::varchar, '0' FROM f
  UNION ALL SELECT 'validade_dominio_silver', 'validade_dominio', bad = 0, bad::varchar, '0' FROM f
  UNION ALL SELECT 'integridade_clientes_silver', 'integridade', orphans = 0, orphans::varchar, '0 vendas com cliente fora do cadastro' FROM f
  UNION ALL SELECT 'taxa_quarentena', 'monitoramento', q::double / b <= {limits.quarantine_rate_max},
    round(q::double / b, 4)::varchar, '<= {limits.quarantine_rate_max}' FROM f
  UNION ALL SELECT 'volume_minimo_silver', 'volume', s >= {limits.silver_rows_min}, s::varchar,
    '>= {limits.silver_rows_min}' FROM f
)""", f"""
f AS (
  SELECT (SELECT count(*) FROM sales) AS b, (SELECT count(*) FROM rejected) AS q, count(*) AS s, {_EMPTY} AS empty,
    CASE WHEN {_EMPTY} = 0 THEN '{{}}' ELSE '{{"payment_method":' || ({_EMPTY}) || '}}' END AS empty_json,
    count(*) - count(DISTINCT order_id) AS dups, count(*) FILTER (NOT ({_BAD})) AS bad,
    count(*) FILTER (NOT known) AS orphans
  FROM {kept}
)"""


@query("g1_g7_silver_gate", O.with_judged(*silver_gate_sql("valid")))
def g1_g7(spark, sf):
    return _silver_gate(spark, sf)


@query("g1_g7_unclean_silver", O.with_judged(*silver_gate_sql("judged")))
def g1_g7_unclean(spark, sf):
    """The same gate when bad rows were let through: it has to fail."""
    return _silver_gate(spark, sf, clean=False)


def _gold_gate(spark, sf):
    silver = normalize.enrich(quarantine.valid_rows(_stored(spark, sf)), D.products_per_category)
    return gates.gold_gate(
        silver,
        marts.revenue_by_state(silver, D),
        marts.monthly_analysis(silver, D),
        marts.revenue_by_payment(silver, D),
        marts.category_by_segment(silver, P.customers(spark, sf), P.categories(spark, sf), D),
        D, P.LIMITS,
    )


def gold_gate_sql(state: str = "by_state", month: str = "by_month", payment: str = "by_payment", category: str = "by_category") -> list[str]:
    """Checks of the Gold gate over four marts and ``valid``, then the marts and the figures behind the checks."""
    sums = ", ".join(
        f"(SELECT coalesce(sum(revenue::decimal(30,2)), 0) FROM {mart}) AS {name}_revenue"
        for name, mart in (("state", state), ("month", month), ("payment", payment), ("category", category))
    )
    reconciled = " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", 'consistencia' AS dimension, abs({name}_revenue - rev) < 1.0 AS ok, "
        f"{name}_revenue::varchar AS value, rev::varchar AS expected, true AS blocking FROM g"
        for name, check in (("state", "reconciliacao_estado_vs_silver"), ("month", "reconciliacao_mensal_vs_silver"),
                            ("payment", "reconciliacao_pagamento_vs_silver"), ("category", "reconciliacao_categoria_vs_silver"))
    )
    select = f"""
SELECT "check", dimension, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, value, expected, blocking FROM (
  {reconciled}
  UNION ALL SELECT 'gold_sem_categoria_ou_segmento_desconhecido', 'integridade', unlabelled = 0, unlabelled::varchar, '0', true FROM g
  UNION ALL SELECT 'pedidos_mensal_vs_silver', 'consistencia', month_orders = orders, month_orders::varchar, orders::varchar, true FROM g
  UNION ALL SELECT 'gold_estado_27_ufs', 'completude', states = {len(D.states)}, states::varchar, '{len(D.states)}', false FROM g
  UNION ALL SELECT 'gold_sem_faturamento_negativo', 'validade_dominio', negative = 0, negative::varchar, '0', true FROM g
)"""
    figures = f"""
g AS (
  SELECT (SELECT {O.REVENUE} FROM valid) AS rev, (SELECT count(*) FILTER (status <> 'R') FROM valid) AS orders, {sums},
    (SELECT count(*) FROM {state}) AS states, (SELECT coalesce(sum(orders_billable), 0)::bigint FROM {month}) AS month_orders,
    (SELECT count(*) FROM {category} WHERE category_name = 'Sem categoria' OR segment = 'Sem segmento') AS unlabelled,
    (SELECT count(*) FROM {state} WHERE revenue < 0) + (SELECT count(*) FROM {month} WHERE revenue < 0) AS negative
)"""
    named = lambda keys, name, source="valid": O.metrics(keys, source).replace("metrics AS", f"{name} AS", 1)
    marts_sql = [
        named("shipping_state", "by_state"), named("year_month", "by_month"), named("payment_method", "by_payment"),
        O.CUSTOMERS, O.CATEGORIES, O.LABELLED.format(source="valid"), named("category_name, segment", "by_category", "labelled"),
    ]
    return [select, *marts_sql, figures]


@query("g8_g15_gold_gate", O.with_judged(*gold_gate_sql()))
def g8_g15(spark, sf):
    return _gold_gate(spark, sf)


_SPOILT = """
spoilt_state AS (SELECT * FROM by_state WHERE shipping_state <> 'NATION_0'),
spoilt_month AS (SELECT * REPLACE (CASE WHEN year_month LIKE '1996%' THEN -revenue ELSE revenue END AS revenue,
  CASE WHEN year_month LIKE '1996%' THEN orders_billable + 1 ELSE orders_billable END AS orders_billable) FROM by_month),
spoilt_payment AS (SELECT * REPLACE (CASE WHEN payment_method = '2-HIGH' THEN revenue + 1000 ELSE revenue END AS revenue) FROM by_payment),
spoilt_category AS (SELECT * REPLACE (CASE WHEN segment = 'BUILDING' THEN 'Sem segmento' ELSE segment END AS segment)
  FROM by_category WHERE segment <> 'MACHINERY')"""
_SPOILT_CHECKS = gold_gate_sql("spoilt_state", "spoilt_month", "spoilt_payment", "spoilt_category")


@query("g8_g15_spoilt_gold", O.with_judged(_SPOILT_CHECKS[0], *_SPOILT_CHECKS[1:-1], _SPOILT, _SPOILT_CHECKS[-1]))
def g8_g15_spoilt(spark, sf):
    """The same gate over marts that lost, gained or altered rows: every check has to fail."""
    silver = normalize.enrich(quarantine.valid_rows(_stored(spark, sf)), D.products_per_category)
    segment, year = F.col("segment"), F.col("year_month").like("1996%")
    by_month = marts.monthly_analysis(silver, D).withColumns({
        "revenue": F.when(year, -F.col("revenue")).otherwise(F.col("revenue")),
        "orders_billable": F.col("orders_billable") + year.cast("int"),
    })
    by_payment = marts.revenue_by_payment(silver, D)
    by_category = marts.category_by_segment(silver, P.customers(spark, sf), P.categories(spark, sf), D)
    return gates.gold_gate(
        silver,
        marts.revenue_by_state(silver, D).filter("state <> 'NATION_0'"),
        by_month,
        by_payment.withColumn("revenue", F.col("revenue") + F.when(F.col("payment") == "2-HIGH", 1000).otherwise(0)),
        by_category.filter(segment != "MACHINERY").withColumn(
            "segment", F.when(segment == "BUILDING", C.NO_SEGMENT).otherwise(segment)
        ),
        D, P.LIMITS,
    )


VERDICT = """
SELECT CASE WHEN count(*) FILTER (status = 'FAIL' AND blocking) > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict,
  count(*)::bigint AS checks_total, count(*) FILTER (status = 'PASS')::bigint AS checks_ok,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status = 'FAIL' AND blocking), '') AS blocking_failures
FROM ({checks})"""


def _over(template: str, parts: tuple[str, str]) -> tuple[str, str]:
    return template.format(checks=parts[0]), parts[1]


@query("g16_verdict", O.with_judged(*_over(VERDICT, silver_gate_sql("judged"))))
def g16(spark, sf):
    return gates.verdict(g1_g7_unclean(spark, sf))


@query("l8_failed_checks", O.with_judged(*_over(
    'SELECT "check", status, value, blocking FROM ({checks}) WHERE status = \'FAIL\'', silver_gate_sql("judged"))))
def l8(spark, sf):
    return gates.failed_checks(g1_g7_unclean(spark, sf)).select("check", "status", "value", "blocking")


# Silver with faults that leave the number of rows as it is: in one source a row of many is doubled for each that was
# lost, in another one an amount changed.
_FAULTS = f"""
spoilt AS (
  SELECT * REPLACE (CASE WHEN _source = 'source_1' AND l_partkey % 97 = 0 THEN total_amount + 1 ELSE total_amount END AS total_amount)
  FROM valid WHERE NOT (_source = 'source_2' AND l_partkey % 89 = 0)
  UNION ALL SELECT * FROM valid WHERE _source = 'source_2' AND l_partkey % 89 = 1
)"""


def _content(spark, sf):
    judged = _stored(spark, sf)
    silver = quarantine.valid_rows(judged)
    part = F.col("l_partkey")
    second = F.col("_source") == "source_2"
    spoilt = silver.filter(~(second & (part % 89 == 0))).withColumn(
        "total_amount",
        F.when((F.col("_source") == "source_1") & (part % 97 == 0), F.col("total_amount") + 1).otherwise(F.col("total_amount")),
    ).unionByName(silver.filter(second & (part % 89 == 1)))
    return judged, spoilt, quarantine.quarantined_rows(judged)


_CONTENT = (*C.SALES_FIELDS, "l_partkey", "l_suppkey")
_CONTENT_SQL = ", ".join(("_source", *_CONTENT))


@query("g1_by_content", O.with_judged(f"""
SELECT coalesce(b._source, a._source) AS _source, coalesce(b.n, 0)::bigint AS rows_before, coalesce(a.n, 0)::bigint AS rows_after,
  coalesce(b._source, a._source) NOT IN (
    SELECT _source FROM ((SELECT {_CONTENT_SQL} FROM judged EXCEPT ALL (SELECT {_CONTENT_SQL} FROM layers))
    UNION ALL ((SELECT {_CONTENT_SQL} FROM layers) EXCEPT ALL SELECT {_CONTENT_SQL} FROM judged))) AS same
FROM (SELECT _source, count(*) AS n FROM judged GROUP BY 1) b
FULL JOIN (SELECT _source, count(*) AS n FROM layers GROUP BY 1) a USING (_source)""",
    _FAULTS, f"layers AS (SELECT {_CONTENT_SQL} FROM spoilt UNION ALL SELECT {_CONTENT_SQL} FROM rejected)"))
def g1_content(spark, sf):
    judged, spoilt, rejected = _content(spark, sf)
    return content.differences(judged, [spoilt, rejected], _CONTENT)


@query("g1_content_gate", O.with_judged(f"""
SELECT 'conteudo_bronze_silver_quarentena' AS "check", 'conservacao' AS dimension,
  CASE WHEN groups = 0 THEN 'PASS' ELSE 'FAIL' END AS status, '{{"groups":' || groups || ',"missing":' || missing || '}}' AS value,
  'mesmas linhas em bronze e em silver + quarentena' AS expected, true AS blocking
FROM (SELECT (SELECT count(*) FROM judged) - (SELECT count(*) FROM layers) AS missing, count(DISTINCT _source) AS groups
  FROM ((SELECT {_CONTENT_SQL} FROM judged EXCEPT ALL (SELECT {_CONTENT_SQL} FROM layers))
    UNION ALL ((SELECT {_CONTENT_SQL} FROM layers) EXCEPT ALL SELECT {_CONTENT_SQL} FROM judged)))""",
    _FAULTS, f"layers AS (SELECT {_CONTENT_SQL} FROM spoilt UNION ALL SELECT {_CONTENT_SQL} FROM rejected)"))
def g1_content_gate(spark, sf):
    judged, spoilt, rejected = _content(spark, sf)
    return content.content_gate(judged, [spoilt, rejected], _CONTENT)
