"""SQL views of the same data for the comparison engine."""

from __future__ import annotations

from testprofile.tables import DOMAINS

SALES = """
sales AS (
  SELECT l_orderkey || '-' || l_linenumber AS order_id,
         'C' || o_custkey AS customer_id,
         'PROD_' || (l_partkey + 1) AS product_id,
         l_quantity::int AS quantity,
         ((2 * round(l_extendedprice * 100)::bigint + l_quantity::bigint) // (2 * l_quantity::bigint)) / 100 AS unit_price,
         l_extendedprice AS total_amount,
         o_orderdate::date AS order_date,
         o_orderdate AS order_ts,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS payment_method,
         c_name AS shipping_city,
         n_name AS shipping_state,
         l_returnflag AS status,
         'source_' || (l_linenumber % 3) AS _source,
         printf('CAT_%02d', ceil((l_partkey + 1) / 500)::int) AS category_id,
         strftime(o_orderdate, '%Y-%m') AS year_month,
         l_partkey, l_suppkey, l_shipdate, l_discount, l_tax, l_linestatus
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

REGISTRY = """
registry AS (SELECT 'C' || c_custkey AS customer_id FROM customer WHERE c_acctbal >= 0)"""

CUSTOMERS = """
customers AS (SELECT 'C' || c_custkey AS customer_id, c_mktsegment AS segment FROM customer)"""

CATEGORIES = """
categories AS (
  SELECT DISTINCT printf('CAT_%02d', ceil((p_partkey + 1) / 500)::int) AS category_id,
         'Category ' || printf('%02d', ceil((p_partkey + 1) / 500)::int) AS category_name
  FROM part
)"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# (rule, condition of a good row), in rule order
CONDITIONS = [
    *(
        (f"completude.{f}", f"({f} IS NOT NULL AND trim({f}::varchar) <> '')")
        for f in DOMAINS.required
    ),
    ("dominio.status", f"(status IS NULL OR status IN {_in(DOMAINS.statuses)})"),
    ("dominio.payment_method", f"(payment_method IS NULL OR payment_method IN {_in(DOMAINS.payments)})"),
    ("dominio.shipping_state", f"(shipping_state IS NULL OR shipping_state IN {_in(DOMAINS.states)})"),
    ("dominio.quantity_positiva", "(quantity IS NULL OR quantity > 0)"),
    ("dominio.unit_price_positivo", "(unit_price IS NULL OR unit_price > 0)"),
    ("dominio.total_amount_positivo", "(total_amount IS NULL OR total_amount > 0)"),
    (
        "dominio.order_date_no_periodo",
        f"(order_date IS NULL OR order_date BETWEEN DATE '{DOMAINS.period[0]}' AND DATE '{DOMAINS.period[1]}')",
    ),
    (
        "consistencia.total_calculado",
        "(total_amount IS NULL OR quantity IS NULL OR unit_price IS NULL OR "
        "abs(total_amount::decimal(18,6) - quantity * unit_price::decimal(18,6)) "
        f"<= {DOMAINS.tolerance}::decimal(18,6))",
    ),
    ("integridade.customer_id", "(customer_id IS NULL OR known)"),
]

_LIST = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in CONDITIONS)

FLAGGED = f"""
{REGISTRY.strip()},
flagged AS (
  SELECT s.*, r.customer_id IS NOT NULL AS known
  FROM sales s LEFT JOIN registry r ON s.customer_id = r.customer_id
)"""

ORDER = (
    "order_date, l_shipdate, l_partkey, l_suppkey, total_amount, quantity, l_discount, l_tax, status, l_linestatus"
)


def judged(order: str = ORDER) -> str:
    return f"""
{FLAGGED.strip()},
reasoned AS (
  SELECT *, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS found FROM flagged
),
numbered AS (
  SELECT *, CASE WHEN len(found) = 0 THEN
    row_number() OVER (PARTITION BY order_id, len(found) = 0 ORDER BY {order}) END AS occurrence
  FROM reasoned
),
judged AS (
  SELECT *, CASE WHEN occurrence > 1 THEN ['unicidade.order_id'] ELSE found END AS reasons FROM numbered
),
valid AS (SELECT * FROM judged WHERE len(reasons) = 0),
rejected AS (SELECT *, reasons[1] AS main_reason FROM judged WHERE len(reasons) > 0)"""


def with_sales(select: str, *more: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (SALES, *more)) + "\n" + select


def with_judged(select: str, *more: str, order: str = ORDER) -> str:
    return with_sales(select, judged(order), *more)


REVENUE = (
    "round(coalesce(sum(CASE WHEN status <> 'R' THEN total_amount::decimal(18,6) END), 0), 2)::decimal(30,2)"
)
MEASURES = f"""
  count(*)::bigint AS orders_total,
  count(*) FILTER (status <> 'R')::bigint AS orders_billable,
  count(*) FILTER (status = 'R')::bigint AS orders_cancelled,
  {REVENUE} AS revenue,
  count(DISTINCT CASE WHEN status <> 'R' THEN customer_id END)::bigint AS unique_customers,
  coalesce(sum(CASE WHEN status <> 'R' THEN quantity END), 0)::bigint AS items_sold"""


def half_up(expression: str, places: int = 2) -> str:
    """Round half up on the decimal value, not on its binary neighbour."""
    return f"round(({expression})::decimal(38,12), {places})::double"


RATIOS = f"""
  {half_up('revenue::double / nullif(orders_billable, 0)')} AS avg_ticket,
  {half_up('orders_cancelled::double / nullif(orders_total, 0)::double * 100')} AS cancel_rate_pct"""


def metrics(keys: str, source: str = "sales") -> str:
    return f"metrics AS (SELECT {keys}, {MEASURES} FROM {source} GROUP BY {keys})"


def share(name: str, over: str = "") -> str:
    ratio = f"revenue::double / nullif(sum(revenue) OVER ({over}), 0)::double * 100"
    return f"{half_up(ratio)} AS {name}"


REGION = "CASE " + " ".join(
    f"WHEN shipping_state IN {_in(states)} THEN '{region}'" for region, states in DOMAINS.regions.items()
) + " ELSE 'Desconhecida' END"

STATE_SELECT = f"""
SELECT dense_rank() OVER (ORDER BY revenue DESC)::int AS revenue_rank, shipping_state AS state,
  {REGION} AS region, revenue::double AS revenue, {share('share_pct')},
  orders_billable, orders_cancelled, orders_total, {RATIOS}, unique_customers, items_sold
FROM metrics"""

GROWTH = half_up("(revenue::double / nullif(lag(revenue) OVER (ORDER BY year_month), 0)::double - 1) * 100")

MONTH_SELECT = f"""
SELECT year_month, revenue::double AS revenue,
  (lag(revenue) OVER (ORDER BY year_month))::double AS previous_revenue,
  {GROWTH} AS growth_pct,
  (sum(revenue) OVER (ORDER BY year_month ROWS UNBOUNDED PRECEDING))::double AS running_revenue,
  {share('year_share_pct')},
  orders_billable, orders_cancelled, orders_total, {RATIOS}, unique_customers, items_sold
FROM metrics"""

PAYMENT_SELECT = f"""
SELECT payment_method AS payment, revenue::double AS revenue, {share('share_pct')},
  orders_billable, orders_cancelled, orders_total, {RATIOS}, unique_customers
FROM metrics"""

LABELLED = """
labelled AS (
  SELECT s.*, coalesce(category_name, 'Sem categoria') AS category_name, coalesce(segment, 'Sem segmento') AS segment
  FROM {source} s LEFT JOIN categories USING (category_id) LEFT JOIN customers USING (customer_id)
)"""

CATEGORY_SELECT = f"""
SELECT category_name, segment, revenue::double AS revenue, {share('category_share_pct', 'PARTITION BY category_name')},
  orders_billable, orders_cancelled, {RATIOS}, unique_customers
FROM metrics"""


def category_parts(source: str = "sales") -> list[str]:
    return [CUSTOMERS, CATEGORIES, LABELLED.format(source=source), metrics("category_name, segment", "labelled")]
