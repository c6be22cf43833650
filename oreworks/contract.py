"""Fixed values of the data contract.

Everything in this module is data that other systems already rely on: folder
names, column names, rule names, domains, labels and limits.  The values are
stated as they are; nothing here is logic.
"""

# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------
SALES_CSV = "vendas_csv"
SALES_JSON = "vendas_json"
SALES_PARQUET = "vendas_parquet"
CUSTOMERS = "clientes"
CATEGORIES = "categorias"

SALES_FIELDS = (
    "order_id",
    "customer_id",
    "product_id",
    "quantity",
    "unit_price",
    "total_amount",
    "order_date",
    "payment_method",
    "shipping_city",
    "shipping_state",
    "status",
)

# Fields that are numbers or dates in the unified layout.
NATIVE_FIELDS = ("quantity", "unit_price", "total_amount", "order_date")

# Header of the delimited sales files -> canonical field.
CSV_RENAMES = {
    "cod_pedido": "order_id",
    "cod_cliente": "customer_id",
    "cod_produto": "product_id",
    "qtd": "quantity",
    "preco_unit": "unit_price",
    "valor_total": "total_amount",
    "data_pedido": "order_date",
    "forma_pagamento": "payment_method",
    "cidade_entrega": "shipping_city",
    "uf_entrega": "shipping_state",
    "situacao": "status",
}

CUSTOMER_FIELDS = ("customer_id", "city", "state", "segment", "registration_date")
CATEGORY_FIELDS = ("categorias",)

# ---------------------------------------------------------------------------
# Domains of the sales fields
# ---------------------------------------------------------------------------
STATUSES = ("pending", "shipped", "delivered", "cancelled")
CANCELLED = "cancelled"
PAYMENTS = ("credit_card", "debit_card", "pix", "boleto")
PERIOD = ("2023-01-01", "2023-12-31")
TOTAL_TOLERANCE = "0.01"
PRODUCTS_PER_CATEGORY = 500
PRODUCT_NUMBER_PATTERN = r"PROD_(\d+)"
CATEGORY_PREFIX = "CAT_"

REGIONS = {
    "Norte": ("AC", "AP", "AM", "PA", "RO", "RR", "TO"),
    "Nordeste": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "Centro-Oeste": ("DF", "GO", "MT", "MS"),
    "Sudeste": ("ES", "MG", "RJ", "SP"),
    "Sul": ("PR", "RS", "SC"),
}
UNKNOWN_REGION = "Desconhecida"
NO_CATEGORY = "Sem categoria"
NO_SEGMENT = "Sem segmento"

# ---------------------------------------------------------------------------
# Gate limits
# ---------------------------------------------------------------------------
QUARANTINE_RATE_MAX = 0.10
SILVER_ROWS_MIN = 50_000
RECONCILE_TOLERANCE = 1.0
QUARANTINE_RATE_ENV = "QUALITY_TAXA_QUARENTENA_MAX"
SILVER_ROWS_ENV = "QUALITY_VOLUME_MINIMO_SILVER"

# ---------------------------------------------------------------------------
# Rule names and quality dimensions
# ---------------------------------------------------------------------------
COMPLETENESS = "completude"
DOMAIN = "validade_dominio"
CONSISTENCY = "consistencia"
INTEGRITY = "integridade"
UNIQUENESS = "unicidade"
TYPING = "tipo"
CONSERVATION = "conservacao"
MONITORING = "monitoramento"
VOLUME = "volume"

RULE_STATUS = "dominio.status"
RULE_PAYMENT = "dominio.payment_method"
RULE_STATE = "dominio.shipping_state"
RULE_QUANTITY = "dominio.quantity_positiva"
RULE_UNIT_PRICE = "dominio.unit_price_positivo"
RULE_TOTAL = "dominio.total_amount_positivo"
RULE_PERIOD = "dominio.order_date_no_periodo"
RULE_CONSISTENCY = "consistencia.total_calculado"
RULE_INTEGRITY = "integridade.customer_id"
RULE_UNIQUENESS = "unicidade.order_id"

CHECK_CONSERVATION = "conservacao_bronze_silver_quarentena"
CHECK_CONTENT = "conteudo_bronze_silver_quarentena"
CHECK_COMPLETENESS = "completude_silver"
CHECK_UNIQUENESS = "unicidade_order_id_silver"
CHECK_DOMAIN = "validade_dominio_silver"
CHECK_INTEGRITY = "integridade_clientes_silver"
CHECK_QUARANTINE_RATE = "taxa_quarentena"
CHECK_VOLUME = "volume_minimo_silver"
CHECK_STATE_REVENUE = "reconciliacao_estado_vs_silver"
CHECK_MONTH_REVENUE = "reconciliacao_mensal_vs_silver"
CHECK_PAYMENT_REVENUE = "reconciliacao_pagamento_vs_silver"
CHECK_CATEGORY_REVENUE = "reconciliacao_categoria_vs_silver"
CHECK_KNOWN_DIMENSIONS = "gold_sem_categoria_ou_segmento_desconhecido"
CHECK_MONTH_ORDERS = "pedidos_mensal_vs_silver"
CHECK_STATES = "gold_estado_27_ufs"
CHECK_NEGATIVE_REVENUE = "gold_sem_faturamento_negativo"

# ---------------------------------------------------------------------------
# Folders under the data root
# ---------------------------------------------------------------------------
FOLDERS = {
    "raw": "raw",
    "bronze_sales": "bronze/vendas",
    "bronze": "bronze",
    "silver_sales": "silver/vendas",
    "silver_customers": "silver/clientes",
    "silver_categories": "silver/categorias",
    "quarantine": "quarentena/vendas",
    "gold_state": "gold/faturamento_por_estado",
    "gold_month": "gold/analise_mensal",
    "gold_payment": "gold/faturamento_por_pagamento",
    "gold_category": "gold/faturamento_categoria_segmento",
    "history": "quality/historico",
    "checks": "quality/verificacoes",
    "metrics": "quality/metricas",
}

# ---------------------------------------------------------------------------
# Column names on disk (name in this library -> name on disk)
# ---------------------------------------------------------------------------
PUBLISHED_COLUMNS = {
    # Silver and quarantine
    "year_month": "ano_mes",
    "subcategory_count": "qtd_subcategorias",
    "_reasons": "_motivos",
    "_main_reason": "_motivo_principal",
    "_dimension": "_dimensao",
    "_quarantined_at": "_quarentena_ts",
    # marts
    "revenue_rank": "ranking_faturamento",
    "state": "uf",
    "region": "regiao",
    "payment": "forma_pagamento",
    "revenue": "faturamento",
    "share_pct": "participacao_pct",
    "category_share_pct": "participacao_na_categoria_pct",
    "year_share_pct": "participacao_ano_pct",
    "orders_total": "pedidos_total",
    "orders_billable": "pedidos_faturados",
    "orders_cancelled": "pedidos_cancelados",
    "cancel_rate_pct": "taxa_cancelamento_pct",
    "avg_ticket": "ticket_medio",
    "unique_customers": "clientes_unicos",
    "items_sold": "itens_vendidos",
    "previous_revenue": "faturamento_mes_anterior",
    "growth_pct": "crescimento_mom_pct",
    "running_revenue": "faturamento_acumulado",
    # quality history
    "executed_at": "executado_em",
    "layer": "camada",
    "dimension": "dimensao",
    "value": "valor",
}

# ---------------------------------------------------------------------------
# Columns of the marts in their published order, under this library's names
# ---------------------------------------------------------------------------
STATE_COLUMNS = (
    "revenue_rank", "state", "region", "revenue", "share_pct", "orders_billable", "orders_cancelled",
    "orders_total", "cancel_rate_pct", "avg_ticket", "unique_customers", "items_sold",
)
MONTH_COLUMNS = (
    "year_month", "revenue", "previous_revenue", "growth_pct", "running_revenue", "year_share_pct",
    "orders_billable", "orders_cancelled", "orders_total", "cancel_rate_pct", "avg_ticket",
    "unique_customers", "items_sold",
)
PAYMENT_COLUMNS = (
    "payment", "revenue", "share_pct", "orders_billable", "orders_cancelled", "orders_total",
    "cancel_rate_pct", "avg_ticket", "unique_customers",
)
CATEGORY_COLUMNS = (
    "category_name", "segment", "revenue", "category_share_pct", "orders_billable", "orders_cancelled",
    "cancel_rate_pct", "avg_ticket", "unique_customers",
)

# ---------------------------------------------------------------------------
# Layout of the stored sales tables, under the names on disk
# ---------------------------------------------------------------------------
UNIFIED_SALES = (
    "order_id string, customer_id string, product_id string, quantity int, unit_price double, "
    "total_amount double, order_date date, order_ts timestamp, payment_method string, shipping_city string, "
    "shipping_state string, status string, _source string, _source_file string, _ingestion_ts timestamp, "
    "_batch_id string, _data_ref date"
)
STORED_LAYOUTS = {
    "silver_sales": UNIFIED_SALES + ", category_id string, _silver_ts timestamp, ano_mes string",
    "quarantine": UNIFIED_SALES
    + ", _motivos array<string>, _motivo_principal string, _dimensao string, _quarentena_ts timestamp",
}

# ---------------------------------------------------------------------------
# What the checks expect, as text
# ---------------------------------------------------------------------------
EXPECT_CONSERVATION = "bronze == silver + quarentena"
EXPECT_CONTENT = "mesmas linhas em bronze e em silver + quarentena"
EXPECT_COMPLETENESS = "0 nulos em campos obrigatórios"
EXPECT_INTEGRITY = "0 vendas com cliente fora do cadastro"
