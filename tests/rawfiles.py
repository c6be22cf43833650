"""Small raw sources written by the tests: every format, with text and native types."""

import json
import pathlib

from pyspark.sql import functions as F

CATEGORIES = {
    "categorias": [
        {"category_id": "CAT_01", "category_name": "Eletrônicos",
         "subcategories": [{"subcategory_id": "S1", "subcategory_name": "TVs"},
                           {"subcategory_id": "S2", "subcategory_name": "Áudio"}]},
        {"category_id": "CAT_02", "category_name": "Moda",
         "subcategories": [{"subcategory_id": "S3", "subcategory_name": "Roupas"}]},
    ],
    "generated_at": "2023-01-01",
}

CSV_HEADER = ("cod_pedido;cod_cliente;cod_produto;qtd;preco_unit;valor_total;data_pedido;"
              "forma_pagamento;cidade_entrega;uf_entrega;situacao")

CSV_LINES = [
    " p1 ;c1;prod_0001;2;10.0;20.0;2023-01-05;PIX;São Paulo;sp;Delivered",
    "P2;C2;PROD_0600;1;5.5;5.5;2023-02-05 10:30:00;boleto;Maceió;AL;cancelled",
    "P3;C1;PROD_0001;many;10.0;20.0;2023-01-05;pix;Santos;SP;delivered",      # quantity is no number
    "P4;C1;PROD_0001;2;10.0;20.0;someday;pix;Santos;SP;delivered",            # date is no date
    "P5;C9;PROD_0001;2;10.0;20.0;2023-03-05;pix;Santos;SP;delivered",         # customer unknown
]

JSON_SALES = [
    {"order_id": "J1", "customer_id": "C3", "product_id": "PROD_0500", "quantity": 3, "unit_price": 2.0,
     "total_amount": 6.0, "order_date": "2023-02-10", "payment_method": "credit_card",
     "shipping_city": "Curitiba", "shipping_state": "PR", "status": "shipped"},
    {"order_id": "P1", "customer_id": "C1", "product_id": "PROD_0001", "quantity": 2, "unit_price": 10.0,
     "total_amount": 20.0, "order_date": "2023-01-05", "payment_method": "pix",
     "shipping_city": "Santos", "shipping_state": "SP", "status": "delivered"},  # repeats the CSV row
]


def write_raw(spark, root):
    raw = pathlib.Path(root) / "raw"
    csv, js, cat = raw / "vendas_csv", raw / "vendas_json", raw / "categorias"
    for folder in (csv, js, cat):
        folder.mkdir(parents=True)
    (csv / "a.csv").write_text("\n".join([CSV_HEADER, *CSV_LINES[:3]]) + "\n", encoding="ISO-8859-1")
    (csv / "b.csv").write_text("\n".join([CSV_HEADER, *CSV_LINES[3:]]) + "\n", encoding="ISO-8859-1")
    for i, record in enumerate(JSON_SALES):
        (js / f"page{i}.json").write_text(json.dumps({"page": i, "data": [record]}, indent=1))
    (cat / "categorias.json").write_text(json.dumps(CATEGORIES, ensure_ascii=False, indent=1), encoding="utf-8")

    sales = spark.createDataFrame(
        [("Q%d" % i, "C%d" % (1 + i % 3), "PROD_%04d" % (1 + i * 37 % 1000), 2, 7.25, 14.5, "debit_card", "Rio", "RJ",
          "cancelled" if i % 5 == 0 else "pending") for i in range(40)],
        "order_id string, customer_id string, product_id string, quantity int, unit_price double, "
        "total_amount double, payment_method string, shipping_city string, shipping_state string, status string",
    )
    sales.withColumn("order_date", F.expr("date_add(date'2023-01-01', cast(substr(order_id, 2) as int) * 9)")).write.parquet(
        str(raw / "vendas_parquet")
    )
    spark.createDataFrame(
        [("c1", "Ana", "a@x.br", "Santos", "sp", "varejo", "2020-01-01"),
         ("C2", "Bia", "b@x.br", "Recife", "PE", "ATACADO", "not a date"),
         ("C3", "Cau", "c@x.br", " ", "PR", "varejo", "2021-02-03"),
         ("C3", "Cau", "c@x.br", " ", "PR", "varejo", "2021-02-03"),
         (None, "Nil", "n@x.br", "X", "SP", "varejo", "2021-02-03")],
        "customer_id string, name string, email string, city string, state string, segment string, registration_date string",
    ).write.parquet(str(raw / "clientes"))
