"""Columns of the sales that tests build; in a module of its own, for `conftest` may mean another folder's file."""

SALE = (
    "order_id string, customer_id string, product_id string, quantity int, unit_price double, "
    "total_amount double, order_date date, payment_method string, shipping_city string, "
    "shipping_state string, status string, _source string, _source_file string, "
    "_ingestion_ts timestamp, order_ts timestamp"
)
