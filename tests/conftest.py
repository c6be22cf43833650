import datetime as dt

import pytest
from pyspark.sql import SparkSession

from sales_layout import SALE


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("oreworks-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sale():
    """Factory of one good sale; keywords override fields."""
    arrived = dt.datetime(2023, 9, 2, 6, 30)

    def make(order_id="N-1", **changes):
        row = dict(
            order_id=order_id, customer_id="K77", product_id="PROD_1204", quantity=3, unit_price=7.5, total_amount=22.5,
            order_date=dt.date(2023, 8, 31), payment_method="boleto", shipping_city="Olinda", shipping_state="PE",
            status="shipped", _source="vendas_parquet", _source_file="p-04.parquet", _ingestion_ts=arrived,
            order_ts=dt.datetime(2023, 8, 31, 22, 5),
        )
        row.update(changes)
        return tuple(row.values())

    return make


@pytest.fixture
def sales(spark, sale):
    """Frame of sales from keyword dicts."""

    def build(*rows):
        return spark.createDataFrame([sale(**r) for r in rows], SALE)

    return build


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([("K77",)], "customer_id string")
