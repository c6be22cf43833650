"""From raw layouts to the unified, typed Silver layout."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.functions import columns as X

LINEAGE = ("_source", "_source_file", "_ingestion_ts", "_batch_id", "_data_ref")
RAW = "_raw"


def add_lineage(df: DataFrame, source: str, run_id: str, data_ref: str) -> DataFrame:
    """Stamp rows with their origin.  Readers already supply ``_source_file``."""
    stamps = {
        "_source": F.lit(source),
        "_ingestion_ts": F.current_timestamp(),
        "_batch_id": F.lit(run_id),
        "_data_ref": F.lit(data_ref).cast("date"),
    }
    if "_source_file" not in df.columns:
        stamps["_source_file"] = F.input_file_name()
    return df.withColumns(stamps)


def rename_fields(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(renames))


def conform(df: DataFrame, fields: Sequence[str] = C.SALES_FIELDS) -> DataFrame:
    """Add every absent field as a NULL text column."""
    absent = [f for f in fields if f not in df.columns]
    return df.withColumns({f: F.lit(None).cast("string") for f in absent}) if absent else df


def type_sales(df: DataFrame, keep: Iterable[str] = LINEAGE, raw: bool = False) -> DataFrame:
    """One projection to the unified types; text that does not parse becomes NULL.

    ``raw`` carries the numbers and dates as they came in the struct ``_raw``, for rules that tell "did not parse" from
    "missing" and for a quarantine that shows what was sent.
    """
    upper = {f: F.upper(X.clean_text(f)) for f in ("order_id", "customer_id", "product_id", "shipping_state")}
    lower = {f: F.lower(X.clean_text(f)) for f in ("payment_method", "status")}
    instant = X.lenient_timestamp("order_date")
    typed = {
        **upper,
        **lower,
        "shipping_city": X.clean_text("shipping_city"),
        "quantity": F.col("quantity").try_cast("int"),
        "unit_price": F.col("unit_price").try_cast("double"),
        "total_amount": F.col("total_amount").try_cast("double"),
        "order_date": F.to_date(instant),
    }
    return df.select(
        *[typed[f].alias(f) for f in C.SALES_FIELDS],
        instant.alias("order_ts"),
        *([F.struct(*[F.col(f).cast("string").alias(f) for f in C.NATIVE_FIELDS]).alias(RAW)] if raw else []),
        *[c for c in keep if c in df.columns],
    )


def normalize_sales(
    df: DataFrame, renames: Mapping[str, str] | None = None, keep: Iterable[str] = LINEAGE, raw: bool = False
) -> DataFrame:
    """Rename, conform and type one sales source."""
    return type_sales(conform(rename_fields(df, renames or {})), keep, raw)


def unite(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all sources, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def minimize_customers(df: DataFrame) -> DataFrame:
    """Keep only what the marts need: no name, e-mail or phone ever gets past here."""
    return df.select(
        F.upper(X.clean_text("customer_id")).alias("customer_id"),
        X.clean_text("city").alias("customer_city"),
        F.upper(X.clean_text("state")).alias("customer_state"),
        F.initcap(X.clean_text("segment")).alias("segment"),
        F.to_date(X.lenient_timestamp("registration_date")).alias("registration_date"),
        *[c for c in ("_source", "_ingestion_ts") if c in df.columns],
    )


def with_key(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def one_per_key(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """A deterministic survivor per key: the smallest row in the given order.

    An aggregate, so copies of a hot key already collapse before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    order = list(order_by or [])
    layout = order + [c for c in rest if c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*layout)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in df.columns])


def customers_dimension(df: DataFrame) -> DataFrame:
    """One row per customer: the most complete, then the latest, registration and arrival.

    What is still equal is settled by the remaining columns.
    """
    rows = with_key(minimize_customers(df), "customer_id")
    facts = ("customer_city", "customer_state", "segment", "registration_date")
    missing = sum((F.col(c).isNull().cast("int") for c in facts), F.lit(0))
    ranked = rows.withColumns({
        "_missing": missing,
        "_age": F.coalesce(-F.unix_date("registration_date"), F.lit(2**31 - 1)),
        "_arrival": -F.unix_micros("_ingestion_ts") if "_ingestion_ts" in rows.columns else F.lit(0),
    })
    order = ("_missing", "_age", "_arrival")
    return one_per_key(ranked, "customer_id", order).drop(*order)


def flatten_categories(df: DataFrame, items: str = C.CATEGORIES) -> DataFrame:
    """One row per category of a nested document, with the number of its subcategories."""
    lineage = [c for c in ("_source", "_ingestion_ts") if c in df.columns]
    return df.select(F.explode(items).alias("item"), *lineage).select(
        F.col("item.category_id").alias("category_id"),
        F.col("item.category_name").alias("category_name"),
        F.size("item.subcategories").alias("subcategory_count"),
        *lineage,
    )


def enrich(df: DataFrame, products_per_category: int) -> DataFrame:
    """Category, month and load stamp of the valid rows."""
    return df.withColumns(
        {
            "category_id": X.category_of("product_id", products_per_category),
            "year_month": X.year_month("order_date"),
            "_silver_ts": F.current_timestamp(),
        }
    )
