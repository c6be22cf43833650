"""Joins of sales with their dimensions, and the size check behind every broadcast."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Scale
from oreworks.operators.rules import KNOWN, member_flag


def fits_broadcast(df: DataFrame, scale: Scale) -> bool:
    """Whether a stored table is small enough for every executor.

    Rows and their widths are added up inside every task; nothing else is moved.
    """
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= scale.broadcast_rows and size <= scale.broadcast_bytes


def checked_broadcast(df: DataFrame, scale: Scale) -> DataFrame:
    """A broadcast hint only behind the size check; otherwise Spark shuffles the join."""
    return F.broadcast(df) if fits_broadcast(df, scale) else df


def flag_known(sales: DataFrame, registry: DataFrame, key: str = "customer_id", small: bool = False) -> DataFrame:
    """Tag each row with whether its key is registered.

    No hint unless the caller checked the size: Spark broadcasts the ids when it knows
    them to be small, else shuffles and splits hot keys of the sales side at run time.
    """
    known = registry.select(key).distinct().withColumn(KNOWN, F.lit(True))
    if small:
        known = F.broadcast(known)
    return sales.join(known, key, "left").withColumn(KNOWN, F.coalesce(KNOWN, F.lit(False)))


def flag_members(
    sales: DataFrame, sets: Mapping[str, DataFrame], scale: Scale = Scale(),
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Tag each row, per field, with whether its value is in the field's set: the first column of a table.

    A set that is measured to be small is broadcast.  Of a larger one only the values
    that sales use matter: they are made distinct before they are shuffled, so a hot value
    is one row per task, and what is left of the set is broadcast if it is small then.
    ``stage`` stores that rest, so that its size can be measured without finding it twice.
    NULL is in no set.
    """
    for field, table in sets.items():
        allowed = table.select(F.col(table.columns[0]).alias(field)).filter(F.col(field).isNotNull()).distinct()
        if not fits_broadcast(allowed, scale):
            used = sales.filter(F.col(field).isNotNull()).select(field).distinct()
            allowed = used.join(allowed, field, "left_semi")
            if stage is not None:
                allowed = checked_broadcast(stage(allowed, f"used-{field}"), scale)
        else:
            allowed = F.broadcast(allowed)
        flag = member_flag(field)
        flagged = allowed.withColumn(flag, F.lit(True))
        sales = sales.join(flagged, field, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return sales


def unknown_keys(sales: DataFrame, registry: DataFrame, key: str = "customer_id") -> DataFrame:
    """Distinct keys without a registry entry.

    Keys are made distinct before the shuffle, so a hot key is one row per task.
    """
    used = sales.filter(F.col(key).isNotNull()).select(key).distinct()
    return used.join(registry.select(key), key, "left_anti")


def orphan_rows(sales: DataFrame, registry: DataFrame, key: str = "customer_id") -> DataFrame:
    """Sales rows per unregistered key, pre-aggregated before the anti join.

    A NULL key is registered nowhere, so it counts as an orphan too.
    """
    return (
        sales.groupBy(key).agg(F.count("*").alias("orphans"))
        .join(registry.select(key), key, "left_anti")
    )


def with_category_name(sales: DataFrame, categories: DataFrame) -> DataFrame:
    return sales.join(categories.select("category_id", "category_name"), "category_id", "left")


def with_segment(sales: DataFrame, customers: DataFrame) -> DataFrame:
    return sales.join(customers.select("customer_id", "segment"), "customer_id", "left")


def label_unmatched(df: DataFrame) -> DataFrame:
    return df.fillna({"category_name": C.NO_CATEGORY, "segment": C.NO_SEGMENT})
