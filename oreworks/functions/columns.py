"""Column expressions shared by the operators.  All of them are Spark built-ins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreworks import contract as C

# Money is compared and summed as a decimal: exact, and independent of the order
# in which partitions are added up.  Six places keep prices finer than a cent.
MONEY = "decimal(38,6)"


def money(column: str | Column) -> Column:
    """Exact amount; an amount that does not fit is an error, never a silent NULL."""
    return _col(column).cast(MONEY)


def money_or_null(column: str | Column) -> Column:
    """Exact amount for rule checks, where an amount that does not fit fails the row."""
    return _col(column).try_cast(MONEY)


def clean_text(column: str | Column) -> Column:
    """Text without surrounding blanks; nothing left means NULL."""
    return F.nullif(F.trim(_col(column).cast("string")), F.lit(""))


def has_value(column: str | Column) -> Column:
    """True when there is a value and it is not just blanks."""
    return F.coalesce(F.length(F.trim(_col(column).cast("string"))) > 0, F.lit(False))


def lenient_timestamp(column: str | Column) -> Column:
    return F.try_to_timestamp(_col(column).cast("string"))


def year_month(column: str | Column) -> Column:
    return F.date_format(_col(column), "yyyy-MM")


def product_number(column: str | Column) -> Column:
    return F.regexp_extract(_col(column), C.PRODUCT_NUMBER_PATTERN, 1).try_cast("bigint")


def category_of(product: str | Column, per_category: int) -> Column:
    """Category code of a product number; NULL when the product has no number."""
    bucket = F.ceil(product_number(product) / F.lit(per_category)).cast("bigint")
    digits = bucket.cast("string")
    return F.concat(F.lit(C.CATEGORY_PREFIX), F.when(bucket < 10, F.concat(F.lit("0"), digits)).otherwise(digits))


def region_of(state: str | Column, regions: Mapping[str, Sequence[str]]) -> Column:
    """Region of a state, looked up in one constant map."""
    pairs = [F.lit(v) for region, states in regions.items() for s in states for v in (s, region)]
    known = F.try_element_at(F.create_map(*pairs), _col(state))
    return F.coalesce(known, F.lit(C.UNKNOWN_REGION))


def billable(cancelled: str, status: str | Column = "status") -> Column:
    return _col(status) != F.lit(cancelled)


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole`` with two places; NULL for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2)


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
