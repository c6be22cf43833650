"""Whether two sets of rows hold the same rows, told by digests that don't depend on order.

A count can't see that one row was lost while another was doubled, or that a value changed on the way.  The digest of a
set of rows is their number and the sums of two 64-bit hashes; digests add up, so they are made in one scan, collapse in
every task and may be kept per delivery.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.operators.gates import Check, check_rows
from oreworks.operators.normalize import unite

ROWS, FIRST, SECOND = "_rows", "_first", "_second"
#: Sums of 64-bit values: ten digits are left for the number of rows before a sum of this type is NULL.
_SUMMAND = "decimal(28,0)"


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    """A hash of all values of a row; a NULL differs from every value and has its place."""
    # Spark's hash passes over NULLs, which would let them trade places with their neighbours.
    missing = [F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(columns)]
    holes = F.array_compact(F.array(*missing)) if missing else F.array()
    return F.xxhash64(F.lit(seed), holes, *columns)


def digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group (one in all without ``by``): number of rows and the sums of their hashes.

    An empty frame has no group; without ``by`` its digest is zero.
    """
    sums = [
        F.coalesce(F.sum(_row_hash(columns, seed).cast(_SUMMAND)), F.lit(0).cast("decimal(38,0)")).alias(name)
        for seed, name in ((17, FIRST), (101, SECOND))
    ]
    return df.groupBy(*by).agg(F.count("*").alias(ROWS), *sums)


def differences(
    before: DataFrame, after: Sequence[DataFrame], columns: Sequence[str], by: Sequence[str] = ("_source",)
) -> DataFrame:
    """Per group: rows before, rows after (of all frames together), and whether they are the same rows.

    Groups that only one side has are listed too; NULL is a group like any other.
    """
    sides = [digest(before, columns, by).withColumns({"_sign": F.lit(1)})]
    sides += [digest(frame, columns, by).withColumns({"_sign": F.lit(-1)}) for frame in after]
    parts = unite(sides)
    sign = F.col("_sign")

    def rows(side: int) -> Column:
        return F.sum(F.when(sign == side, F.col(ROWS)).otherwise(0))

    def left(name: str) -> Column:
        # Groups have few parts, one per frame, so their sums fit.
        return F.sum(F.when(sign == 1, F.col(name)).otherwise(-F.col(name)))

    same = (left(ROWS) == 0) & (left(FIRST) == 0) & (left(SECOND) == 0)
    return parts.groupBy(*by).agg(
        rows(1).alias("rows_before"), rows(-1).alias("rows_after"),
        # A sum too large for its type is no proof of equality.
        F.coalesce(same, F.lit(False)).alias("same"),
    )


def content_checks(compared: DataFrame) -> DataFrame:
    """The gate's check on ``differences``: no group differs."""
    n = F.col
    measured = compared.agg(
        F.count_if(~n("same")).alias("groups"),
        F.coalesce(F.sum(n("rows_before") - n("rows_after")), F.lit(0)).alias("missing"),
    )
    return check_rows(measured, [Check(
        C.CHECK_CONTENT, C.CONSERVATION, n("groups") == 0, F.to_json(F.struct("groups", "missing")),
        F.lit(C.EXPECT_CONTENT),
    )])


def content_gate(
    before: DataFrame, after: Sequence[DataFrame], columns: Sequence[str], by: Sequence[str] = ("_source",)
) -> DataFrame:
    """Every row of ``before`` is in exactly one of the frames ``after``, unchanged, and nothing else is there."""
    return content_checks(differences(before, after, columns, by))
