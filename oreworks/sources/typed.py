"""Do the values of a source have the types that its contract states?"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks.config import SourceSpec
from oreworks.functions import columns as X
from oreworks.operators.normalize import unite

ELEMENTS = "[]"


def physical_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of the values at a path such as ``items[].price``; None where the layout has no such path."""
    found: T.DataType = schema
    for step in path.split("."):
        name, depth = step.rstrip(ELEMENTS), step.count(ELEMENTS)
        fields = {f.name.lower(): f.dataType for f in found.fields} if isinstance(found, T.StructType) else {}
        found = fields.get(name.lower())
        for _ in range(depth):
            found = found.elementType if isinstance(found, T.ArrayType) else None
    return found


def values_at(path: str) -> Column:
    """All values of a row at a path, as one array.  A missing list has no elements."""
    current = None
    for step in path.split("."):
        name = step.rstrip(ELEMENTS)
        if current is None:
            current = F.array(F.col(f"`{name}`"))
        else:
            current = F.transform(current, _field(name))
        for _ in range(step.count(ELEMENTS)):
            current = F.flatten(F.filter(current, lambda v: v.isNotNull()))
    return current


def _field(name: str):
    return lambda v: v.getField(name)


def parses(value: Column, physical: T.DataType, expected: str) -> Column:
    """True when a value that is there can be read as the expected type, the way the typed projection reads it."""
    if physical.simpleString() == expected:
        return F.lit(True)
    if isinstance(physical, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(False)
    if expected in ("date", "timestamp"):
        return X.lenient_timestamp(value).isNotNull()
    source = value if isinstance(physical, T.NumericType) else value.cast("string")
    return source.try_cast(expected).isNotNull()


def type_report(frames: Mapping[str, DataFrame], specs: Iterable[SourceSpec]) -> DataFrame:
    """(source, field, expected, physical, present, values, missing, unparsed) for each entry of ``SourceSpec.types``.

    ``missing`` counts values that are NULL or blank, ``unparsed`` values that are there and are not of the expected type, so
    a field that never came and one that came in another format differ.  A field that the layout lacks has no physical
    type and no values.  One pass over each source, whatever the number of fields; nested values are counted in their row.
    """
    return unite(_types_of(frames[spec.name], spec) for spec in specs)


def _types_of(df: DataFrame, spec: SourceSpec) -> DataFrame:
    fields = list(spec.types.items())
    physical = {path: physical_type(df.schema, path) for path, _ in fields}
    sums = [
        total.alias(f"n{i}_{k}")
        for i, (path, expected) in enumerate(fields)
        for k, total in enumerate(_totals(path, physical[path], expected))
    ]
    entries = [
        F.struct(
            F.lit(path).alias("field"), F.lit(expected).alias("expected"),
            F.lit(physical[path].simpleString() if physical[path] else None).cast("string").alias("physical"),
            F.lit(physical[path] is not None).alias("present"),
            *(F.col(f"n{i}_{k}").alias(name) for k, name in enumerate(("values", "missing", "unparsed"))),
        )
        for i, (path, expected) in enumerate(fields)
    ]
    counted = df.agg(F.count("*").alias("_rows"), *sums)
    return counted.select(F.lit(spec.name).alias("source"), F.inline(F.array(*entries)))


def _totals(path: str, physical: T.DataType | None, expected: str) -> list[Column]:
    if physical is None:
        return [F.lit(0).cast("bigint")] * 3
    missing = lambda v: ~X.has_value(v)
    unparsed = lambda v: X.has_value(v) & ~parses(v, physical, expected)
    if ELEMENTS in path:
        arrays = [values_at(path), F.filter(values_at(path), missing), F.filter(values_at(path), unparsed)]
        return [F.coalesce(F.sum(F.size(a).cast("bigint")), F.lit(0).cast("bigint")) for a in arrays]
    value = F.col(".".join(f"`{step}`" for step in path.split(".")))
    return [F.count("*"), F.count_if(missing(value)), F.count_if(unparsed(value))]
