"""Immutable settings handed to the operators and plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from oreworks import contract as C


@dataclass(frozen=True)
class Domains:
    """What a sale may contain."""

    statuses: tuple[str, ...] = C.STATUSES
    cancelled: str = C.CANCELLED
    payments: tuple[str, ...] = C.PAYMENTS
    regions: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(C.REGIONS))
    period: tuple[str, str] = C.PERIOD
    tolerance: Decimal = Decimal(C.TOTAL_TOLERANCE)
    required: tuple[str, ...] = C.SALES_FIELDS
    products_per_category: int = C.PRODUCTS_PER_CATEGORY

    @property
    def states(self) -> tuple[str, ...]:
        return tuple(sorted(s for group in self.regions.values() for s in group))


@dataclass(frozen=True)
class Limits:
    """Pass marks of the quality gates."""

    quarantine_rate_max: float = C.QUARANTINE_RATE_MAX
    silver_rows_min: int = C.SILVER_ROWS_MIN
    reconcile_tolerance: float = C.RECONCILE_TOLERANCE

    @classmethod
    def from_env(cls, env=os.environ) -> "Limits":
        return cls(
            quarantine_rate_max=float(env.get(C.QUARANTINE_RATE_ENV, C.QUARANTINE_RATE_MAX)),
            silver_rows_min=int(env.get(C.SILVER_ROWS_ENV, C.SILVER_ROWS_MIN)),
        )


@dataclass(frozen=True)
class Scale:
    """Bounds that decide between a broadcast and a shuffle; results are the same."""

    broadcast_rows: int = 2_000_000
    broadcast_bytes: int = 128 * 1024 * 1024


@dataclass(frozen=True)
class SourceSpec:
    """One raw source: where it is, how it is read and what it must contain.

    ``schema`` is optional.  Without it Spark infers the layout of JSON (one more
    pass over the files); a declared schema reads the files once.
    """

    name: str
    kind: str  # delimited | records_json | split_records_json | document_json | parquet
    pattern: str
    required: tuple[str, ...]
    renames: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    is_sales: bool = False
    priority: int = 0
    # Path of a field, nested ones as ``items[].price`` -> type that its values owe (``sources.typed.type_report``).
    types: dict[str, str] = field(default_factory=dict)


def default_sources() -> tuple[SourceSpec, ...]:
    return (
        SourceSpec(
            C.SALES_CSV, "delimited", "*.csv", tuple(C.CSV_RENAMES),
            renames=dict(C.CSV_RENAMES),
            options={"sep": ";", "encoding": "ISO-8859-1"},
            is_sales=True, priority=0,
        ),
        SourceSpec(C.SALES_JSON, "records_json", "*.json", C.SALES_FIELDS, is_sales=True, priority=1),
        SourceSpec(C.SALES_PARQUET, "parquet", "*.parquet", C.SALES_FIELDS, is_sales=True, priority=2),
        SourceSpec(C.CUSTOMERS, "parquet", "*.parquet", C.CUSTOMER_FIELDS),
        SourceSpec(C.CATEGORIES, "document_json", "*.json", C.CATEGORY_FIELDS),
    )


@dataclass(frozen=True)
class Settings:
    """Everything one run needs to know."""

    root: str
    run_id: str = "manual"
    data_ref: str = "1970-01-01"
    domains: Domains = field(default_factory=Domains)
    limits: Limits = field(default_factory=Limits)
    scale: Scale = field(default_factory=Scale)
    sources: tuple[SourceSpec, ...] = field(default_factory=default_sources)
    # Which of several valid rows with one key counts as the first.
    keep_first_by: tuple[str, ...] = ("_ingestion_ts", "_source_priority", "_source_file", "order_ts")
    # Days and months are those of this zone; None keeps the session's.
    time_zone: str | None = None

    def folder(self, table: str, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), C.FOLDERS[table], *parts])

    def relative(self, folder: str) -> str:
        """A folder of the lake as its published tables name it."""
        return folder.removeprefix(self.root.rstrip("/") + "/")

    @property
    def sales_sources(self) -> tuple[SourceSpec, ...]:
        return tuple(s for s in self.sources if s.is_sales)

    def bronze_folder(self, source: SourceSpec) -> str:
        return self.folder("bronze_sales" if source.is_sales else "bronze", source.name)

    def bronze_table(self, source: SourceSpec) -> str:
        """The source's name among the published tables."""
        return f"bronze/{source.name}"

    def with_limits(self, **changes) -> "Settings":
        return replace(self, limits=replace(self.limits, **changes))


def pin_time_zone(spark: SparkSession, settings: Settings) -> None:
    """Make the session's days those of the settings; plans do so when they start."""
    if settings.time_zone:
        spark.conf.set("spark.sql.session.timeZone", settings.time_zone)
