"""Writers of the layers, and short-lived tables that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from oreworks import contract as C
from oreworks.sinks import appended
from oreworks.sinks.published import COMPRESSION, publication, published, remove, scan


def publish_names(df: DataFrame) -> DataFrame:
    """Names used in this library -> column names on disk."""
    return df.withColumnsRenamed(C.PUBLISHED_COLUMNS)


def in_layout(df: DataFrame, table: str) -> DataFrame:
    """A sales table under its names on disk, with the columns of its layout in order."""
    return publish_names(df).select(*T.StructType.fromDDL(C.STORED_LAYOUTS[table]).names)


def overwrite(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace the table; a rerun never adds rows twice, a failed one leaves the old rows.

    The new rows become the table when its pointer names them, so a table may be
    computed from itself.
    """
    with publication(df.sparkSession, path) as new:
        new.replace("", new.write(df.write, "", by))


def overwrite_by_partition(df: DataFrame, path: str, by: str, mode: str = "static") -> None:
    """Replace a partitioned table, whole (static) or only the partitions at hand (dynamic).

    The rebalance gathers each partition into few, evenly sized files; one that
    holds a large part of the rows is split over many tasks.
    """
    balanced = df.hint("rebalance", by)
    if mode == "static":
        overwrite(balanced, path, [by])
    else:
        with publication(df.sparkSession, path) as new:
            new.replace_partitions("", new.write(balanced.write, "", [by]))


def overwrite_balanced(df: DataFrame, path: str) -> None:
    """Replace a table of unknown size with evenly sized files."""
    overwrite(df.hint("rebalance"), path)


def overwrite_small(df: DataFrame, path: str) -> None:
    """Replace a small result (a mart) as a single file."""
    overwrite(df.coalesce(1), path)


def read(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """The rows of a table that the functions above wrote, or of a plain folder of files."""
    leaves = published(spark, path.rstrip("/")).get("")
    if leaves is None:
        return (spark.read.schema(layout) if layout else spark.read).parquet(path)
    return scan(spark, path, leaves, layout)


def append(df: DataFrame, path: str) -> None:
    """Add rows to an append-only table; many small appends leave few files."""
    appended.append(df, path)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; without one, only a local master may use its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="oreworks-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/oreworks/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write an intermediate result to a shared folder and go on from the stored copy.

    Survives the loss of executors, and its size is known to whoever joins it.
    """
    spark = df.sparkSession
    path = f"{root}/{name}-{uuid.uuid4().hex}" if root else scratch_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession, root: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``stage`` into a folder under the lake's root, which goes when the plan is done."""
    folder = f"{root.rstrip('/')}/_stage/{uuid.uuid4().hex}"
    try:
        yield lambda df, name: stage(df, name, folder)
    finally:
        remove(spark, folder)
