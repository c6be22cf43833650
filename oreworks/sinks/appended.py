"""Append-only tables whose files stay few.

Every append adds a folder of its own and names it in the table's pointer.  Folders of like size are merged when there
are ``fan`` of them, so a table of many one-row appends has a few files for every power of ``fan``, and a row is written
again about once per power.  A merge publishes the merged rows in place of the folders they came from, at once: a reader
sees either, and what was appended meanwhile stays.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from oreworks.sinks.published import VERSIONS, Leaves, Publication, children, files_of, publication, published

#: Folders of like size that are merged into one; sizes below the smallest are alike; larger ones stay as they are.
FAN, SMALLEST, LARGEST = 32, 16 << 10, 128 << 20


def append(df: DataFrame, path: str, fan: int = FAN) -> None:
    """Add rows to the table; an append that fails adds none.

    Rows of a plain folder of files, as older versions left them, become part of the table with the first append.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    with publication(spark, path) as new:
        added = new.write(df.write, "")
        earlier = [] if published(spark, path) else _adopt(new, path)
        new.changes.append(lambda now: {**now, "": [*now.get("", earlier), *added]})
    merge(spark, path, fan)


def _adopt(new: Publication, path: str) -> list[str]:
    plain = [n for n in children(new.spark, path) if not n.startswith(("_", "."))]
    if not plain:
        return []
    rows = new.spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{n}" for n in plain])
    return new.write(rows.coalesce(1).write, "")


def due(sizes: Mapping[str, int], fan: int = FAN) -> list[str]:
    """The folders to merge next, in their order: of one class of sizes, the smallest that is full; none if none is."""
    classes: dict[int, list[str]] = {}
    for folder, size in sizes.items():
        if size < LARGEST:
            power, bound = 0, SMALLEST
            while size >= bound:
                power, bound = power + 1, bound * fan
            classes.setdefault(power, []).append(folder)
    return next((found for _, found in sorted(classes.items()) if len(found) >= fan), [])


def merge(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Merge folders as long as a class of sizes is full."""
    path = path.rstrip("/")
    while True:
        folders = published(spark, path).get("", [])
        # With fewer folders no class is full; their sizes need not be asked for.
        group = due({f: _size(spark, f"{path}/{f}") for f in folders}, fan) if len(folders) >= fan else []
        if not group:
            return
        with publication(spark, path) as new:
            reader = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/{VERSIONS}")
            rows = reader.parquet(*[f"{path}/{f}" for f in group]).drop("v")
            merged = new.write(rows.coalesce(1).write, "")
            new.changes.append(lambda now: _instead(now, group, merged))
        if merged[0] not in published(spark, path).get("", []):
            new.discard()  # another process has merged some of these folders


def _instead(now: Leaves, group: list[str], merged: list[str]) -> Leaves:
    """The merged folder in the place of its parts, if all of them are still part of the table."""
    folders = now.get("", [])
    if not set(group) <= set(folders):
        return now
    first = folders.index(group[0])
    rest = [f for f in folders if f not in set(group)]
    return {**now, "": [*rest[:first], *merged, *rest[first:]]}


def _size(spark: SparkSession, folder: str) -> int:
    files, where = files_of(spark, folder)
    return files.getContentSummary(where).getLength()
