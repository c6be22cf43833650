"""Tables that change by a pointer.

New rows go to a folder of their own. One small file, written last, says which folders the tables of a scope (a lake, or
one table by itself) consist of; readers look there first. A run that stops between any two steps leaves the old rows or
the new ones, of all tables that are published together, and nothing is renamed or copied but that file.

    <table's folder>/_versions/v=r<id>/...   rows, in partition folders if any
    <scope>/_published/<number>.json         table -> its folders; the highest number counts
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import types as T

VERSIONS, POINTERS = "_versions", "_published"
#: Pointers that are kept, the present one included: who has read the one before may still finish.
KEPT = 2

#: Of all Parquet files that are written, short-lived ones included: about a quarter smaller than Spark's default.
COMPRESSION = "zstd"

#: Folders of every table, relative to the scope.
Leaves = dict[str, list[str]]


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    files, where = files_of(spark, path)
    files.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    files, where = files_of(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def size_of(spark: SparkSession, folders: Iterable[str]) -> tuple[int, int]:
    """Files in some folders and their bytes."""
    found = []
    for folder in folders:
        files, where = files_of(spark, folder)
        found.append(files.getContentSummary(where))
    return sum(s.getFileCount() for s in found), sum(s.getLength() for s in found)


def _numbers(spark: SparkSession, scope: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in children(spark, f"{scope}/{POINTERS}") if n[0].isdigit())


def _pointer(spark: SparkSession, scope: str, number: int) -> Leaves:
    files, where = files_of(spark, f"{scope}/{POINTERS}/{number:08}.json")
    stream = files.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def published(spark: SparkSession, scope: str) -> Leaves:
    """What is published in a scope at present."""
    numbers = _numbers(spark, scope)
    return _pointer(spark, scope, numbers[-1]) if numbers else {}


def _write_pointer(spark: SparkSession, scope: str, number: int, leaves: Leaves) -> bool:
    """Put the pointer in its place whole; False if another one was faster."""
    aside = f"{scope}/{POINTERS}/.{uuid.uuid4().hex}"
    files, where = files_of(spark, aside)
    stream = files.create(where, False)
    stream.write(json.dumps(leaves, sort_keys=True).encode())
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(where, jvm.org.apache.hadoop.fs.Path(f"{scope}/{POINTERS}/{number:08}.json"), never_replace)
        return True
    except Py4JJavaError as failed:
        files.delete(where, False)
        if "FileAlreadyExists" in failed.java_exception.getClass().getName():
            return False
        raise


def publish(spark: SparkSession, scope: str, change: Callable[[Leaves], Leaves]) -> Leaves:
    """Make ``change(what is published)`` the published state.

    Where two publish at once, the slower one applies its change to the other's outcome.
    Folders that only pointers older than the kept ones name are removed.
    """
    while True:
        numbers = _numbers(spark, scope)
        before = _pointer(spark, scope, numbers[-1]) if numbers else {}
        after = change(before)
        number = numbers[-1] + 1 if numbers else 1
        if _write_pointer(spark, scope, number, after):
            _retire(spark, scope, [*numbers, number])
            return after


def _retire(spark: SparkSession, scope: str, numbers: Sequence[int]) -> None:
    old = numbers[:-KEPT]
    if not old:
        return
    kept = {leaf for n in numbers[-KEPT:] for leaves in _pointer(spark, scope, n).values() for leaf in leaves}
    gone = {leaf for n in old for leaves in _pointer(spark, scope, n).values() for leaf in leaves} - kept
    in_use = {_version(leaf) for leaf in kept}
    for folder in {leaf if _version(leaf) in in_use else _version(leaf) for leaf in gone}:
        remove(spark, f"{scope}/{folder}")
    for n in old:
        remove(spark, f"{scope}/{POINTERS}/{n:08}.json")


def _version(leaf: str) -> str:
    """The version folder that a folder of rows lies in."""
    before, _, after = leaf.partition(f"{VERSIONS}/")
    return f"{before}{VERSIONS}/{after.split('/')[0]}"


class Publication:
    """Writes new rows aside and collects what is to be published."""

    def __init__(self, spark: SparkSession, scope: str):
        self.spark, self.scope = spark, scope.rstrip("/")
        self.written: list[str] = []
        self.changes: list[Callable[[Leaves], Leaves]] = []

    def write(self, writer: DataFrameWriter, folder: str, by: Sequence[str] = ()) -> list[str]:
        """Write a new version under a folder of the scope; the folders of its partitions, or its own."""
        version = "/".join([*([folder] if folder else []), VERSIONS, f"v=r{uuid.uuid4().hex}"])
        self.written.append(version)
        (writer.partitionBy(*by) if by else writer).option("compression", COMPRESSION).parquet(f"{self.scope}/{version}")
        leaves = [version]
        for column in by:
            leaves = [
                f"{leaf}/{name}" for leaf in leaves for name in children(self.spark, f"{self.scope}/{leaf}")
                if name.startswith(f"{column}=")
            ]
        return leaves

    def replace(self, table: str, leaves: Iterable[str]) -> None:
        """The table consists of these folders and no others."""
        leaves = list(leaves)
        self.changes.append(lambda now: {**now, table: leaves})

    def add(self, table: str, leaves: Iterable[str]) -> None:
        leaves = list(leaves)
        self.changes.append(lambda now: {**now, table: [*now.get(table, []), *leaves]})

    def replace_partitions(self, table: str, leaves: Iterable[str], partitions: Iterable[str] | None = None) -> None:
        """These folders instead of those with the same (or the named) partitions; all other partitions stay."""
        leaves = list(leaves)
        touched = set(partitions if partitions is not None else (leaf.rsplit("/", 1)[-1] for leaf in leaves))

        def change(now: Leaves) -> Leaves:
            others = [leaf for leaf in now.get(table, []) if leaf.rsplit("/", 1)[-1] not in touched]
            return {**now, table: [*others, *leaves]}

        self.changes.append(change)

    def commit(self) -> None:
        def change(now: Leaves) -> Leaves:
            for each in self.changes:
                now = each(now)
            return now

        publish(self.spark, self.scope, change)

    def discard(self) -> None:
        for version in self.written:
            remove(self.spark, f"{self.scope}/{version}")


@contextmanager
def publication(spark: SparkSession, scope: str) -> Iterator[Publication]:
    """Everything written and announced inside is published together at the end, or removed if it fails."""
    new = Publication(spark, scope)
    try:
        yield new
        new.commit()
    except BaseException:
        new.discard()
        raise


def scan(spark: SparkSession, scope: str, leaves: Sequence[str], layout: str | None = None) -> DataFrame:
    """The rows of folders of one table, in one scan; their partition columns prune as usual.

    All lie under one folder of versions. ``layout`` declares the columns; a table without any folder needs it.
    """
    if not leaves:
        return spark.createDataFrame([], T.StructType.fromDDL(layout))
    scope = scope.rstrip("/")
    base = f"{scope}/{leaves[0].partition(VERSIONS)[0]}{VERSIONS}"
    reader = spark.read.option("basePath", base)
    if layout:
        columns = T.StructType.fromDDL(layout).names
        return reader.schema(layout).parquet(*[f"{scope}/{leaf}" for leaf in leaves]).select(*columns)
    return reader.parquet(*[f"{scope}/{leaf}" for leaf in leaves]).drop("v")
