"""What the operators share: tables, the learning split, stored intermediates, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of a small table that may be broadcast or sent to the driver; beyond it, operators join by a shuffle.
SMALL_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model learns from. A NULL id is held out too: it has no place in the split."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`. Where that is unset, only a local master may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="oreworks-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the shared folder and read back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on 8 MB of texts at most, or one row, go to a Python worker at once, unless the session has its own bound.

    Spark's default of 64 MB costs a worker several times as much, next to what an operator holds.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "8m")


def columns_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, NULL where the table lacks one. Other columns can't clash with the operator's own."""
    present = {name.lower() for name in df.columns}
    return df.select(*(F.col(f"`{n}`") if n.lower() in present else F.lit(None).cast("string").alias(n) for n in names))


def connected_components(links: DataFrame) -> DataFrame:
    """`node, component` for every node of the undirected `links(a, b)`; the component is its smallest node.

    Alternating large-star and small-star steps: each keeps the components and moves links towards the smallest node, in
    a number of rounds that is logarithmic in the size of a component. A step is one aggregation (partial per task, so a
    hub is pre-aggregated) and one join, which the adaptive skew join splits at a hub. Every round is stored.
    """
    links = stored(_ordered(links))
    before, now = None, _print(links)
    while before != now:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stored(_ordered(small.unionByName(smallest.select("a", F.col("low").alias("b")))))
        before, now = now, _print(links)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _print(links: DataFrame) -> tuple:
    """Number of links and a hash that doesn't depend on their order."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
