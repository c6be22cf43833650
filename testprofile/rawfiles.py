"""The given tables written out as raw source files, and a whole run over them."""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks import contract as C
from oreworks.config import Limits, Settings, SourceSpec, default_sources
from oreworks.plans.bronze import run_bronze
from oreworks.plans.increments import run_gold_increment, run_silver_increment
from oreworks.plans.run import run
from oreworks.sinks.published import children, files_of
from oreworks.sinks.tables import scratch_path, stage
from oreworks.streaming.arrivals import append_new_files
from testprofile import tables as P

PAGE_ROWS = 10_000
# Reading lower-cases these two fields.
DOMAINS = replace(
    P.DOMAINS,
    statuses=tuple(s.lower() for s in P.DOMAINS.statuses),
    cancelled=P.DOMAINS.cancelled.lower(),
    payments=tuple(p.lower() for p in P.DOMAINS.payments),
)
# A total order of the fields a source sends, so that results can be compared.
KEEP_FIRST_BY = (
    "_source_priority", "order_ts", "product_id", "total_amount", "quantity", "status", "customer_id",
)
LIMITS = Limits(quarantine_rate_max=0.9, silver_rows_min=100)


def sales_text(spark: SparkSession, sf: str, part: int | None = None) -> DataFrame:
    """The eleven sales fields as a source would send them; ``part`` is one of three sources."""
    df = P.sales(spark, sf)
    if part is not None:
        df = df.filter(F.col("_source") == f"source_{part}")
    return df.select(
        *[F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss").alias(f) if f == "order_date" else F.col(f)
          for f in C.SALES_FIELDS]
    )


#: Text repeats its field names or values in every row, so it is sent compressed; readers know it by its ending.
COMPRESSION = "gzip"


#: Compressed text as Spark names it; documents are written as lines of text.
PATTERNS = {C.SALES_CSV: "*.csv.gz", C.SALES_JSON: "*.txt.gz"}
#: The default sources with both kinds of sales text compressed.
SOURCES = tuple(replace(s, pattern=PATTERNS.get(s.name, s.pattern)) for s in default_sources())


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    renamed = df.withColumnsRenamed({new: old for old, new in C.CSV_RENAMES.items()})
    raw = renamed.write.mode(mode).option("header", "true").option("sep", ";").option("encoding", "ISO-8859-1")
    raw.option("compression", COMPRESSION).csv(path)


def write_pages(df: DataFrame, path: str, rows: int = PAGE_ROWS) -> None:
    """Documents of at most ``rows`` records each, one document per file and one record a line.

    Every task writes the records of its partition as they come and begins a new file with each document; no document
    is gathered in memory.
    """
    numbered = stage(df, "page-rows").withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)  # the upper bits number the partition, the others its rows
    lasts = numbered.groupBy(part.alias("_part")).agg(F.max("_id").alias("_last"))
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) % rows
    opening = F.when(row == 0, '{"data": [').otherwise("")
    closing = F.when((row == rows - 1) | (F.col("_id") == F.col("_last")), "]}").otherwise(",")
    lines = numbered.join(F.broadcast(lasts), part == F.col("_part")).select(
        F.concat(opening, F.to_json(F.struct(*df.columns)), closing).alias("value")
    )
    lines.write.option("maxRecordsPerFile", rows).option("compression", COMPRESSION).text(path)


#: A line break, what comes before all records and between two, and what ends a document, each compressed by itself.
BREAK, OPENING, COMMA, CLOSING = (bz2.compress(x) for x in (b"\n", b'{"data": [', b",", b"]}"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some records of a document, compressed in small blocks, at which readers can split."""
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            yield pa.record_batch({"part": [bz2.compress("\n,".join(lines).encode(), 1)]})


def write_one_document(df: DataFrame, path: str) -> None:
    """All records in one document, one record a line; written by one task, as such a file is.

    That task only copies: the rows are made, compressed and stored by many tasks, so that it holds none of their joins.
    The file is compressed by bzip2, which many tasks can read: compressed parts behind one another are the compressed whole.
    """
    spark = df.sparkSession
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    parts = stage(df.select(record.alias("record")).mapInArrow(_compressed, "part binary"), "document-rows").coalesce(1)
    before = F.when(F.monotonically_increasing_id() == 0, F.lit(OPENING)).otherwise(F.lit(COMMA))
    listed = parts.select(F.concat(before, "part").alias("value"))
    if listed.isEmpty():
        listed = spark.createDataFrame([(OPENING,)], "value binary")
    whole = listed.unionByName(spark.createDataFrame([(CLOSING,)], "value binary")).coalesce(1)
    # Bytes pass as text; what Spark puts behind every row is a line break, compressed.
    raw = whole.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1")
    raw.option("lineSep", BREAK.decode("ISO-8859-1")).text(path)
    # Readers know compressed text by its ending.
    files, folder = files_of(spark, path)
    (written,) = [n for n in children(spark, path) if n.startswith("part-")]
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not files.rename(at(folder, written), at(folder, "document.json.bz2")):
        raise OSError(f"{path}/{written} can't be named")


def write_documents(df: DataFrame, path: str) -> None:
    df.write.option("maxRecordsPerFile", 1).json(path)


def write_raw(spark: SparkSession, sf: str, root: str) -> None:
    write_delimited(sales_text(spark, sf, 0), f"{root}/raw/{C.SALES_CSV}")
    write_pages(sales_text(spark, sf, 1), f"{root}/raw/{C.SALES_JSON}")
    sales_text(spark, sf, 2).write.parquet(f"{root}/raw/{C.SALES_PARQUET}")
    P.raw_customers(spark, sf).filter("c_acctbal >= 0").drop("c_acctbal").write.parquet(f"{root}/raw/{C.CUSTOMERS}")
    write_documents(P.nested_categories(spark, sf), f"{root}/raw/{C.CATEGORIES}")


#: Order in which the thirds of the sales arrive; rows of one order fall in several, and not the first one first.
DELIVERIES = (1, 2, 0)
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in C.CSV_RENAMES])
_DELIVERED: dict[tuple[str, str], Settings] = {}


def delivered(spark: SparkSession, sf: str) -> Settings:
    """Settings of a lake that got its sales in three deliveries, each put into Silver as it came."""
    done = (spark.sparkContext.applicationId, sf)
    if done not in _DELIVERED:
        root = scratch_path(spark, "deliveries")
        P.raw_customers(spark, sf).filter("c_acctbal >= 0").drop("c_acctbal").write.parquet(f"{root}/raw/{C.CUSTOMERS}")
        write_documents(P.nested_categories(spark, sf), f"{root}/raw/{C.CATEGORIES}")
        csv, _, _, *dimensions = SOURCES
        csv = replace(csv, schema=TEXT)
        settings = Settings(
            root, run_id="deliveries", domains=DOMAINS, limits=LIMITS, keep_first_by=KEEP_FIRST_BY, sources=tuple(dimensions)
        )
        run_bronze(spark, settings)
        settings = replace(settings, sources=(csv, *dimensions))
        number = F.regexp_extract("product_id", C.PRODUCT_NUMBER_PATTERN, 1).cast("bigint")
        # Joined once; each delivery takes its own from the stored rows.
        rows = stage(sales_text(spark, sf).withColumn("_part", number % 3), "deliveries")
        for part in DELIVERIES:
            write_delimited(rows.filter(F.col("_part") == part).drop("_part"), f"{root}/raw/{C.SALES_CSV}", "append")
            append_new_files(spark, csv, settings)
            run_silver_increment(spark, settings)
            if part != DELIVERIES[1]:  # Gold meets the last two deliveries at once
                run_gold_increment(spark, settings)
        _DELIVERED[done] = settings
    return _DELIVERED[done]


_DONE: dict[tuple[str, str], Settings] = {}


def finished(spark: SparkSession, sf: str) -> Settings:
    """Settings of a completed run over the tables of ``sf``; done once per application."""
    done = (spark.sparkContext.applicationId, sf)
    if done not in _DONE:
        root = scratch_path(spark, "lake")
        write_raw(spark, sf, root)
        settings = Settings(
            root, run_id="profile", data_ref="2000-12-31", domains=DOMAINS, limits=LIMITS, keep_first_by=KEEP_FIRST_BY,
            sources=SOURCES,
        )
        run(spark, settings)
        _DONE[done] = settings
    return _DONE[done]
