"""One compressed document, written from parts that many tasks made and read in parts by many tasks."""

import bz2
import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks.sources import pages, readers
from testprofile import rawfiles as R

LAYOUT = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("shipping_city", T.StringType())])
SPEC = replace(R.SOURCES[1], schema=pages.document_of(LAYOUT))


def city(i):
    return None if i % 5 == 0 else f"São {i * 7919 % 100_003}\n]" * (1 + i % 3)


@pytest.mark.parametrize("split", ["700", "5k", "128m"])
def test_a_compressed_document_is_read_in_parts_without_losing_a_record(spark, tmp_path, split):
    rows = spark.createDataFrame([(i, city(i)) for i in range(9000)], LAYOUT).repartition(7).filter("order_id % 1000 > 2 OR order_id < 3")
    path = str(tmp_path / "document")
    R.write_one_document(rows, path)
    (file,) = Path(path).glob("[!._]*")
    text = bz2.decompress(file.read_bytes()).decode()
    assert len(json.loads(text)["data"]) == rows.count() == text.count("\n") - 1
    assert file.stat().st_size < len(text) / 4
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = readers.READERS["split_records_json"](spark, path, SPEC)
        assert (read.rdd.getNumPartitions() > 4) == (split != "128m")
        assert sorted(map(tuple, read.drop("_source_file").collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_document_of_no_rows_is_whole(spark, tmp_path):
    path = str(tmp_path / "document")
    R.write_one_document(spark.createDataFrame([], LAYOUT), path)
    assert readers.READERS["split_records_json"](spark, path, SPEC).count() == 0


def test_what_is_stored_for_the_document_is_compressed(spark, tmp_path, monkeypatch):
    """The text is much larger than what is written for it, on the way as in the file."""
    staged = []
    monkeypatch.setattr(R, "stage", lambda df, name, stage=R.stage: staged.append(stage(df, name)) or staged[-1])
    R.write_one_document(spark.range(30_000).select("id", F.lit("the same text again and again").alias("text")), str(tmp_path / "d"))
    (parts,) = staged
    assert parts.schema["part"].dataType == T.BinaryType() and parts.agg(F.sum(F.length("part"))).first()[0] < 30_000 * 20
