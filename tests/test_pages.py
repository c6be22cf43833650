"""One large document read by many tasks: the rows of the plain reader, or a clear stop."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import types as T

from oreworks.config import SourceSpec
from oreworks.sources import pages, readers

RECORD = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("quantity", T.LongType()),
    T.StructField("unit_price", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType())),
])
SPEC = SourceSpec("pages", "split_records_json", "*.json", ("order_id",), schema=pages.document_of(RECORD))


def record(i):
    return {"order_id": f"N-{i}", "quantity": i if i % 7 else None, "unit_price": i / 4, "tags": ["a]", "data\": [", "ção"][: i % 4]}


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    yield
    spark.conf.set(key, before)


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / "*.json")


def rows(df):
    return sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("around", [("", ""), ('"page": 1, "of": [1, 2], ', ', "next": null, "sizes": [3]')])
def test_same_rows_as_the_plain_reader(spark, small_splits, tmp_path, indent, around):
    body = json.dumps([record(i) for i in range(600)], indent=indent, ensure_ascii=False)
    path = write(tmp_path / "in", "a.json", "{" + around[0] + '"data": ' + body + around[1] + "}\n")
    write(tmp_path / "in", "b.json", json.dumps({"data": [record(1000)]}))
    write(tmp_path / "in", "none.json", '{"data": [ ]}')
    write(tmp_path / "in", "empty.json", "")
    write(tmp_path / "in", "marked.json", chr(0xFEFF) + json.dumps({"data": [record(1001)]}))
    read = pages.read_split_records_json(spark, path, SPEC)
    assert read.rdd.getNumPartitions() > 5
    assert rows(read) == rows(readers.read_records_json(spark, path, SPEC))
    assert read.count() == 602 and read.columns == [*RECORD.names, "_source_file"]


WHOLE = json.dumps({"data": [record(i) for i in range(40)]})
BAD = {
    "cut in a record": WHOLE[: len(WHOLE) // 2],
    "cut behind a record": WHOLE[: WHOLE.rindex("}]") + 1],
    "cut behind a value": WHOLE[: WHOLE.rindex(', "tags"')],
    "no comma": WHOLE.replace("}, {", "} {", 1),
    "two documents": WHOLE + "\n" + WHOLE,
    "nested": '{"data": [{"order_id": "1", "x": {"y": 1}}, {"order_id": "2"}]}',
    "brace in text": '{"data": [{"order_id": "a}b"}, {"order_id": "a{b"}]}',
    "objects behind": '{"data": [{"order_id": "1"}], "more": [{"order_id": "2"}, {"order_id": "3"}]}',
    "objects before": '{"more": [{"order_id": "2"}], "data": [{"order_id": "1"}]}',
    "other list": '{"rows": [{"order_id": "1"}]}',
    "not a document": "order_id;quantity\n1;2\n",
    "closed at once": '{"data": []}, {"order_id": "1"}]}',
}


@pytest.mark.parametrize("case", BAD)
def test_anything_else_stops_the_read(spark, small_splits, tmp_path, case):
    path = write(tmp_path / "in", "good.json", WHOLE)
    write(tmp_path / "in", "bad.json", BAD[case])
    with pytest.raises(pages.UnsplittableDocument):
        pages.read_split_records_json(spark, path, SPEC).collect()


def test_a_record_that_does_not_parse_stops_the_read(spark, tmp_path):
    path = write(tmp_path / "in", "a.json", '{"data": [{"order_id": "1", "quantity": "many"}]}')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        pages.read_split_records_json(spark, path, SPEC).collect()


def test_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        pages.read_split_records_json(spark, str(tmp_path), replace(SPEC, schema=None))
