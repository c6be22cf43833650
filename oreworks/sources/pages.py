"""Large JSON documents of records, read by many tasks.

A document in one piece is parsed by one task, however large it is.  Where its records are flat, every record ends at
the next closing brace, so the file can be scanned as text with that brace as the separator of lines: Spark splits such
a file like any text, and each task parses the records of its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks.config import SourceSpec

_PIECE, _KIND, _RECORD = "_piece", "_kind", "_record"
HEAD, RECORD, TAIL, BLANK, HOLLOW, OTHER = "head", "record", "tail", "blank", "hollow", "other"


class UnsplittableDocument(ValueError):
    """A file isn't one whole document of flat records; ``read_records_json`` reads any valid one."""


def read_split_records_json(spark: SparkSession, path: str, spec: SourceSpec, records: str = "data") -> DataFrame:
    """``read_records_json`` for documents that may be large: same rows, several tasks per file.

    ``spec.schema`` declares the document, as for the other readers; only the field ``records`` is read.  Records are
    objects without further objects in them and without braces in their text, and so is what surrounds them.  A first
    pass, which parses nothing, proves that every file opens and closes its list once and that everything between is
    a record; files where that doesn't hold stop the read, cut ones included.  A record that does not parse stops it too.
    An empty file has no rows.  Files compressed by bzip2 are read in parts too, others by one task, as any of Spark's text.
    """
    if spec.schema is None:
        raise ValueError(f"a document that is read in parts needs SourceSpec.schema: {spec.name}")
    layout = spec.schema[records].dataType.elementType
    pieces = _pieces(spark, path, records)
    _prove_whole(pieces)
    parsed = F.from_json(_RECORD, layout, {"mode": "FAILFAST", **spec.options})
    kept = pieces.filter(F.col(_KIND).isin(HEAD, RECORD)).select(parsed.alias("record"), "_source_file")
    return kept.select("record.*", "_source_file")


def document_of(record: T.StructType, records: str = "data") -> T.StructType:
    """The layout of a document whose records have this layout."""
    return T.StructType([T.StructField(records, T.ArrayType(record))])


def _pieces(spark: SparkSession, path: str, records: str) -> DataFrame:
    """Text between closing braces, what part of a document it is, and the record it ends with."""
    opening = rf'^\s*\x{{FEFF}}?\s*\{{[^{{]*"\Q{records}\E"\s*:\s*\['
    piece = F.col(_PIECE)
    kind = (
        F.when(piece.rlike(r"^\s*$"), BLANK)
        .when(piece.rlike(r"^\s*,\s*\{[^{]*$"), RECORD)
        .when(piece.rlike(rf"{opening}\s*\{{[^{{]*$"), HEAD)
        .when(piece.rlike(r"^\s*\][^{]*$"), TAIL)
        .when(piece.rlike(rf"{opening}\s*\][^{{]*$"), HOLLOW)
        .otherwise(OTHER)
    )
    # The last brace opens the record; its closing one was the separator.
    record = F.concat(F.lit("{"), F.substring_index(piece, "{", -1), F.lit("}"))
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("value").alias(_PIECE), F.col("_metadata.file_path").alias("_source_file")).select(
        kind.alias(_KIND), record.alias(_RECORD), "_source_file"
    )


def _prove_whole(pieces: DataFrame) -> None:
    def pieces_of(*kinds: str):
        return F.count_if(F.col(_KIND).isin(*kinds))

    whole = (pieces_of(HEAD, HOLLOW) == 1) & (pieces_of(TAIL, HOLLOW) == 1) & (pieces_of(OTHER) == 0)
    # A piece without a record between: nothing but the end of the file is blank.
    whole &= pieces_of(BLANK) <= 1
    # A list that was closed at once has no records behind it.
    whole &= (pieces_of(HOLLOW) == 0) | (pieces_of(RECORD) == 0)
    blank = pieces_of(BLANK) == F.count("*")
    bad = pieces.groupBy("_source_file").agg((whole | blank).alias("whole")).filter(~F.col("whole"))
    found = [r["_source_file"] for r in bad.select("_source_file").limit(3).collect()]
    if found:
        raise UnsplittableDocument(f"not whole documents of flat records: {found}")
