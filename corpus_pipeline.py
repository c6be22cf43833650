"""From documents to packed sequences: five stages, each a table that the next one reads.

A stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars); the last returns sequences.
Rows may repeat an id from the mixing stage on. Every stage handles NULL ids, NULL and empty texts as its operator's
docstring says, and gives no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreworks.llm import language, secrets
from oreworks.llm.common import DOCUMENT_COLUMNS, columns_of, held_out, stored, table
from oreworks.llm.mixing import mix
from oreworks.llm.near_duplicates import near_duplicates, row_key
from oreworks.llm.packing import pack_sequences


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: without letters, or with a narrow margin between two languages.

    `lang` becomes the predicted language. Dictionaries are learned from the rows of the learning split.
    """
    docs = columns_of(docs, DOCUMENT_COLUMNS)
    dictionaries = language.learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = language.identify(docs, dictionaries).where(~F.col("lang_rejected"))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates; a row that repeats counts once.

    Documents without a word have no group and all stay. In a group without ids, the smallest row key stays.
    """
    docs = columns_of(docs, DOCUMENT_COLUMNS)
    found = stored(near_duplicates(docs.select("doc_id", "text")))
    grouped = found.where("component IS NOT NULL")
    # min of a struct: smallest id, NULLs last, then the smallest key.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    winners = grouped.groupBy("component").agg(first.alias("first")).select("first.row_key")
    losers = grouped.join(winners, "row_key", "left_anti").select("row_key").distinct()
    keyed = docs.withColumn("row_key", row_key())
    kept = keyed.join(losers, "row_key", "left_anti")
    # Rows with the same id and text: one of them stays. There are few, so only their texts meet.
    twice = grouped.groupBy("row_key").count().where("count > 1").select("row_key")
    if twice.isEmpty():
        return kept.drop("row_key")
    once = kept.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.join(twice, "row_key", "left_anti").unionByName(once).drop("row_key")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text becomes a mark, and `n_chars` the new length."""
    docs = columns_of(docs, DOCUMENT_COLUMNS)
    cleaned = secrets.redact(docs, secrets.learn(docs))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def balanced_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that every source has the same expected share of the characters."""
    return mix(columns_of(docs, DOCUMENT_COLUMNS)).drop("copy")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 1024 tokens."""
    return pack_sequences(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", balanced_sources),
    ("packing", sequences),
]

#: SQL can express neither zstandard's compression nor BPE tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
