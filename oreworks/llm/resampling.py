"""Importance resampling towards a target: documents whose hashed word n-grams look like the target's are drawn more often.

A batch's texts are joined with a separator; one regular expression pass finds all words and separators of the batch at
once. Everything after that is numpy over the batch: hashes of words, hashes of n-grams made from them (CRC-32 of two
strings together follows from both), the document of each word by binary search among the separators, which also masks
n-grams that would reach into the next document, and bucket counts by `bincount`.

Bucket counts of the corpus and of the target are added up over tasks in a tree; the gains of the buckets are an array of
fixed size. Scores add Gumbel noise that depends on the seed and the id, so the highest scores are a sample without
replacement with chances in proportion to the documents' weights. Ranks come from a range-partitioned sort.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import pack, total
from oreworks.llm.common import small_batches, stored

_SEPARATOR = b"\x00"
_SEPARATOR_CRC = zlib.crc32(_SEPARATOR)  # no other byte has it
# A-Z in lower case; a NUL of a text is no word, and must not look like the separator.
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _SEPARATOR, bytes(range(97, 123)) + b" ")
# Every byte of a character beyond ASCII is beyond 7F.
_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")


@dataclass(frozen=True)
class Settings:
    """buckets: hashed features. words: longest n-gram. least_words: shorter documents are not drawn.

    percent: share of the documents that is drawn. seed: of the noise.
    """

    buckets: int = 10_000
    words: int = 2
    least_words: int = 20
    percent: int = 25
    seed: int = 7


@lru_cache(maxsize=256)
def _shift(size: int) -> np.ndarray:
    """Four tables of 256: what a byte of a CRC becomes when `size` bytes follow. CRC-32 is linear in it."""
    # crc(a + b) = shift(crc(a), len(b)) ^ crc(b), so a basis vector's shift follows from any a with that CRC's difference.
    zeros = bytes(size)
    basis = [zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros, 0) for bit in range(32)]
    tables = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            tables[place, 1 << bit : 2 << bit] = tables[place, : 1 << bit] ^ np.uint32(basis[8 * place + bit])
    return tables


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of strings from the CRC-32 of both and the size of the second."""
    out = second.copy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        crc, tables = first[at], _shift(int(size))
        out[at] ^= tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]
    return out


_TABLE = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\x00") for k in range(256)], np.uint32)
#: Longer words are hashed one by one.
_VECTOR_SIZE = 48


def word_crcs(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of every word; words of one size go through the bytes together."""
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    out = np.zeros(len(words), np.uint32)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size > _VECTOR_SIZE:
            out[at] = [zlib.crc32(words[k]) for k in at]
            continue
        crc, here = np.full(len(at), 0xFFFFFFFF, np.uint32), starts[at]
        for k in range(int(size)):
            crc = _TABLE[(crc ^ data[here + k]) & 255] ^ crc >> 8
        out[at] = ~crc
    return out


class Features:
    """Buckets of the n-grams of batches of texts."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and document of every n-gram, and the number of words of every document."""
        joined = b"".join((text or "").encode("utf-8", "replace").translate(_LOWER) + _SEPARATOR for text in texts)
        tokens = _TOKENS.findall(joined)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        crcs = word_crcs(tokens, sizes)
        separator = (sizes == 1) & (crcs == _SEPARATOR_CRC)
        ends, places = np.flatnonzero(separator), np.flatnonzero(~separator)
        owner, crcs, sizes = np.searchsorted(ends, places), crcs[places], sizes[places]
        blank = np.full(1, zlib.crc32(b" "), np.uint32)
        buckets, owners, run = [], [], crcs
        for width in range(1, self.settings.words + 1):
            if width > 1:  # run: n-grams one shorter that start at each word; the word that follows is added
                run = joined_crc(run[:-1], np.repeat(blank, max(0, len(run) - 1)), np.ones(max(0, len(run) - 1), np.int64))
                run = joined_crc(run, crcs[width - 1 :], sizes[width - 1 :])
            inside = owner[: len(run)] == owner[width - 1 :]
            buckets.append(run[inside] % self.settings.buckets)
            owners.append(owner[: len(run)][inside])
        n_words = np.bincount(owner, minlength=len(texts))
        return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), n_words


def bucket_counts(docs: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """How many n-grams of all texts of `docs` fall in each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, found = Features(settings), np.zeros(settings.buckets, np.int64)
        for batch in batches:
            found += np.bincount(features.of(batch["text"].tolist())[0], minlength=settings.buckets)
        yield pd.DataFrame({"counts": [pack(found)]})

    small_batches(docs.sparkSession)
    return total(docs.select("text").mapInPandas(count, "counts binary"), settings.buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of nats that a feature of each bucket speaks for the target, smoothed by one for each bucket; floored."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
         for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths, floored."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def score(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """`doc_id, n_features, n_words, weight, score` of every row of `docs` (`doc_id, text`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(settings)
        for batch in batches:
            bucket, owner, n_words = features.of(batch["text"].tolist())
            n = np.bincount(owner, minlength=len(batch))
            # Sums of whole numbers, exact in doubles far beyond any text.
            weight = np.bincount(owner, gain[bucket], len(batch)).astype(np.int64) // np.maximum(n, 1)
            ids = [None if missing else int(k) for k, missing in zip(batch["doc_id"], batch["no_id"])]
            drawn = weight + np.array([noise(k, settings.seed) for k in ids], np.int64)
            yield pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "n_features": n, "n_words": n_words, "weight": weight, "score": drawn,
            })

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text"
    )
    return rows.mapInPandas(run, _SCORED)


def ranked(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`scored` with `rank` 1, 2, 3 ... by falling score for the share that is drawn, else NULL. Ties: smaller id, NULL last.

    Long enough documents are sorted over range partitions; a row's rank is its place in its partition after the rows of
    the partitions before it. Only one count for each partition is added up.
    """
    scored = stored(scored)
    # An identifier that rises along the sorted rows: 33 bits of place below the number of the partition.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    place = F.monotonically_increasing_id()
    long = stored(scored.where(F.col("n_words") >= settings.least_words).orderBy(*order).withColumn("place", place))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in long.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, rows = [], 0
    for number, n in sizes:
        starts.append((number, rows))
        rows += n
    before = scored.sparkSession.createDataFrame(starts, "part long, before long")
    placed = long.withColumn("part", part).join(F.broadcast(before), "part")
    rank = F.col("before") + within + 1
    drawn = placed.withColumn("rank", F.when(rank <= settings.percent * rows // 100, rank)).select(*scored.columns, "rank")
    short = scored.where(F.col("n_words") < settings.least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(short)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`doc_id, n_features, n_words, weight, score, rank` of every row of `docs` (`doc_id, text`), towards `target` (`text`).

    A NULL or empty text has no features and weighs 0, as has one without words. Without a target all its counts are 0.
    Rows with one id and one text get equal scores and ranks of their own; a NULL id has the noise of an empty name. No
    rows for an empty table. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    return ranked(score(docs, gain, settings), settings)
