"""Language identification by compression: the language whose dictionary helps zstandard most."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import release
from oreworks.llm.common import small_batches

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds and constants of the compressors.

    dictionary_bytes: raw content of a language's dictionary. A bounded sample of labelled texts fills it.
    piece_chars: characters taken from a sampled text, at a place drawn from its hash.
    block_bytes: a text is compressed whole, in blocks of this size, so that a dictionary is in reach everywhere.
    level: zstandard's level.
    min_margin: bytes saved per byte of text against the second language, below which the text is rejected.
    certainty: how fast `score` rises with the bytes saved per byte of text.
    """

    dictionary_bytes: int = 131_072
    piece_chars: int = 4_000
    block_bytes: int = 4_096
    level: int = 3
    min_margin: float = 0.001
    certainty: float = 60.0


def canonical(text: str) -> bytes:
    """Letters only, lower-cased, each other run as one space: marks, digits and case say nothing about a language."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip()
    # What is left may be numbers of other kinds alone, such as fractions and Roman numerals.
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


def learn(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionary content by language, from `text, lang`. Rows with a NULL in either teach nothing; copies of a text count once.

    Texts are drawn by hash at a rate set by the characters of the language's distinct texts, so no language is gathered
    whole anywhere. While a dictionary is not full, more of its texts are drawn, then longer pieces of them, until all of
    its distinct texts are used whole. What reaches the driver is bounded by `dictionary_bytes` for each language (a few
    times as many letters are drawn).
    """
    rows = labelled.where("lang IS NOT NULL AND length(text) > 0").select("text", "lang")
    # A text that has many copies would fill a dictionary alone, and lower the rate of all others.
    texts = rows.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.max(F.length("text")).alias("chars"))
    counts = texts.groupBy("lang").agg(
        F.sum(F.least("chars", F.lit(settings.piece_chars))).alias("drawable"), F.max("chars").alias("longest")
    ).collect()
    longest = {r["lang"]: r["longest"] for r in counts}
    missing = {r["lang"]: (min(1.0, 2.0 * settings.dictionary_bytes / r["drawable"]), settings.piece_chars) for r in counts}
    found: dict[str, bytes] = {}
    while missing:
        found |= _draw(rows, missing)
        missing = {
            lang: (min(1.0, 4 * rate), piece if rate < 1 else 4 * piece)
            for lang, (rate, piece) in missing.items()
            if len(found.get(lang, b"")) < settings.dictionary_bytes and (rate < 1 or piece < longest[lang])
        }
    return {lang: content[: settings.dictionary_bytes] for lang, content in sorted(found.items())}


def _draw(rows: DataFrame, wanted: dict[str, tuple[float, int]]) -> dict[str, bytes]:
    """Pieces of distinct texts by language, in order of their hashes, at a rate and of a length for each language."""

    def of(place: int) -> Column:
        pairs = (F.lit(x) for lang, values in wanted.items() for x in (lang, values[place]))
        return F.create_map(*pairs)[F.col("lang")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch.assign(piece=batch["piece"].map(canonical))
            yield made[made["piece"].map(len) > 0]

    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    start = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - of(1), F.lit(1)))
    piece = F.substring("text", start.cast("int"), of(1).cast("int"))
    sample = rows.where(drawn < of(0)).select("lang", drawn.alias("at"), piece.alias("piece")).distinct()
    pieces: dict[str, list[tuple[float, bytes]]] = {}
    for row in sample.mapInPandas(run, "lang string, at double, piece binary").collect():
        pieces.setdefault(row["lang"], []).append((row["at"], bytes(row["piece"])))
    return {lang: b" ".join(piece for _, piece in sorted(drawn)) for lang, drawn in pieces.items()}


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.block = settings.block_bytes
        self.by_lang = {}
        for lang, content in dictionaries.items():
            parameters = zstandard.ZstdCompressionParameters.from_level(
                settings.level, window_log=max(18, len(content).bit_length()), write_content_size=0, write_checksum=0
            )
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=parameters)
            self.by_lang[lang] = zstandard.ZstdCompressor(compression_params=parameters, dict_data=known)

    def sizes(self, data: bytes) -> list[tuple[int, str]]:
        """Compressed bytes and language, smallest first; ties go to the language that sorts first."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by_lang.items())


def judge(text: str | None, compressors: Compressors, settings: Settings) -> tuple[str, float, float, bool]:
    """Language, score, margin, rejected."""
    data = canonical(text or "")
    if not data or not compressors.by_lang:
        return UNKNOWN, 0.0, 0.0, True
    sizes = compressors.sizes(data)
    best = sizes[0][0]
    margin = (sizes[1][0] - best) / len(data) if len(sizes) > 1 else 1.0
    score = 1.0 / sum(math.exp(-settings.certainty * (size - best) / len(data)) for size, _ in sizes)
    return sizes[0][1], score, margin, margin < settings.min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """All columns of `docs` plus `lang_pred, lang_score, lang_margin, lang_rejected`, read from `text`.

    A NULL text and one without a letter are `und` with score 0 and rejected, as is every text when no language was
    learned. A text is rejected if its margin is narrow; its `lang_pred` still is the best language. Equal texts get
    equal results. Columns of those four names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = ", ".join(
        [f"`{name}` {kind}" for name, kind in docs.select(*(f"`{c}`" for c in kept)).dtypes]
        + ["lang_pred string", "lang_score double", "lang_margin double", "lang_rejected boolean"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(dictionaries, settings)
        for batch in batches:
            found = [judge(text, compressors, settings) for text in batch["text"]]
            yield batch.assign(**{name: [row[i] for row in found] for i, name in enumerate(added)})
        del compressors
        release()

    return docs.select(*(f"`{c}`" for c in kept)).mapInPandas(run, schema)
