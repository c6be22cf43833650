"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing: each word has a sparse random index vector, and its context vector is the sum of the index vectors of the
words near it in all texts. A word with at least one in `share` of all words has vectors and counts of its own; there are at
most `share` such words, whatever the size of the input. Rarer ones share `rest` vectors among themselves, by hash.
A document is the pooled vectors of its words; a two-layer network reads them, and a temperature fitted on labels that it
has not seen calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import pack, unpack
from oreworks.llm.common import small_batches, stored

#: A word, or a run of one mark; case is part of a word. None spans a blank.
TOKEN = re.compile(r"[^\W_]+|([^\w\s]|_)\1*")


@dataclass(frozen=True)
class Settings:
    """share, rest: which words have a vector of their own, and how many vectors the others share.

    width: of a vector. signs: places of an index vector that are not 0. reach: words on either side.
    examples: labelled documents that the network is fitted to, drawn by hash (the bound of the sample).
    hidden, rounds, rate, decay: of the network and its training (Adam, in batches of 256).
    """

    share: int = 1 << 17
    rest: int = 1 << 15
    width: int = 32
    signs: int = 4
    reach: int = 2
    examples: int = 20_000
    hidden: int = 32
    rounds: int = 30
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 11


def number_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def words_in(piece: str) -> list[str]:
    """The words of a piece of text between blanks; most pieces are one."""
    return [piece] if piece.isalnum() else [match[0] for match in TOKEN.finditer(piece)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flushed(held: Counter) -> pd.DataFrame:
        words = Counter()
        for piece, n in held.items():
            for word in words_in(piece):
                words[word] += n
        numbers = np.fromiter(map(number_of, words), np.uint64, len(words)).view(np.int64)
        return pd.DataFrame({"word": numbers, "n": np.fromiter(words.values(), np.int64, len(words))})

    held, size = Counter(), 0
    for batch in batches:
        for text in batch["text"]:
            held.update((text or "").split())
            size += len(text or "")
            if len(held) >= 400_000 or size >= 1 << 26:
                yield flushed(held)
                held, size = Counter(), 0
    yield flushed(held)


def vocabulary(docs: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Hashes of the words that have a vector of their own, in order: those with one in `share` of the words of all texts.

    The driver gets at most `share` numbers.
    """
    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInPandas(_counts, "word long, n long")
    counts = stored(parts.groupBy("word").agg(F.sum("n").alias("n")))
    words = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= -(-words // settings.share)).select("word").toArrow()
    return np.sort(often["word"].to_numpy().view(np.uint64))


class Places(dict):
    """Rows of the table of vectors by piece of text between blanks: each word's own row, or one after those.

    Short pieces are remembered up to a limit; then it starts anew.
    """

    def __init__(self, often: np.ndarray, rest: int):
        super().__init__()
        self.own = {word: place for place, word in enumerate(often.tolist())}
        self.rest = rest

    def place(self, word: str) -> int:
        number = number_of(word)
        found = self.own.get(number)
        return len(self.own) + number % self.rest if found is None else found

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(map(self.place, words_in(piece)))
        if len(piece) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[piece] = found
        return found


def tokens(text: str | None, places: Places) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(places.__getitem__, (text or "").split())), np.int32)


def numbered(docs: DataFrame, often: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """`docs` (any columns and `text`) with `places` in the text's place: the rows of its words in the table of vectors.

    They are packed to a few bits a word, so that a stored copy is much smaller than the texts, which then needn't be
    read and taken apart again.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", "places")]
    fields = [f"`{name}` {kind}" for name, kind in docs.select(*(f"`{c}`" for c in kept)).dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(often, settings.rest)
        for batch in batches:
            yield batch[kept].assign(places=[pack(tokens(text, places)) for text in batch["text"]])

    return docs.select(*(f"`{c}`" for c in kept), "text").mapInPandas(run, ", ".join([*fields, "places binary"]))


def index_vectors(rows: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector, drawn from a fixed seed."""
    draw = np.random.default_rng(settings.seed)
    places = draw.random((rows, settings.width), np.float32).argsort(axis=1)[:, : settings.signs]
    return places, draw.choice([-1, 1], (rows, settings.signs))


def _contexts(rows: int, settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, signs = index_vectors(rows, settings)
        sums, counts = np.zeros(rows * settings.width, np.int64), np.zeros(rows, np.int64)
        held, size = [], 0

        def add() -> None:
            # Texts in a row, kept apart by gaps that are wider than the reach.
            ids = np.concatenate(held).astype(np.int64)
            real = ids >= 0
            counts[:] += np.bincount(ids[real], minlength=rows)
            for shift in range(1, settings.reach + 1):
                both = real[shift:] & real[:-shift]
                left, right = ids[:-shift][both], ids[shift:][both]
                for word, near in ((left, right), (right, left)):
                    for k in range(settings.signs):
                        np.add.at(sums, word * settings.width + at[near, k], signs[near, k])

        gap = np.full(settings.reach, -1, np.int32)
        for batch in batches:
            for packed in batch["places"]:
                held += [unpack(packed, np.int32), gap]
                size += len(held[-2])
                if size >= 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        seen, table = np.flatnonzero(counts), sums.reshape(rows, -1)
        for some in np.array_split(seen, len(seen) // 20_000 + 1):
            columns = {f"s{k}": table[some, k] for k in range(settings.width)}
            yield pd.DataFrame({"place": some, "n": counts[some], **columns})

    return run


def word_vectors(docs: DataFrame, often: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """A vector for each word in `often`, then the shared ones, from all texts of `docs` (`text`)."""
    return context_vectors(numbered(docs.select("text"), often, settings), often, settings)


def context_vectors(docs: DataFrame, often: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """The word vectors of documents whose words are `numbered`.

    Rare words weigh more, and the length of a vector is at most 1. Sums are added up by word in Spark; the driver gets one
    row for each vector, at most `share + rest`.
    """
    names = ["n", *(f"s{k}" for k in range(settings.width))]
    layout = ", ".join(f"{name} long" for name in ["place", *names])
    rows = len(often) + settings.rest
    parts = docs.select("places").mapInPandas(_contexts(rows, settings), layout)
    found = parts.groupBy("place").agg(*(F.sum(name).alias(name) for name in names)).toArrow()
    place = found["place"].to_numpy()
    counts, vectors = np.zeros(rows), np.zeros((rows, settings.width))
    counts[place] = found["n"].to_numpy()
    for k in range(settings.width):
        vectors[place, k] = found[f"s{k}"].to_numpy()
    # The common direction of all contexts tells nothing about a word.
    vectors -= counts[:, None] * (vectors.sum(axis=0) / max(1.0, counts.sum()))[None, :]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    share[len(often) :] = 0  # a shared vector's count is that of many rare words
    weight = 1e-3 / (1e-3 + share)
    return (vectors / np.maximum(length, 1e-12) * weight[:, None]).astype(np.float32)


def features(width: int) -> int:
    return 3 * width + 3


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, the mean of its distinct words, its length and how much it repeats; zeros for no words."""
    if not len(ids):
        return np.zeros(features(vectors.shape[1]), np.float32)
    distinct, counts = np.unique(ids, return_counts=True)
    each, share = vectors[distinct], counts / len(ids)
    mean = share @ each
    spread = np.sqrt(np.maximum(share @ (each * each) - mean * mean, 0))
    unevenness = float((share * share).sum())
    rest = [np.log1p(len(ids)) / 10, len(distinct) / len(ids), unevenness]
    return np.concatenate([mean, spread, each.mean(axis=0), rest]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """`numbered` documents (any columns and `places`) with `vector` (array of floats) in the places' place."""
    kept = [c for c in docs.columns if c.lower() not in ("places", "vector")]
    fields = [f"`{name}` {kind}" for name, kind in docs.select(*(f"`{c}`" for c in kept)).dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[kept].assign(vector=[pooled(unpack(packed, np.int32), vectors) for packed in batch["places"]])

    return docs.select(*(f"`{c}`" for c in kept), "places").mapInPandas(run, ", ".join([*fields, "vector array<float>"]))


@dataclass
class Network:
    """Two layers over standardized features; `temperature` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Network:
    """A network for labels 0 and 1. Labels of one class, or none, give a constant score."""
    width = x.shape[1]
    if len(y) < 2 or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        zeros = np.zeros((width, 1))
        return Network(np.zeros(width), np.ones(width), zeros, np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))))
    draw = np.random.default_rng(settings.seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    parameters = [
        draw.normal(0, np.sqrt(2 / width), (width, settings.hidden)), np.zeros(settings.hidden),
        draw.normal(0, np.sqrt(2 / settings.hidden), settings.hidden), np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(settings.rounds):
        order = draw.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            w1, b1, w2, b2 = parameters
            before = x[rows] @ w1 + b1
            hidden = np.maximum(before, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * w2[None, :] * (before > 0)
            slopes = [x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for k, slope in enumerate(slopes):
                slope = slope + settings.decay * parameters[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                parameters[k] = parameters[k] - settings.rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    w1, b1, w2, b2 = parameters
    return Network(mean, scale, w1, b1, w2, float(b2[0]))


def calibrate(network: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature with the least log loss on labels that the network was not fitted to."""
    if not len(y):
        return
    logits, choices = network.logits(x), np.exp(np.linspace(np.log(0.2), np.log(8), 80))
    losses = [np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean() for t in choices]
    network.temperature = float(choices[int(np.argmin(losses))])


def labelled(labels: DataFrame) -> DataFrame:
    """`doc_id, y`: ids with labels 0 and 1 as often as each other, or none of them, teach nothing."""
    counted = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    return counted.where("y <> 0.5").select("doc_id", F.round("y").cast("int").alias("y"))


def learn(vectors: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """A network from `vectors` (`doc_id, vector`) and `labels` (`doc_id, quality`), both without held-out rows.

    Labelled rows are drawn by hash at a rate set by their count, about `examples` of them at most; a fifth calibrates.
    """
    taught = labelled(labels)
    rate = min(1.0, settings.examples / max(1, taught.count()))
    at = F.xxhash64("doc_id", "vector")
    known = vectors.join(taught, "doc_id").select("vector", "y", at.alias("at"))
    rows = known.where(F.pmod("at", F.lit(1 << 30)) < int(rate * (1 << 30))).collect()
    rows.sort(key=lambda r: (r["at"], r["y"]))
    width = features(settings.width)
    x = np.array([r["vector"] for r in rows], np.float64).reshape(-1, width)
    y, aside = np.array([r["y"] for r in rows], np.float64), np.arange(len(rows)) % 5 == 4
    network = fit(x[~aside], y[~aside], settings)
    calibrate(network, x[aside], y[aside])
    return network


def score(vectors: DataFrame, network: Network) -> DataFrame:
    """`vectors` (any columns and `vector`) with `score` (0 to 1) in the vector's place."""
    kept = [c for c in vectors.columns if c.lower() not in ("vector", "score")]
    fields = [f"`{name}` {kind}" for name, kind in vectors.select(*(f"`{c}`" for c in kept)).dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()) if len(batch) else np.zeros((0, len(network.mean)))
            yield batch[kept].assign(score=network.scores(x))

    return vectors.mapInPandas(run, ", ".join([*fields, "score double"]))


def quality(docs: DataFrame, labels: DataFrame, teaches, settings: Settings = Settings()) -> DataFrame:
    """`doc_id, score` for each row of `docs` (`doc_id, text`): how likely its quality label is 1.

    Word vectors come from all texts, labels only from rows where the column expression `teaches` (of `doc_id`) holds. A
    NULL or empty text has no words and a score of its own like any other. Rows and ids may repeat, ids may be NULL; equal
    texts get equal scores. Without any label every score is 0.5.
    """
    # As text, for pandas would turn a column of integers with NULLs into doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    often = vocabulary(docs, settings)
    words = stored(numbered(rows, often, settings))
    vectors = stored(document_vectors(words, context_vectors(words, often, settings)))
    known = vectors.withColumn("doc_id", F.col("doc_id").cast("long"))
    network = learn(known.where(teaches), labels.where(teaches), settings)
    return score(vectors, network).withColumn("doc_id", F.col("doc_id").cast("long"))
