"""Packing: documents become token sequences of one length, filled with lexically similar neighbours.

A document that is longer than a window fills windows by itself; what remains of it is a unit. Units are dealt into shards
by a min-hash of their tokens in which rare tokens weigh more, so that units with the same tokens tend to meet at any size
of the corpus; a min-hash with more units than a shard has is split by row. Within a shard an inverted index with BM25 weights, whose statistics cover all units of all shards, returns the
unused units that are nearest to a seed; they fill the seed's window greedily, and the last one is cut to fit.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import pack, release, total, unpack
from oreworks.llm.common import small_batches, stored


#: Splits as `public_tokenizers.PATTERN` does, and sooner: runs of letters and digits, most pieces of a text, are tried before
#: the contractions. No piece can be both, for a contraction starts with an apostrophe.
PATTERN = r" ?(?:\p{L}+|\p{N}+)|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    """vocabulary: ranks of a byte-level BPE; its ids are those of the tokenizers file with the same vocabulary.

    special: a mark that is one token wherever a text holds it, and its id. window: tokens of a sequence. end: id that closes a document. shard_rows: documents of a shard, about.
    query_terms: the seed's weightiest tokens that are looked up first. tries: neighbours tried first for a window. Where
    all of them fit and leave room, the next ones follow, then those that share any token.
    k1, b: BM25's constants.
    """

    vocabulary: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    size: int = 50_257
    special: tuple[str, int] = ("<|endoftext|>", 50_256)
    window: int = 1024
    end: int = 0
    shard_rows: int = 2048
    query_terms: int = 24
    tries: int = 48
    k1: float = 1.2
    b: float = 0.75


def encoder(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(words: tiktoken.Encoding, text: str, special: tuple[str, int]) -> list[int]:
    """Ids of a text as the tokenizers library gives them: special marks are cut out first, the rest is ordinary text."""
    mark, number = special
    first, *others = text.split(mark)
    ids = words.encode_ordinary(first)
    for part in others:
        ids.append(number)
        ids += words.encode_ordinary(part)
    return ids


_TOKENS = "doc_id long, no_id boolean, place long, key long, ids binary, counts binary"


class Repeats:
    """Places of rows by their hash. A row that repeats within a task gets another place each time.

    A row that is the only one of its kind has its hash as its place, wherever it is read. What is remembered of a task is
    bounded; then it starts anew, so that few of a row's copies share a place.
    """

    def __init__(self, limit: int = 200_000):
        self.seen, self.limit, self.drawn = set(), limit, 0

    def place(self, row: int, task: int) -> int:
        if row not in self.seen:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            self.seen.add(row)
            return row
        self.drawn += 1
        return xxhash.xxh3_64_intdigest(f"{row}:{task}:{self.drawn}".encode()) - (1 << 63)


def order(settings: Settings) -> np.ndarray:
    """Numbers of the vocabulary's tokens; a unit's token with the smallest one is its min-hash.

    They are drawn from a fixed seed so that two units agree with about the chance of their weighted Jaccard similarity. A
    token weighs as much as its rank, for ranks of a byte-level BPE grow as tokens become rare.
    """
    numbers = np.random.default_rng(7).exponential(size=settings.size) / np.arange(1, settings.size + 1)
    numbers[settings.end] = np.inf
    return numbers


def _tokenize(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, repeats, numbers = encoder(settings.vocabulary), Repeats(), order(settings)
        found, units, length = np.zeros(settings.size, np.int64), 0, 0
        for batch in batches:
            place = [repeats.place(row, task) for row, task in zip(batch["place"], batch["task"])]
            out, keys = [], []
            for text in batch["text"]:
                ids = encode(words, text or "", settings.special)
                ids.append(settings.end)
                ids = np.frombuffer(array("I", ids), np.uint32)
                unit = ids[len(ids) // settings.window * settings.window :]
                keys.append(int(unit[np.argmin(numbers[unit])]) if len(unit) else settings.end)
                if len(unit):
                    found[unit] += 1  # numpy adds to a place once, however often it is named
                    units, length = units + 1, length + len(unit)
                out.append(pack(ids))
            yield batch[["doc_id", "no_id"]].assign(place=place, key=keys, ids=out, counts=None)
        counts = pack(np.append(found, [units, length]))
        yield pd.DataFrame({"doc_id": [0], "no_id": [False], "place": [0], "key": [0], "ids": [None], "counts": [counts]})
        del words
        release()

    return run


class Index:
    """BM25 over the units of a shard."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float, settings: Settings):
        lengths = np.array([len(u) for u in units], np.float64)
        terms = np.concatenate(units).astype(np.int64)
        owner = np.repeat(np.arange(len(units)), lengths.astype(np.int64))
        pairs, tf = np.unique(terms * len(units) + owner, return_counts=True)
        self.terms, self.owner = pairs // len(units), pairs % len(units)
        norm = settings.k1 * (1 - settings.b + settings.b * lengths / max(mean, 1.0))
        self.weight = idf[self.terms] * tf * (settings.k1 + 1) / (tf + norm[self.owner])
        self.starts = np.searchsorted(self.terms, np.arange(settings.size + 1))
        by_owner = np.lexsort((-self.weight, self.owner))
        edges = np.searchsorted(self.owner[by_owner], np.arange(len(units) + 1))
        self.queries = [self.terms[by_owner[a:b]] for a, b in zip(edges, edges[1:])]
        self.tries, self.first = settings.tries, settings.query_terms

    def scores(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        lists = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        owners = np.concatenate([self.owner[s] for s in lists])
        return np.bincount(owners, np.concatenate([self.weight[s] for s in lists]), len(unused)) * unused

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """Unused units that share terms with the seed, best first; ties in order of their place.

        The best few, then all others that share one of the weightiest terms, then those that share any other term.
        """
        terms = self.queries[seed]
        scores = self.scores(terms[: self.first], unused)
        found = np.flatnonzero(scores > 0)
        if len(found) > self.tries:
            parted = np.argpartition(-scores[found], self.tries)
            best, rest = found[parted[: self.tries]], found[parted[self.tries :]]
            yield best[np.lexsort((best, -scores[best]))]
            yield rest[np.lexsort((rest, -scores[rest]))]
        else:
            yield found[np.lexsort((found, -scores[found]))]
        if len(terms) > self.first:
            scores = self.scores(terms, unused)
            found = np.flatnonzero(scores > 0)
            yield found[np.lexsort((found, -scores[found]))]


def fill(units: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (unit, start, length); each is full, but for the last of a shard, which is cut at powers of two."""
    start, left = np.zeros(len(units), np.int64), np.array([len(u) for u in units])
    unused = left > 0
    seeds = [(-n, k) for k, n in enumerate(left.tolist()) if n]
    heapq.heapify(seeds)

    def take(k: int, most: int) -> tuple[int, int, int]:
        piece = (k, int(start[k]), int(min(most, left[k])))
        start[k] += piece[2]
        left[k] -= piece[2]
        unused[k] = left[k] > 0
        return piece

    def next_seed() -> int | None:
        while seeds:
            size, k = heapq.heappop(seeds)
            if unused[k] and left[k] == -size:
                return k
        return None

    while (seed := next_seed()) is not None:
        sequence = [take(seed, window)]
        room = window - sequence[0][2]
        cut = None
        for found in index.nearest(seed, unused) if room else ():
            for k in found:
                if left[k] <= room:
                    sequence.append(take(k, room))
                    room -= sequence[-1][2]
                elif cut is None:
                    cut = k
                if not room:
                    break
            # One that is to be cut fills all the room.
            if not room or cut is not None:
                break
        while room and (k := cut if cut is not None else next_seed()) is not None:
            sequence.append(take(k, room))
            room -= sequence[-1][2]
            if unused[k]:
                heapq.heappush(seeds, (-int(left[k]), int(k)))
            cut = None
        if not room:
            yield sequence
        else:
            yield from powers(sequence, window - room)


def powers(pieces: list[tuple[int, int, int]], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces, `size` tokens together, as sequences whose lengths are the powers of two of `size`."""
    pieces = pieces[::-1]
    for power in reversed(range(size.bit_length())):
        room, sequence = size & (1 << power), []
        while room:
            unit, start, length = pieces.pop()
            sequence.append((unit, start, min(room, length)))
            if length > room:
                pieces.append((unit, start + room, length - room))
            room -= sequence[-1][2]
        if sequence:
            yield sequence


_PIECE = "doc_id long, no_id boolean, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_shard(idf: np.ndarray, mean: float, settings: Settings):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        release()
        group = group.sort_values(["doc_id", "no_id", "ids"], kind="stable")
        documents = [unpack(data, np.uint32) for data in group["ids"]]
        ids, missing = group["doc_id"].tolist(), group["no_id"].tolist()
        whole = [len(d) // settings.window * settings.window for d in documents]
        units = [d[n:] for d, n in zip(documents, whole)]
        sequences = [[(k, at - n, settings.window)] for k, n in enumerate(whole) for at in range(0, n, settings.window)]
        if any(len(u) for u in units):
            sequences += fill(units, Index(units, idf, mean, settings), settings.window)
        out, shard = [], int(group["shard"].iloc[0])
        for number, sequence in enumerate(sequences):
            at = 0
            for k, start, length in sequence:
                start += whole[k]
                piece = documents[k][start : start + length]
                out.append((ids[k], missing[k], start, length, len(documents[k]), shard << 32 | number, at, piece.tobytes()))
                at += length
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def deal(documents: DataFrame, settings: Settings) -> DataFrame:
    """`documents` with `shard` in the place of `key` and `place`: in order of key, then place, about `shard_rows` each.

    Counts of the keys reach the driver, at most one for each token of the vocabulary; rows are placed by them alone.
    """
    counts = sorted((r["key"], r["count"]) for r in documents.groupBy("key").count().collect())
    rows = sum(n for _, n in counts)
    shards = max(1, -(-rows // settings.shard_rows))
    starts = np.cumsum([0] + [n for _, n in counts]).tolist()
    spans = documents.sparkSession.createDataFrame(
        [(key, start, n) for (key, n), start in zip(counts, starts)], "key long, first long, n long"
    )
    at = F.col("first") + F.pmod("place", F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    shard = F.least(F.floor(at * (shards / max(1, rows))), F.lit(shards - 1)).cast("long")
    return documents.join(F.broadcast(spans), "key").withColumn("shard", shard).drop("key", "place", "first", "n")


def pack_sequences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of `docs` (`doc_id, text`): `doc_id, start, length, doc_tokens, sequence_id, offset, ids`.

    ids are little-endian unsigned 32-bit token ids. A NULL text is empty and still has its closing id. Rows may repeat,
    ids of documents may be NULL; each row is packed, and rows that repeat are dealt over all shards. No sequence needs padding but one shorter than a window in a shard,
    and that one is cut into sequences whose lengths are powers of two.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text",
        F.xxhash64("doc_id", "text").alias("place"), F.spark_partition_id().alias("task"),
    )
    made = stored(rows.mapInPandas(_tokenize(settings), _TOKENS))
    counts = total(made.select("counts"), settings.size + 2)
    found, units, length = counts[:-2].astype(np.float64), counts[-2], counts[-1]
    idf = np.log1p((units - found + 0.5) / (found + 0.5))
    documents = deal(made.where("ids IS NOT NULL").drop("counts"), settings)
    pieces = documents.groupBy("shard").applyInPandas(_pack_shard(idf, length / max(1, units), settings), _PIECE)
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
