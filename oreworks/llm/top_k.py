"""Exact search for the largest inner products.

Vectors are processed by descending length, in blocks. Coordinates are rotated so that the leading ones carry most of the
length (singular vectors of all vectors), a partial product over them is taken first, and what the rest can add is bounded
by the lengths of the residuals (Cauchy-Schwarz). Only vectors whose bound reaches the query's k-th best are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreworks.llm.arrays import pack, total
from oreworks.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """k: results of a query. scale: components become floor(scale * x).

    block: vectors of a block. queries: of a block. run: blocks of vectors that one task goes through for one block of
    queries. lead: share of the squared length that the leading coordinates carry.
    """

    k: int = 10
    scale: int = 1024
    block: int = 1024
    queries: int = 1024
    run: int = 8
    lead: float = 0.6


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """`vec_id, v` with v = floor(scale * x) as longs; without vectors that are NULL, empty or hold a NULL, NaN or infinity."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
    kept = vectors.where(whole & F.col("vec_id").isNotNull())
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _gram(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((width, width), np.int64)
        for batch in batches:
            if len(batch):
                m = np.stack(batch["v"].to_numpy()).astype(np.int64)
                found += m.T @ m
        yield pd.DataFrame({"gram": [pack(found.reshape(-1))]})

    return run


def _runs(settings: Settings):
    """Blocks of one partition's vectors, longest first; the partition is their run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["vec_id", "v", "squared"])])
        rows = rows.sort_values(["squared", "vec_id"], ascending=[False, True], kind="stable")
        for at in range(0, len(rows), settings.block):
            yield _block(TaskContext.get().partitionId(), rows.iloc[at : at + settings.block], "run")

    return run


def _block(number: int, rows: pd.DataFrame, name: str) -> pd.DataFrame:
    m = np.stack(rows["v"].to_numpy()).astype(np.int64)
    return pd.DataFrame({name: [number], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})


_NONE = np.iinfo(np.int64).max
_LEAST = -(1 << 63)


class Best:
    """The k best (score, id) of each query: higher scores first, ties to the smaller id."""

    def __init__(self, count: int, k: int):
        self.scores = np.full((count, k), _LEAST, np.int64)
        self.ids = np.full((count, k), _NONE)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores, ids = np.append(self.scores[row], scores), np.append(self.ids[row], ids)
        order = np.lexsort((ids, ~scores))[:k]  # no long is too small for ~
        self.scores[row], self.ids[row] = scores[order], ids[order]


def products(v: np.ndarray, exact_v: np.ndarray, q: np.ndarray, exact_q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the rows of `v` with `q`. `largest` is the product of the largest lengths.

    No partial sum is larger than that (Cauchy-Schwarz on absolute values). Below 2**53 doubles are exact, below 2**62
    long integers; beyond, Python's integers are summed, and what no long can hold is its largest or smallest value.
    """
    if largest < 2.0**53:
        return np.rint(v @ q).astype(np.int64)
    if largest < 2.0**62:
        return exact_v @ exact_q
    limit = 1 << 62
    sums = [sum(a * b for a, b in zip(row, exact_q.tolist())) for row in exact_v.tolist()]
    return np.array([min(max(x, -2 * limit), 2 * limit - 1) for x in sums], np.int64)


def _search(width: int, rotation: np.ndarray, lead: int, settings: Settings):
    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The block of queries with what these blocks of vectors have that may be among a query's best."""
        columns = ["qblock", "ids", "m", "scores", "found"]
        if not len(queries) or not len(blocks):
            return pd.DataFrame(columns=columns)
        names = np.frombuffer(queries["ids"].iloc[0], np.int64)
        exact_q = np.frombuffer(queries["m"].iloc[0], np.int64).reshape(-1, width)
        q = exact_q.astype(np.float64)
        known = np.frombuffer(queries["scores"].iloc[0], np.int64).reshape(len(names), -1)[:, -1]
        turned = q @ rotation
        q_lead, q_rest = turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)
        q_length = np.linalg.norm(q, axis=1)
        best = Best(len(names), settings.k)
        parts = []
        for ids, m in zip(blocks["ids"], blocks["m"]):
            exact_v = np.frombuffer(m, np.int64).reshape(-1, width)
            v = exact_v.astype(np.float64)
            parts.append((np.linalg.norm(v, axis=1), np.frombuffer(ids, np.int64), v, exact_v))
        parts.sort(key=lambda part: -part[0].max())
        for lengths, ids, v, exact_v in parts:
            # Bounds get more slack than they round by.
            least = np.maximum(best.scores[:, -1], known).astype(np.float64)
            least -= 1e-9 * np.abs(least)
            asked = np.flatnonzero(q_length * lengths.max() * (1 + 1e-9) + 1e-3 >= least)
            if not len(asked):
                continue
            turned = v @ rotation
            rest = np.linalg.norm(turned[:, lead:], axis=1)
            bound = q_lead[asked] @ turned[:, :lead].T + q_rest[asked, None] * rest[None, :]
            bound += 1e-9 * q_length[asked, None] * lengths[None, :] + 1e-3
            for row, near in zip(asked, bound >= least[asked, None]):
                at = np.flatnonzero(near & (ids != names[row]))
                if len(at):
                    scores = products(v[at], exact_v[at], q[row], exact_q[row], q_length[row] * lengths[at].max())
                    keep = scores >= known[row]
                    best.add(row, scores[keep], ids[at][keep])
        return queries.assign(scores=[best.scores.tobytes()], found=[best.ids.tobytes()])[columns]

    return run


def _numbers(first: int, last: int) -> Column:
    return F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))


def _query_block(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = _block(int(group["qblock"].iloc[0]), group, "qblock")
        return made.assign(scores=[Best(len(group), k).scores.tobytes()])

    return run


_QUERIES = "qblock long, ids binary, m binary, scores binary"
_FOUND = f"{_QUERIES}, found binary"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for ids, scores, found in zip(batch["ids"], batch["scores"], batch["found"]):
            names, scores, found = (np.frombuffer(x, np.int64) for x in (ids, scores, found))
            names = np.repeat(names, len(found) // max(1, len(names)))
            kept = found != _NONE
            yield pd.DataFrame({"query_id": names[kept], "vec_id": found[kept], "score": scores[kept]})


def top_k(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`query_id, rank, vec_id, score`: of `vectors` (`vec_id, embedding`) the best for each of `queries` (the same columns).

    Scores are inner products of the quantized vectors, exact integers (at the ends of a long if they are beyond it); ties
    go to the smaller id. Rows with a query's id
    are its own and no candidates; a query's id that repeats is asked once, with its first vector in order of components.
    Equal candidates' ids that repeat are each a candidate, and a result may hold them both. Vectors that are NULL, empty or not finite take no
    part, nor do those of another length than the commonest. Fewer candidates than k give fewer results.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    held = quantized(vectors, settings.scale).withColumn("width", F.size("v"))
    widths = held.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width, count = widths["width"], widths["count"]
    held = held.where(F.col("width") == width).drop("width")
    grams = held.select("v").mapInPandas(_gram(width), "gram binary")
    values, axes = np.linalg.eigh(total(grams, width * width).reshape(width, width).astype(np.float64))
    rotation, share = axes[:, ::-1], np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    lead = min(width, int(np.searchsorted(share, settings.lead)) + 1)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    spread = held.withColumn("squared", squared).repartitionByRange(
        -(-count // (settings.block * settings.run)), F.desc("squared"), F.xxhash64("vec_id")
    )
    blocks = stored(spread.mapInPandas(_runs(settings), "run long, ids binary, m binary"))
    last_run = blocks.agg(F.max("run")).first()[0]
    asked = quantized(queries, settings.scale).where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    qblocks = max(1, -(-asked.count() // settings.queries))
    asked = asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(qblocks)))
    asked = stored(asked.groupBy("qblock").applyInPandas(_query_block(settings.k), _QUERIES))
    search = _search(width, rotation, lead, settings)

    def against(known: DataFrame, first: int, last: int) -> DataFrame:
        """Each block of queries with each of these runs of vectors."""
        chosen = blocks.where(F.col("run").between(first, last))
        given = chosen.withColumn("qblock", F.explode(_numbers(0, qblocks - 1)))
        known = known.withColumn("run", F.explode(_numbers(first, last)))
        sides = [df.groupBy("qblock", "run") for df in (known, given)]
        return sides[0].cogroup(sides[1]).applyInPandas(search, _FOUND)

    # The longest vectors first: what they give is the least that a later one has to reach.
    found = stored(against(asked, 0, 0))
    if last_run > 0:
        found = found.unionByName(against(found.drop("found"), 1, last_run))
    rows = found.mapInPandas(_rows, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
