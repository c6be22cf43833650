"""Conversation repair: the cheapest edits that make roles alternate, by a run-length dynamic program.

A row's symbol is its role's initial with its fault. What a row may become moves a conversation between four states
(nothing kept, last kept a system, user or assistant row), so a row is a min-plus matrix of 4 by 4 and equal consecutive
rows, a run, are a power of it. Costs to go pass over a run by its cached binary powers; the choices are then unrolled
from the front, the ASCII-least one among the cheapest each time, in halves of a run, so that memory does not follow it.

A conversation may be any share of the table. Faults and order need narrow rows only, without texts; these are sorted
over range partitions, which are blocks of bounded size. A conversation that spans blocks passes through each block as
one matrix: the driver combines the two edges of every block, a few numbers, and hands each block the costs behind its
last row and the state before its first. Equal rows are one narrow row with a count. At the end, edits and texts of a
conversation run through a task as a sorted stream, which is what a hash of the whole repaired text asks for; the task
holds a hash state, the audit string and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import release
from oreworks.llm.common import small_batches, stored

Vector = tuple[float, float, float, float]
Matrix = tuple[Vector, Vector, Vector, Vector]

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INFINITE = float("inf")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after the role that may follow each state when a row is inserted or gets another role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row with an initial leads from each state; None where it may not stand.
KEPT = {
    "s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "": (None,) * 4,
}
#: Symbols: a row that has to go, then initials (one for all others) without and with a truncated text.
FORCED = 0
SYMBOLS = ("", "s", "u", "a", "", "s", "u", "a", "")

# White space, and what ends a sentence.
BLANK = r"\x20\x09-\x0D"
CLOSING = ".!?"


@dataclass(frozen=True)
class Settings:
    """block_rows: different rows of a block, about; what one task holds of narrow rows."""

    block_rows: int = 200_000


def choices(symbol: int, state: int) -> Iterator[tuple[str, float, int, bool]]:
    """Edits at a row in a state: initial, cost, state after it, and whether the row is used up. In ASCII order."""
    yield "D", DELETE, state, True
    yield "I", INSERT, FOLLOWS[state], False
    if symbol != FORCED:
        extra = TRUNCATED if symbol > 4 else 0
        kept = KEPT[SYMBOLS[symbol]][state]
        if kept is not None:
            yield "K", KEEP + extra, kept, True
        yield "R", REROLE + extra, FOLLOWS[state], True


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0.0 if i == j else INFINITE for j in range(4)) for i in range(4))
_INSERTED: Matrix = tuple(tuple(0.0 if i == j else INSERT if FOLLOWS[i] == j else INFINITE for j in range(4)) for i in range(4))
#: Any inserts: no cheapest way has more than two together.
INSERTS = times(_INSERTED, _INSERTED)
#: Costs to go behind the last row: a repaired conversation is empty or ends with an assistant.
END: Vector = onto(INSERTS, (0.0, INFINITE, INFINITE, 0.0))


@lru_cache(maxsize=1024)
def power(symbol: int, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent rows of a symbol, each after any inserts before it."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    edits = [[INFINITE] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after, used in choices(symbol, state):
            if used:
                edits[state][after] = min(edits[state][after], float(cost))
    return times(INSERTS, tuple(map(tuple, edits)))


@lru_cache(maxsize=200_000)
def _advance(symbol: int, count: int, after: Vector) -> Vector:
    for exponent in range(count.bit_length()):
        if count >> exponent & 1:
            after = onto(power(symbol, exponent), after)
    return after


def advance(symbol: int, count: int, after: Vector) -> Vector:
    """Costs to go before a run of `count` rows from those behind it."""
    least = min(after)
    return tuple(least + x for x in _advance(symbol, count, tuple(x - least for x in after)))


def matrix(runs: list[tuple[int, int]]) -> Matrix:
    """The min-plus product of runs (symbol, count)."""
    found = IDENTITY
    for symbol, count in runs:
        for exponent in range(count.bit_length()):
            if count >> exponent & 1:
                found = times(found, power(symbol, exponent))
    return found


@lru_cache(maxsize=200_000)
def _step(symbol: int, state: int, before: Vector, after: Vector) -> tuple[str, int]:
    """Edits of one row, with the inserts before it, and the state after it."""
    out, used = "", False
    while not used:
        for initial, cost, then, used in choices(symbol, state):
            if cost + (after if used else before)[then] == before[state]:
                break
        out, state = out + initial, then
    return out, state


def unroll(symbol: int, count: int, state: int, after: Vector) -> Iterator[tuple[str, int]]:
    """Edits and the state after every row of a run. Halves of a run are unrolled one after the other."""
    if count == 1:
        least = min(after)
        after = tuple(x - least for x in after)
        yield _step(symbol, state, _advance(symbol, 1, after), after)
        return
    second = count // 2
    for found in unroll(symbol, count - second, state, advance(symbol, second, after)):
        state = found[1]
        yield found
    yield from unroll(symbol, second, state, after)


def final_inserts(state: int) -> str:
    return {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


def runs_of(symbols: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Runs of narrow rows: the first copy of a row has its symbol, the others repeat it and have to go."""
    out: list[tuple[int, int]] = []
    for symbol, count in zip(symbols, counts):
        for each, n in ((symbol, 1), (FORCED, count - 1)):
            if n and out and out[-1][0] == each:
                out[-1] = (each, out[-1][1] + n)
            elif n:
                out.append((each, n))
    return out


def edits_of(runs: list[tuple[int, int]], counts: list[int], state: int, after: Vector) -> tuple[list[str], int]:
    """Edits of every narrow row, those of its copies together, and the state behind the last."""
    behind = [after]
    for symbol, count in reversed(runs):
        behind.append(advance(symbol, count, behind[-1]))
    behind.reverse()

    def rows() -> Iterator[tuple[str, int]]:
        at = state
        for (symbol, count), cost in zip(runs, behind[1:]):
            for found in unroll(symbol, count, at, cost):
                at = found[1]
                yield found

    walk, out = rows(), []
    for count in counts:
        pieces = []
        for _ in range(count):
            edits, state = next(walk)
            pieces.append(edits)
        out.append("".join(pieces))
    return out, state


def cost_of(symbol_truncated: bool, edits: str) -> int:
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    return sum(price[e] for e in edits) + (TRUNCATED if symbol_truncated and ("K" in edits or "R" in edits) else 0)


def damage(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, copies` of conversations, damaged by a hash of id and turn; a dropped row has no copies.

    One of twenty values each drops the row, empties its text, takes out what ends sentences, repeats the row, or makes
    its role user. NULLs of ids and turns are a blank in the hash, those of roles and texts become one.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate.isin(0, 1), "").when(fate == 2, F.translate(text, CLOSING, "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# A row of a conversation is named by these; a NULL id or turn is a flag and a zero, so that names can be compared.
_NAME = ["no_id", "conv", "timed", "at", "role", "digest"]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "no_id": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0)), "timed": F.col("turn").isNotNull(),
        "at": F.coalesce("turn", F.lit(0)), "digest": F.md5(F.col("text").cast("binary")),
    })


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: name, `copies`, `symbol`, and the faults of the first copy, for all `rows` with copies.

    A row repeats an earlier one if another of its conversation with this role and text has a smaller turn; the first one
    is found by an aggregate and met on the full name, so a text that is everywhere is spread over its turns.
    """
    text = F.col("text")
    is_blank = ~text.rlike(f"[^{BLANK}]")
    is_open = ~text.rlike(f"[{CLOSING}][{BLANK}]*\\z")
    named = _named(rows.where("copies > 0"))
    found = named.withColumns({"blank": is_blank, "open": is_open}).groupBy(*_NAME, "blank", "open").agg(F.sum("copies").alias("copies"))
    early = F.when(F.col("timed"), F.col("at"))
    first = found.groupBy("no_id", "conv", "role", "digest").agg(F.min("timed").alias("timed"), F.min(early).alias("early"))
    # The earliest turn, or none if one of them is NULL.
    first = first.select(
        "no_id", "conv", "role", "digest", "timed", F.when(F.col("timed"), F.col("early")).otherwise(0).alias("at"),
        F.lit(True).alias("first"),
    )
    found = found.join(first, _NAME, "left")
    initial = F.substring("role", 1, 1)
    clean = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    duplicate = ~F.col("blank") & F.col("first").isNull()
    return found.select(
        *_NAME, "copies",
        F.when(F.col("blank") | duplicate, FORCED).when(F.col("open"), clean + 4).otherwise(clean).alias("symbol"),
    )


def in_blocks(narrow: DataFrame, settings: Settings) -> DataFrame:
    """Narrow rows with `block` and their `place`, in order of conversation, turn (NULL first), role and digest of the text."""
    narrow = stored(narrow)
    blocks = max(1, -(-narrow.count() // settings.block_rows))
    placed = narrow.repartitionByRange(blocks, *_NAME).sortWithinPartitions(*_NAME)
    return stored(placed.withColumn("block", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()))


def _conversations(group: pd.DataFrame) -> Iterator[tuple[tuple[bool, int], int, int]]:
    """Name, first and last place (exclusive) of every conversation of a sorted block."""
    no_id, conv = group["no_id"].to_numpy(), group["conv"].to_numpy()
    new = np.flatnonzero((conv[1:] != conv[:-1]) | (no_id[1:] != no_id[:-1])) + 1
    edges = [0, *new.tolist(), len(group)]
    for a, b in zip(edges, edges[1:]):
        yield (bool(no_id[a]), int(conv[a])), a, b


_EDGES = "block long, alone boolean, first_no_id boolean, first long, first_costs array<double>, last_no_id boolean, last long, last_costs array<double>"


def _edges(group: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a block's first and last conversation."""
    group = group.sort_values("place")
    spans = list(_conversations(group))
    symbols, counts = group["symbol"].to_numpy(), group["copies"].to_numpy()
    row = [int(group["block"].iloc[0]), len(spans) == 1]
    for name, a, b in (spans[0], spans[-1]):
        found = matrix(runs_of(symbols[a:b].tolist(), counts[a:b].tolist()))
        row += [*name, [x for line in found for x in line]]
    return pd.DataFrame([row], columns=[c.split()[0] for c in _EDGES.split(", ")])


@dataclass
class Edge:
    """A block's edges: names and matrices of its first and last conversation; `alone` if they are one."""

    block: int
    alone: bool
    first: tuple[bool, int]
    first_costs: Matrix
    last: tuple[bool, int]
    last_costs: Matrix


def edges_of(blocks: DataFrame) -> list[Edge]:
    """Edges of all blocks in order: two matrices of 16 numbers for each block, which are few."""
    square = lambda flat: tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))
    rows = blocks.groupBy("block").applyInPandas(_edges, _EDGES).collect()
    return [
        Edge(r["block"], r["alone"], (r["first_no_id"], r["first"]), square(r["first_costs"]),
             (r["last_no_id"], r["last"]), square(r["last_costs"]))
        for r in sorted(rows, key=lambda r: r["block"])
    ]


def behind_blocks(edges: list[Edge]) -> dict[int, Vector]:
    """Costs to go behind the last row of every block whose last conversation goes on in the next one."""
    found: dict[int, Vector] = {}
    for edge, then in zip(reversed(edges[:-1]), reversed(edges[1:])):
        if then.first == edge.last:
            after = found.get(then.block, END) if then.alone else END
            found[edge.block] = onto(then.first_costs, after)
    return found


_EXITS = "block long, exits array<int>"


def _exits(behind: dict[int, Vector]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The state behind a block's last row for each state before its last conversation."""
        block = int(group["block"].iloc[0])
        if block not in behind:
            return pd.DataFrame({"block": [block], "exits": [[]]})
        group = group.sort_values("place")
        _, a, b = list(_conversations(group))[-1]
        counts = group["copies"].to_numpy()[a:b].tolist()
        runs = runs_of(group["symbol"].to_numpy()[a:b].tolist(), counts)
        exits = [edits_of(runs, counts, state, behind[block])[1] for state in range(4)]
        return pd.DataFrame({"block": [block], "exits": [exits]})

    return run


def before_blocks(blocks: DataFrame, edges: list[Edge], behind: dict[int, Vector]) -> dict[int, int]:
    """The state before the first row of every block that goes on with a conversation."""
    if not behind:
        return {}
    exits = {r["block"]: r["exits"] for r in blocks.groupBy("block").applyInPandas(_exits(behind), _EXITS).collect()}
    found: dict[int, int] = {}
    for edge, then in zip(edges, edges[1:]):
        if edge.block in behind:
            found[then.block] = exits[edge.block][found.get(edge.block, NOTHING) if edge.alone else NOTHING]
    return found


_EDITS = "no_id boolean, conv long, timed boolean, at long, role string, digest string, symbol int, edits string, ending string"


def _unrolled(behind: dict[int, Vector], before: dict[int, int]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Edits of every row of a block, and the inserts behind a conversation that ends in it."""
        group = group.sort_values("place")
        block = int(group["block"].iloc[0])
        symbols, counts = group["symbol"].to_numpy(), group["copies"].to_numpy()
        spans = list(_conversations(group))
        edits, ending = [], []
        for k, (_, a, b) in enumerate(spans):
            goes_on = k == len(spans) - 1 and block in behind
            own = counts[a:b].tolist()
            start, after = before.get(block, NOTHING) if k == 0 else NOTHING, behind[block] if goes_on else END
            found, state = edits_of(runs_of(symbols[a:b].tolist(), own), own, start, after)
            edits += found
            # Where a conversation goes on, inserts belong to the row that follows.
            ending += [""] * (b - a - 1) + ["" if goes_on else final_inserts(state)]
        out = group[["no_id", "conv", "timed", "at", "role", "digest", "symbol"]].copy()
        out["edits"], out["ending"] = edits, ending
        release()
        return out

    return run


def edits(narrow: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The cheapest, ASCII-least edits of every narrow row."""
    blocks = in_blocks(narrow, settings)
    edges = edges_of(blocks)
    behind = behind_blocks(edges)
    before = before_blocks(blocks, edges, behind)
    return blocks.groupBy("block").applyInPandas(_unrolled(behind, before), _EDITS)


@dataclass
class Tally:
    """What is known of a conversation while its rows go by."""

    name: tuple[bool, int]

    def __post_init__(self):
        self.hash, self.wrote, self.audit, self.state, self.ending = hashlib.sha256(), False, [], NOTHING, ""
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial = None

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.wrote else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.wrote = True

    def insert(self) -> None:
        self.state = FOLLOWS[self.state]
        self.write(ROLES[self.state], "")

    def row(self, turn: int | None, role: str, text: str, blank: bool, symbol: int, edits: str) -> None:
        """A row with all its copies."""
        copies = len(edits) - edits.count("I")
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        for _ in range(min(copies, 2)):
            self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        # From the third copy on, each meets itself, which is never legal.
        self.illegal += max(0, copies - 2)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (symbol != FORCED)
        self.truncated += symbol > 4
        self.cost += cost_of(symbol > 4, edits)
        self.audit.append(edits)
        for edit in edits:
            if edit == "I":
                self.insert()
            elif edit == "K":
                self.state = KEPT[SYMBOLS[symbol]][self.state]
                self.write(role, text)
            elif edit == "R":
                self.state = FOLLOWS[self.state]
                self.write(ROLES[self.state], text)

    def result(self) -> tuple:
        for _ in self.ending:
            self.insert()
        self.cost += INSERT * len(self.ending)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (
            *self.name, min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
            "".join(self.audit) + self.ending, self.hash.hexdigest(),
        )


_RESULT = (
    "no_id boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of conversations from their sorted stream: of every narrow row its edits, then its texts."""
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    tally, planned = None, None
    for batch in batches:
        out = []
        for no_id, conv, timed, at, role, copies, text, blank, symbol, edits, ending in zip(
            *(batch[c] for c in ("no_id", "conv", "timed", "at", "role", "copies", "text", "blank", "symbol", "edits", "ending"))
        ):
            if tally is None or tally.name != (no_id, conv):
                if tally is not None:
                    out.append(tally.result())
                tally, planned = Tally((no_id, conv)), None
            if edits is not None:
                planned, tally.ending = (int(symbol), edits), tally.ending or ending
            elif copies and planned is not None:  # of equal texts the first one stands for all
                tally.row(int(at) if timed else None, role, text, bool(blank), *planned)
                planned = None
        if out:
            yield pd.DataFrame(out, columns=columns)
    if tally is not None:
        yield pd.DataFrame([tally.result()], columns=columns)


def repair(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each conversation of `rows` (`conv_id, turn, role, text, copies`): its faults and its cheapest repair.

    `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`. A conversation's rows are taken by
    turn, NULL first; rows of one turn by role, then by the MD5 of the text. NULL ids are one conversation. Roles and texts
    are not NULL. A conversation all of whose rows have no copies has zeros, an empty audit and the hash of no text; an
    empty table gives no rows. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    planned = edits(faults(rows), settings)
    wide = _named(rows).select(
        *_NAME, "copies", "text", (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"), F.lit(None).cast("int").alias("symbol"),
        F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("ending"),
    )
    plans = planned.select(
        *_NAME, F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("boolean").alias("blank"), "symbol", "edits", "ending",
    )
    stream = wide.unionByName(plans).repartition("no_id", "conv").sortWithinPartitions(*_NAME, F.col("edits").isNull())
    found = stream.mapInPandas(_repaired, _RESULT)
    return found.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *(c.split()[0] for c in _RESULT.split(", ")[2:]))
