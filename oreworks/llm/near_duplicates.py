"""Near duplicates: an exact Jaccard join of word shingles, and the components of its links.

Prefixes of token combinations. Shingles are ordered from rare to frequent by the number of documents that have them. Two
sets whose Jaccard similarity reaches the bound share enough of their first shingles (the prefix) to share a signature:
a single shingle of the rare class, or a pair of one group of the frequent class, for which the prefix is extended by one
shingle a group. Signatures are matched, candidates are verified on their shingles.

The steps, and what each moves:

1. Documents are read once, in blocks. A block sends its distinct shingles, sorted and packed, to the range of hashes they
   fall in (a shingle in many documents of a block goes once), where those that occur elsewhere too are found. Only these
   come back: a shingle of one document can't match anything.
2. Documents with one set of shingles are one node; one of them keeps its shingles.
3. A signature's nodes are compared with the least edited of them (a star, not all pairs), and components are formed.
4. Signatures whose other nodes are not yet in one component are left. Their clusters compare the nodes outside the
   cluster's largest component with all nodes, in blocks of bounded size, inside tasks; only found links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import pack, pack_sorted, release, unpack, unpack_sorted
from oreworks.llm.common import connected_components, small_batches, stored
from oreworks.llm.shingles import WORDS, WordHashes, shingles


@dataclass(frozen=True)
class Settings:
    """percent: Jaccard similarity of a link, in hundredths. words: of a shingle.

    block_shingles: shingles that a task gathers before it sends them. range_shingles, range_sets: about as many meet in
    one range.
    rare: documents up to which a shingle is of the rare class.
    side: nodes on either side of a block of comparisons.
    """

    percent: int = 75
    words: int = WORDS
    block_shingles: int = 1 << 19
    range_shingles: int = 1 << 20
    range_sets: int = 1 << 17
    rare: int = 64
    side: int = 1024


def _block_rows(block: int, rows: list[tuple], ranges: int, classes: int) -> pd.DataFrame:
    """A block's messages: its documents to itself, its distinct shingles and sets to the ranges that compare them."""
    digests = [xxhash.xxh3_128_digest(row[2].tobytes()) for row in rows]
    place = {digest: k for k, digest in reversed(list(enumerate(digests)))}
    own = sorted(place.values())  # of equal sets in a block, the first speaks for all
    every = np.concatenate([rows[k][2] for k in own])
    owner = np.repeat(np.array(own, np.uint32), [len(rows[k][2]) for k in own])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    distinct = every[first]
    counts = np.diff(np.append(np.flatnonzero(first), len(every))).astype(np.uint32)
    edges = [(k << 64) // ranges for k in range(1, ranges)]
    cuts = np.concatenate(([0], np.searchsorted(distinct, np.array(edges, np.uint64)), [len(distinct)])).astype(np.int64)
    none = (None,) * 6
    out = [
        (k, block, pack_sorted(distinct[a:b]), pack(counts[a:b]), *none[:5])
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        if b > a
    ]
    meet: dict[int, list[int]] = {}
    for k in own:
        meet.setdefault(ranges + int.from_bytes(digests[k][:8], "little") % classes, []).append(k)
    out += [
        (to, block, pack(np.array(ks, np.int64)), b"".join(digests[k] for k in ks), *none[:5]) for to, ks in meet.items()
    ]
    ids, keys = (np.array([row[k] for row in rows], np.int64) for k in (0, 1))
    sizes = np.array([len(row[2]) for row in rows], np.int64)
    out.append((
        -1 - block, block, pack(owner), pack(np.packbits(first)), pack(cuts), pack(ids), pack(keys), pack(sizes),
        b"".join(digests),
    ))
    return pd.DataFrame(out, columns=["place", "block", "a", "b", "c", "d", "e", "f", "g"])


_MESSAGE = "place long, block long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def _blocks(settings: Settings, ranges: int, classes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, rows, held = WordHashes(), [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"].array, batch["row_key"].array, batch["text"]):
                found = shingles(text, hashes, settings.words)
                rows.append((doc_id, key, found))
                held += len(found) + 16
                if held >= settings.block_shingles:
                    yield _block_rows(block, rows, ranges, classes)
                    block, rows, held = block + 1, [], 0
                    release()
        if rows:
            yield _block_rows(block, rows, ranges, classes)
        del rows, hashes
        release()

    return run


def _answers(ranges: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        release()
        place = group["place"].iloc[0]
        if place < 0:
            return group
        out = _repeated(group) if place < ranges else _first_of_class(group)
        columns = ["place", "block", "a", "b", "c", "d", "e", "f", "g"]
        return pd.DataFrame([row + (None,) * (9 - len(row)) for row in out], columns=columns)

    return run


def _repeated(group: pd.DataFrame) -> list[tuple]:
    """Of one range: each block's shingles that occur in more than one document, with the number of documents."""
    parts = [unpack_sorted(data, np.uint64) for data in group["a"]]
    counts = np.concatenate([unpack(data, np.uint32) for data in group["b"]]).astype(np.int64)
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    totals = np.add.reduceat(counts[order], np.flatnonzero(first))
    frequency = np.empty(len(every), np.int64)
    frequency[order] = totals[np.cumsum(first) - 1]
    out, start = [], 0
    for place, block, part in zip(group["place"], group["block"], parts):
        own = frequency[start : start + len(part)]
        start += len(part)
        at = np.flatnonzero(own > 1)
        if len(at):
            shown = np.minimum(own[at], np.iinfo(np.int32).max).astype(np.int32)
            out.append((place, block, pack_sorted(at.astype(np.int64)), pack_sorted(part[at]), pack(shown)))
    return out


def _first_of_class(group: pd.DataFrame) -> list[tuple]:
    """Of one range of digests: each block's sets that no earlier block has."""
    group = group.sort_values("block")
    digests = np.frombuffer(b"".join(group["b"]), "S16")
    fresh = np.zeros(len(digests), bool)
    fresh[np.unique(digests, return_index=True)[1]] = True
    out, start = [], 0
    for place, block, data in zip(group["place"], group["block"], group["a"]):
        at = unpack(data, np.int64)
        mine = at[fresh[start : start + len(at)]]
        start += len(at)
        if len(mine):
            out.append((place, block, pack(mine)))
    return out


def _pairs_of(tokens: np.ndarray, groups: int, space: int) -> np.ndarray:
    """Signatures of all pairs of tokens within each group."""
    group = tokens % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    tokens, group = tokens[order], group[order]
    out = []
    for step in range(1, len(tokens)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        low = np.minimum(tokens[step:][same], tokens[:-step][same])
        high = np.maximum(tokens[step:][same], tokens[:-step][same])
        out.append((low * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (high + np.uint64(space * 0x9E3779B97F4A7C15 % 2**64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def signatures(tokens: np.ndarray, frequency: np.ndarray, size: int, settings: Settings) -> np.ndarray:
    """Signatures of a set of `size` shingles, of which `tokens` (from rare to frequent) occur elsewhere too.

    The frequent class of a set of size n is split into groups by hash, n/32 rounded to a power of two, and a signature is
    a pair of one group. Sizes of linked sets differ by less than a factor of two, so each set gives signatures for its
    own and the next power; two linked sets have one of these in common. If no signature is shared, the prefixes share at
    most one shingle of each group, and the prefix is longer than the bound allows for by the number of groups that it
    touches.
    """
    alone = size - len(tokens)
    needed = size - -(-settings.percent * size // 100) + 1
    if alone >= needed:
        return np.empty(0, np.uint64)
    rare = int(np.searchsorted(frequency, settings.rare, side="right"))
    single = tokens[: min(rare, needed - alone)]
    if alone + rare >= needed:
        return np.unique(single)
    out, frequent = [single], tokens[rare:]
    for power in (size.bit_length(), size.bit_length() + 1):
        groups = max(1, (1 << power) // 32)
        fresh = np.zeros(len(frequent), bool)
        fresh[np.unique(frequent % np.uint64(groups), return_index=True)[1]] = True
        gained = alone + rare + np.cumsum(~fresh)  # the first shingle of a group in the prefix is the one allowed for
        end = int(np.searchsorted(gained, needed)) + 1
        out.append(_pairs_of(frequent[:end], groups, power))
    return np.unique(np.concatenate(out))


_NODE = "doc_id long, row_key long, n_shingles long, node string, alone long, repeated array<long>, signatures array<long>"


def _assemble(settings: Settings, ranges: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        release()
        own = group[group["place"] < 0].iloc[0]
        owner = unpack(own["a"], np.uint32)
        first = np.unpackbits(unpack(own["b"], np.uint8), count=len(owner)).astype(bool)
        cuts, ids, keys, sizes = (unpack(own[c], np.int64) for c in "cdef")
        digests = own["g"]
        frequency, token = np.zeros(int(first.sum()), np.int64), np.zeros(int(first.sum()), np.uint64)
        leads = np.zeros(len(ids), bool)
        for place, a, b, c in zip(group["place"], group["a"], group["b"], group["c"]):
            if place >= ranges:
                leads[unpack(a, np.int64)] = True
            elif place >= 0:
                at = cuts[place] + unpack_sorted(a, np.int64)
                token[at], frequency[at] = unpack_sorted(b, np.uint64), unpack(c, np.int32)
        which = np.cumsum(first) - 1
        known = (frequency[which] > 1) & leads[owner]
        owner, which = owner[known], which[known]
        order = np.lexsort((token[which], frequency[which], owner))
        owner, tokens, counts = owner[order], token[which][order], frequency[which][order]
        starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = []
        for k in range(len(ids)):
            mine, often = tokens[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]]
            signs = signatures(mine, often, int(sizes[k]), settings) if len(mine) else mine
            held = mine if len(signs) else mine[:0]
            out.append((
                int(ids[k]), int(keys[k]), int(sizes[k]),
                digests[16 * k : 16 * k + 16].hex() if sizes[k] else None, int(sizes[k]) - len(mine),
                held.view(np.int64), signs.view(np.int64),
            ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])

    return run


def row_key() -> Column:
    """Key of a row of documents: a hash of id and text whose last bit is set where the id is NULL."""
    mixed = F.xxhash64("doc_id", "text")
    return (mixed - F.pmod(mixed, F.lit(2))).bitwiseOR(F.col("doc_id").isNull().cast("long"))


def shingle_sets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`doc_id, row_key, n_shingles, node, alone, repeated, signatures` for each row of `docs` (`doc_id, text`).

    row_key: hash of id and text. node: digest of the set, NULL for an empty one. alone: shingles that no other row has.
    repeated: the others, from rare to frequent. They and the signatures are given for one row of each node, and only if
    another set may link.
    `docs` has to give the same rows for a partition each time it is read (a stored table does).
    """
    small_batches(docs.sparkSession)
    # pandas has no NULL among integers: a missing id travels as 0, and the key's last bit tells.
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", row_key().alias("row_key"))
    chars, count = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    ranges = max(16, (chars or 0) // 6 // settings.range_shingles)
    classes = max(4, count // settings.range_sets)
    sent = rows.mapInPandas(_blocks(settings, ranges, classes), _MESSAGE)
    answered = sent.groupBy("place").applyInPandas(_answers(ranges), _MESSAGE)
    made = answered.groupBy("block").applyInPandas(_assemble(settings, ranges), _NODE)
    return made.withColumn("doc_id", F.when(F.col("row_key").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")))


def _links(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Of the candidate `pairs(a, b)`, those whose sets reach the similarity."""
    one = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("repeated").alias("r_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("repeated").alias("r_b"))
    shared = F.size(F.array_intersect("r_a", "r_b"))
    enough = (100 + settings.percent) * shared >= settings.percent * (F.col("n_a") + F.col("n_b"))
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def _compare(settings: Settings):
    """Of one block of comparisons: for each of its queries, one link to each other component of its candidates."""
    columns = ["a", "b"]

    def run(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(others):
            return pd.DataFrame(columns=columns)
        held = np.concatenate([np.asarray(x, np.int64) for x in queries["repeated"]])
        owner = np.repeat(np.arange(len(queries)), [len(x) for x in queries["repeated"]])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        sizes, names, component = (queries[c].to_numpy() for c in ("n_shingles", "node", "component"))
        found: dict[tuple, tuple] = {}
        for node, other, n, tokens in zip(others["node"], others["component"], others["n_shingles"], others["repeated"]):
            tokens = np.asarray(tokens, np.int64)
            low, high = np.searchsorted(held, tokens), np.searchsorted(held, tokens, side="right")
            width = high - low
            at = np.repeat(low - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
            shared = np.bincount(owner[at], minlength=len(queries))
            near = (100 + settings.percent) * shared >= settings.percent * (sizes + n)
            for k in np.flatnonzero(near & (component != other)):
                found.setdefault((k, other), (names[k], node))
        return pd.DataFrame(list(found.values()), columns=columns)

    return run


def _remaining_links(signs: DataFrame, nodes: DataFrame, components: DataFrame, settings: Settings) -> DataFrame | None:
    """Links that the stars have not shown, between nodes of one signature but of different components."""
    placed = signs.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = (
        placed.groupBy("sign")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub"))
        .where("low <> high")
        .select("sign", "hub")
    )
    left = stored(placed.join(open_, "sign").select("node", "component", "hub").distinct())
    if left.isEmpty():
        return None
    clusters = connected_components(left.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = left.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node")
    counts = members.groupBy("cluster", "component").count()
    sizes = counts.groupBy("cluster").agg(
        F.sum("count").alias("all"), F.max(F.struct("count", "component")).alias("top")
    )
    side = F.lit(float(settings.side))
    sizes = sizes.select(
        "cluster", F.col("top.component").alias("main"), F.ceil(F.col("all") / side).alias("slices"),
        F.greatest(F.ceil((F.col("all") - F.col("top.count")) / side), F.lit(1)).alias("blocks"),
    )
    members = stored(members.join(sizes, "cluster").join(nodes.select("node", "n_shingles", "repeated"), "node"))
    spread = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    queries = members.where("component <> main").withColumn("block", spread(1, "blocks"))
    queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    others = members.withColumn("slice", spread(2, "slices"))
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "block", "slice"]
    sides = (df.select(*keys, "node", "component", "n_shingles", "repeated").groupBy(*keys) for df in (queries, others))
    asked, given = sides
    return asked.cogroup(given).applyInPandas(_compare(settings), "a string, b string")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`doc_id, row_key, n_shingles, component_id` for each row of `docs` (`doc_id, text`).

    component_id is the smallest id that links reach, the row's own included. Rows with equal sets of shingles are linked.
    A NULL or wordless text has no shingles and no links, and its component is its own id. Ids may repeat and may be NULL;
    a component of rows without ids is NULL.
    """
    sets = stored(shingle_sets(docs, settings))
    able = sets.where(F.size("signatures") > 0)
    nodes = able.select("node", "n_shingles", "alone", "repeated", "signatures")
    signs = nodes.select(
        "node", "n_shingles", (F.col("alone") / F.col("n_shingles")).alias("edited"), F.explode("signatures").alias("sign")
    )
    hubs = (
        signs.groupBy("sign")
        .agg(F.count("*").alias("members"), F.min(F.struct("edited", "node", "n_shingles")).alias("hub"))
        .where("members > 1")
    )
    shared = stored(signs.join(hubs, "sign").select("sign", "members", "hub", "node", "n_shingles"))
    low, high = F.least("n_shingles", "hub.n_shingles"), F.greatest("n_shingles", "hub.n_shingles")
    pairs = shared.where((F.col("node") != F.col("hub.node")) & (100 * low >= settings.percent * high))
    links = stored(_links(pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), nodes, settings))
    components = connected_components(links)
    rest = shared.where((F.col("members") > 2) & (F.col("node") != F.col("hub.node"))).select("sign", "node")
    more = _remaining_links(rest, nodes, components, settings)
    if more is not None:
        components = connected_components(links.unionByName(more))
    rows = sets.select("doc_id", "row_key", "n_shingles", "node")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labels = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(lowest, "component").select("node", "component", "component_id")
    return rows.join(labels, "node", "left").select(
        "doc_id", "row_key", "n_shingles", "component",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
