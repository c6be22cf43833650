"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks.llm.common import SMALL_ROWS, stored

#: Rates beyond this are drawn in lanes: counts of independent draws add up to one of the whole rate.
LANE_RATE = 64.0
#: More than any draw of a lane gives.
LANE_COPIES = 1024
#: Parts in which a hash is read as a number between 0 and 1.
_PARTS = 1 << 52


def uniform(seed: int, lane: Column | None = None) -> Column:
    """A number in [0, 1) from the seed, the id and the text: the same wherever and whenever it is computed.

    Lanes but the first one have numbers of their own.
    """
    first = F.lit(str(seed))
    if lane is not None:
        first = F.when(lane > 0, F.concat(first, F.lit("/"), lane.cast("string"))).otherwise(first)
    key = F.concat_ws(":", first, F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(_PARTS))


def _cumulative(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... up to where its tail is below what a double tells from 1.

    Terms are logarithms, so that a large rate does not underflow. Rounded, so that no platform's last bit matters.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.round(F.exp(-rate), 12)).alias("all"))

    def step(done: Column, k: Column) -> Column:
        term = done["term"] + F.log(rate) - F.log(k.cast("double"))
        upto = done["sum"] + F.exp(term)
        return F.struct(term.alias("term"), upto.alias("sum"), F.concat(done["all"], F.array(F.round(upto, 12))).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda done: done["all"])).otherwise(
        F.array(F.lit(1.0))
    )


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """`source, rate, lanes, cumulative`: mean repetitions that bring each source to its share of all characters.

    `cumulative` is the distribution function of one of the rate's equal lanes, of LANE_RATE at most, so it is short
    however large a rate is.

    Without `weights` all sources get the same share; with them, sources that they do not name get none. Weights are taken
    in proportion, over the sources that have text. NULL is a source of its own, which only equal shares include.
    """
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        wanted = sizes.join(table, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    wanted = wanted.where("size > 0")
    wanted = stored(wanted)
    totals = wanted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    whole, weight = F.lit(float(totals["size"] or 0)), F.lit(float(totals["weight"] or 0))
    rate = F.when(weight > 0, F.col("weight") / weight * whole / F.col("size")).otherwise(0.0)
    lanes = F.greatest(F.lit(1), F.ceil(F.col("rate") / LANE_RATE)).cast("long")
    return wanted.withColumn("rate", rate).withColumn("lanes", lanes).select(
        "source", "rate", "lanes", _cumulative(F.col("rate") / F.col("lanes")).alias("cumulative")
    )


def _starts(lanes: Column) -> Column:
    """Every LANE_COPIES-th lane."""
    return F.sequence(F.lit(0).cast("long"), lanes - 1, F.lit(LANE_COPIES).cast("long"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """All columns of `docs` plus `copy` (from 0; from a multiple of LANE_COPIES in each further lane), each document as often as its Poisson count says, in shuffled order.

    The count inverts the Poisson distribution of the source's rate at a number hashed from seed, id and text; so equal
    rows get equal counts. A document without text in a source that has some follows the source's rate; a source without
    any text is left out, for no repetition gives it a share. Rows go to partitions by a hash of seed, row and copy, and
    are ordered by it there. A column `copy` of the input is replaced.

    Rates are a small table: they are broadcast if their count allows, else joined with the documents of a source dealt
    into 64 lanes.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"))
    rows = docs.select(own.alias("row"), "source", uniform(seed).alias("place"))
    found = rates(docs, weights)
    small = found.limit(SMALL_ROWS + 1).collect()
    if len(small) <= SMALL_ROWS:
        found = docs.sparkSession.createDataFrame(small, found.schema)
        joined = rows.alias("d").join(F.broadcast(found).alias("r"), F.expr("d.source <=> r.source"))
    else:
        spread = found.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(63))))
        rows = rows.withColumn("spread", F.floor(F.col("place") * 1_000_003).cast("int") % 64)
        joined = rows.alias("d").join(spread.alias("r"), F.expr("d.source <=> r.source AND d.spread = r.spread"))
    # A source with a rate of many lanes has few characters, and its documents go on over the cluster lane by lane.
    one = joined.where("lanes = 1").select("row", "place", F.lit(0).cast("long").alias("lane"), "cumulative")
    many = joined.where("lanes > 1").select("row", "lanes", "cumulative", F.explode(_starts(F.col("lanes"))).alias("start"))
    many = many.repartition("start", F.xxhash64("row")).select(
        "row", "cumulative", F.explode(F.sequence("start", F.least(F.col("start") + LANE_COPIES, F.col("lanes")) - 1)).alias("lane")
    )
    id_and_text = [F.col(f"row.`{c}`").alias(c) for c in ("doc_id", "text")]
    many = many.select("row", "cumulative", "lane", *id_and_text).withColumn("place", uniform(seed, F.col("lane")))
    drawn = one.unionByName(many.select("row", "place", "lane", "cumulative"))
    count = F.size(F.filter("cumulative", lambda upto: upto <= F.col("place")))
    copies = drawn.select("row", "place", "lane", count.alias("n")).where("n > 0")
    copies = copies.select("row", "place", "lane", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    copies = copies.select("row", "place", (F.col("lane") * LANE_COPIES + F.col("k")).alias("copy"))
    key = F.xxhash64(F.lit(seed), "place", "copy")
    keyed = copies.withColumn("key", key)
    dealt = keyed.repartition(partitions, "key") if partitions else keyed.repartition("key")
    return dealt.sortWithinPartitions("key").select("row.*", "copy")
