"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreworks.llm.common import stored

#: Bits of a fingerprint: two 64-bit hashes of each term.
BITS = 128
#: Bits in which near copies differ at most: texts with 0.75 of their 5-word shingles in common differ in 5 to 20 bits.
RADIUS = 20
#: Blocks that a fingerprint is cut into.
BLOCKS = 8
#: Documents of a bucket of neighbours, about, and buckets of a group.
BUCKET_ROWS, GROUP_BUCKETS = 1_000, 4_096


def terms(words: Column) -> Column:
    """Each word with the next; a term as often as it occurs, which is its weight."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def fingerprints(texts: DataFrame, key: list[str]) -> DataFrame:
    """`<key>, fingerprint` (32 hexadecimal digits) for each row of `texts`: `key` columns, which identify it, and `text`.

    The hashes of a text's terms vote on every bit, for 1 or for 0; the majority is the fingerprint's bit, and a tie is 0.
    A text without a word, empty or NULL, has all bits 0. Equal texts have equal fingerprints.

    Bits that are 32 apart are counted in one long, which no text is long enough to overflow. Terms of one text are in one
    task, so that only one row for each text is shuffled.
    """
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    listed = texts.select(*key, F.filter(words, lambda w: w != "").alias("words"))
    each = listed.select(*key, F.explode_outer(terms(F.col("words"))).alias("term"))
    votes = lambda *of: F.when(F.col("term").isNotNull(), F.xxhash64("term", *of)).otherwise(0)
    hashed = each.select(*key, votes().alias("h0"), votes(F.lit(1)).alias("h1"), "term")
    both = F.lit(1 | 1 << 32)
    lanes = [
        F.sum(F.shiftrightunsigned(f"h{half}", k).bitwiseAND(both)).alias(f"l{half}_{k}")
        for half in (0, 1) for k in range(32)
    ]
    counted = hashed.groupBy(*key).agg(F.count("term").alias("n"), *lanes)

    def word(half: int, upper: bool) -> Column:
        """32 bits of the fingerprint as a long."""
        bits = F.lit(0).cast("long")
        for k in range(32):
            lane = F.col(f"l{half}_{k}")
            count = F.shiftright(lane, 32) if upper else lane.bitwiseAND(F.lit((1 << 32) - 1))
            bits = bits + F.when(2 * count > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long"))
        return F.lpad(F.lower(F.hex(bits)), 8, "0")

    words = [word(half, upper) for half in (0, 1) for upper in (True, False)]
    return counted.select(*key, F.concat(*words).alias("fingerprint"))


def _words(fingerprint: Column) -> list[Column]:
    return [F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long") for at in range(1, BITS // 4, 8)]


def distance(one: Column, two: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_words(one), _words(two))), F.lit(0))


def likeness(one: Column, two: Column) -> Column:
    return 1 - distance(one, two) / F.lit(float(BITS))


def within(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`query, fingerprint, distance`: the distinct fingerprints of `table` within `radius` of each distinct query.

    Fingerprints are cut into BLOCKS blocks of 16 bits. Of two that differ in no more bits than the radius, some block
    differs in no more than radius / BLOCKS: there is a table for each block, with that block in front as the key, and a
    query asks each table for all keys so near to its own. What it meets is verified. Both sides are a column
    `fingerprint`; NULLs find nothing. Copies of a fingerprint are one row, so groups of copies cost nothing.
    """
    width, most = BITS // BLOCKS, radius // BLOCKS
    flips = [sum(1 << bit for bit in bits) for n in range(most + 1) for bits in combinations(range(width), n)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        """Each distinct fingerprint under its name, its 32-bit words, and a row for each of its blocks."""
        words = [f"{name}_{k}" for k in range(BITS // 32)]
        own = df.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
        own = own.select(F.col("fingerprint").alias(name), *(w.alias(c) for w, c in zip(_words(F.col("fingerprint")), words)))
        blocks = [F.shiftright(F.col(words[k // 2]), width * (1 - k % 2)).bitwiseAND((1 << width) - 1) for k in range(BLOCKS)]
        return own.select("*", F.explode(F.array(*(block + F.lit(k << width) for k, block in enumerate(blocks)))).alias("key"))

    asked, held = keyed(queries, "query"), keyed(table, "fingerprint")
    near = F.transform(F.lit(flips).cast("array<long>"), lambda f: F.col("key").bitwiseXOR(f))
    asked = asked.select(*(c for c in asked.columns if c != "key"), F.explode(near).alias("key"))
    apart = [F.col(f"query_{k}").bitwiseXOR(F.col(f"fingerprint_{k}")) for k in range(BITS // 32)]
    parts = [F.shiftright(apart[k // 2], width * (1 - k % 2)).bitwiseAND((1 << width) - 1) for k in range(BLOCKS)]
    # A pair that is near in several blocks is made by the first of them alone.
    first = F.coalesce(*(F.when(F.bit_count(part) <= most, k) for k, part in enumerate(parts)))
    bits = sum((F.bit_count(x) for x in apart), F.lit(0))
    # Both sides grow with the table, whatever their size is estimated at.
    pairs = asked.join(held.hint("merge"), "key").where((bits <= radius) & (F.shiftright("key", width) == first))
    return pairs.select("query", "fingerprint", bits.alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """`bucket, at, doc_id, text, next_bucket, next_at, next_text`: each row of `docs` (`doc_id, text`) and the next one.

    Rows are in order of id, NULLs first, then of a hash of the text; the last is followed by the first. (bucket, at) names
    a row. Buckets are ranges of ids with about BUCKET_ROWS rows each, so that no task orders more than some of them; the
    first row of the next bucket follows a bucket's last.
    """
    count, low, high = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    width = max(1, (high - low + 1) * BUCKET_ROWS // max(1, count))
    wide = "decimal(20,0)"
    ranged = F.floor((F.col("doc_id").cast(wide) - F.lit(low).cast(wide)) / F.lit(width).cast(wide)).cast("long")
    # Rows without an id are before all others, in buckets by the leading bits of their hash.
    bucket = F.coalesce(ranged, F.shiftright("text_hash", 52) - 4096)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("bucket", bucket)
    rows = rows.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash")
    placed = rows.select(
        "bucket", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"),
        F.lead(F.lit(True)).over(order).alias("more"),
    )
    firsts = placed.where("at = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("first_text"))
    heads = _following(rows.select("bucket").distinct()).join(firsts, "next_bucket")
    joined = placed.join(heads, "bucket")
    return joined.select(
        "bucket", "at", "doc_id", "text",
        F.when(F.col("more"), F.col("bucket")).otherwise(F.col("next_bucket")).alias("next_bucket"),
        F.when(F.col("more"), F.col("at") + 1).otherwise(1).alias("next_at"),
        F.when(F.col("more"), F.col("next_text")).otherwise(F.col("first_text")).alias("next_text"),
    )


def _following(buckets: DataFrame) -> DataFrame:
    """`bucket, next_bucket`: of the buckets that have rows; the last is followed by the first.

    In groups of buckets; only one row for each group, some millions of documents, is ordered as a whole.
    """
    grouped = buckets.withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    inside = grouped.withColumn("inner", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    groups = grouped.groupBy("group").agg(F.min("bucket").alias("first"))
    order = Window.orderBy("group")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = groups.select("group", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("outer"))
    return inside.join(after, "group").select("bucket", F.coalesce("inner", "outer").alias("next_bucket"))


def edited(text: Column, following: Column) -> Column:
    """`text` with its last quarter (in code points, rounded down) replaced by the start of `following`."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare_with_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of all `docs` (`doc_id, text`; a NULL text is empty), of edited texts, and their likeness.

    `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints`. The last
    is, for ids divisible by 100, the number of other distinct fingerprints within the radius, else NULL. A table of one
    row is followed by itself.
    """
    chained = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    key = ["bucket", "at"]
    changed = edited(F.col("text"), F.col("next_text"))
    about = chained.select(
        *key, "doc_id", F.length("text").cast("long").alias("n_chars"), "next_bucket", "next_at",
        F.sha2(changed.cast("binary"), 256).alias("edited_sha256"),
    )
    both = chained.select(*key, F.explode(F.array(
        F.struct(F.lit(False).alias("edit"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("edit"), changed.alias("text")),
    )).alias("one")).select(*key, "one.edit", "one.text")
    found = fingerprints(both, [*key, "edit"])
    pair = found.groupBy(*key).agg(
        F.max(F.when(~F.col("edit"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("edit"), F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    rows = stored(about.join(pair, key))
    following = rows.select(
        F.col("bucket").alias("next_bucket"), F.col("at").alias("next_at"), F.col("fingerprint").alias("next_fingerprint")
    )
    asked = (F.pmod("doc_id", F.lit(100)) == 0) & F.col("doc_id").isNotNull()
    near = within(rows.where(asked), rows, radius).where("query <> fingerprint").groupBy("query").count()
    # Rows that ask nothing have names of their own, which meet nothing and are spread.
    name = F.when(asked, F.col("fingerprint")).otherwise(F.concat_ws(":", "bucket", "at"))
    made = rows.join(following, ["next_bucket", "next_at"]).withColumn("query", name)
    made = made.join(near.withColumnRenamed("count", "near"), "query", "left")
    own = F.col("fingerprint")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"),
        F.when(asked, F.coalesce("near", F.lit(0))).cast("long").alias("near_fingerprints"),
    )
