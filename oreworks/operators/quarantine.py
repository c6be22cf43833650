"""Loss-less split of sales into valid and quarantined rows.

Two ways to the same verdicts:

* ``judge`` is one lazy plan: flag customers, evaluate the rules, flag repeats.  Given a
  store for intermediates, it keeps the checked rows and shuffles no wide row for its key.
* ``judge_by_exceptions`` is for the big table.  Defects are rare, so the few unknown
  customers and repeated rows are found first, from narrow key columns, and the wide
  rows are then tagged by those small lists.  The wide rows themselves are not
  shuffled.  ``plans.silver`` puts the steps together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreworks import contract as C
from oreworks.config import Scale
from oreworks.operators import lookups
from oreworks.operators.rules import FAILED, KNOWN, Rule, evaluate, failed_names, mask_columns

ROW_ID = "_row_id"
ORDER = ("_source_priority", "_source_file", "order_ts")
REPEAT = "_repeat"
KEY_HASH = "_key_hash"

_WORKING = (REPEAT, KNOWN, "_source_priority", ROW_ID)


def with_row_id(df: DataFrame) -> DataFrame:
    """Give rows an identity when their source has none.

    Stored tables should bring their own, made of file and row position (see
    ``sources.readers.stored_rows``), which stays the same however often a task
    is run again.
    """
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def flag_repeats(df: DataFrame, key: str, order_by: Sequence[str], eligible: Column) -> DataFrame:
    """``_repeat``: whether an eligible row comes after another eligible row of its key.

    One rule for all keys.  The first row of a key is an aggregate that collapses
    inside every task, and rows are compared with it one by one, so a hot key is
    never gathered; the adaptive skew join splits its rows.  Rows without a key
    repeat nothing.
    """
    order = F.struct(*[F.col(c) for c in order_by], F.col(ROW_ID).alias("id"))
    firsts = (
        df.filter(eligible & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(order)["id"].alias("_first_id"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
        .drop("_copies")
    )
    later = eligible & F.col("_first_id").isNotNull() & (F.col("_first_id") != F.col(ROW_ID))
    return df.join(firsts, key, "left").withColumn(REPEAT, F.coalesce(later, F.lit(False))).drop("_first_id")


def conclude(df: DataFrame, rules: Sequence[Rule], repeat: Column) -> DataFrame:
    """Final ``_reasons``: those of the rules, or repetition alone for a repeated row."""
    return spell_reasons(df.withColumn(REPEAT, repeat), rules)


def spell_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``_reasons`` of judged rows, from their verdict columns."""
    names = F.when(F.col(REPEAT), F.array(F.lit(C.RULE_UNIQUENESS))).otherwise(failed_names(rules))
    return df.withColumn("_reasons", names)


def judge(
    sales: DataFrame,
    registry: DataFrame,
    rules: Sequence[Rule],
    order_by: Sequence[str] = ORDER,
    key: str = "order_id",
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
    scale: Scale = Scale(),
) -> DataFrame:
    """All rows with their final ``_reasons``; an empty list means valid.

    Among the rows that pass every other rule the first per key stays; an invalid
    row never takes its place.  Rows that bring ``_customer_known`` keep it: where sales
    were joined from orders, customers are flagged before their many rows meet them.

    ``stage`` stores the checked rows and makes the verdict one to be read from them:
    repeats are found in the narrow columns of good rows and looked up by row
    (``listed_rows``), so that no wide row is shuffled for its key.  Rows may then share
    an identity only as copies of one row of a key.
    """
    rows = with_row_id(sales)
    if "_source_priority" in order_by and "_source_priority" not in rows.columns:
        rows = rows.withColumn("_source_priority", F.lit(0))
    checked = evaluate(rows if KNOWN in rows.columns else lookups.flag_known(rows, registry), rules)
    good = F.col(FAILED) == 0
    if stage is None:
        return conclude(flag_repeats(checked, key, order_by, good), rules, F.col(REPEAT))
    checked = stage(checked, "checked")
    narrow = checked.filter(good).select(*dict.fromkeys([key, *order_by]), ROW_ID)
    # Distinct within the key, where the rows are already: copies of a row may share an identity.
    repeated = flag_repeats(narrow, key, order_by, F.lit(True)).filter(REPEAT).select(key, ROW_ID).distinct().select(ROW_ID)
    tagged = _with_listed(checked, listed_rows(stage(repeated, "repeated"), scale, stage))
    return conclude(tagged, rules, good & F.col("_listed")).drop("_listed")


def is_valid() -> Column:
    """Of a judged row; reads the verdict columns, so reasons are only spelled out where kept."""
    return (F.col(FAILED) == 0) & ~F.col(REPEAT)


def valid_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(is_valid()).drop("_reasons", *_WORKING, *mask_columns(judged))


def quarantined_rows(judged: DataFrame) -> DataFrame:
    return annotate(judged.filter(~is_valid())).drop(*_WORKING, *mask_columns(judged))


def annotate(quarantine: DataFrame) -> DataFrame:
    """Main reason, its dimension (the text before the dot) and the time of the verdict."""
    main = F.get("_reasons", F.lit(0))
    return quarantine.withColumns(
        {
            "_main_reason": main,
            "_dimension": F.substring_index(main, ".", 1),
            "_quarantined_at": F.current_timestamp(),
        }
    )


def split(sales: DataFrame, registry: DataFrame, rules: Sequence[Rule], **options) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine); together they hold every input row once."""
    judged = judge(sales, registry, rules, **options)
    return valid_rows(judged), quarantined_rows(judged)


def sample_per_reason(
    quarantine: DataFrame, order_by: Sequence[str], per_reason: int = 1
) -> DataFrame:
    """The first rows of each main reason, in a total order."""
    window = Window.partitionBy("_main_reason").orderBy(*order_by)
    ranked = quarantine.withColumn("_n", F.row_number().over(window))
    return ranked.filter(F.col("_n") <= per_reason).drop("_n")


# ---------------------------------------------------------------------------
# The way of the big table
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Exceptions:
    """How to tell unknown customers, and which rows repeat an earlier one."""

    tag_customers: Callable[[DataFrame], DataFrame]
    repeated_rows: DataFrame


def tag_by_unknown(unknown: DataFrame, key: str = "customer_id") -> Callable[[DataFrame], DataFrame]:
    """Tagging by the list of keys without a registry entry."""
    listed = unknown.select(key).withColumn(KNOWN, F.lit(False))

    def tag(sales: DataFrame) -> DataFrame:
        return sales.join(listed, key, "left").withColumn(KNOWN, F.coalesce(KNOWN, F.lit(True)))

    return tag


def tag_by_registry(registry: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Tagging by a registry that was found small enough to broadcast."""
    return lambda sales: lookups.flag_known(sales, registry, small=True)


def repeat_suspects(sales: DataFrame, key: str = "order_id") -> DataFrame:
    """Hashes of keys seen more than once and how often, whether or not their rows are good.

    Reads the key column only and moves eight bytes per key; counts add up inside
    every task.  Which of these keys really repeat is settled exactly afterwards, so
    a key too many (or two keys with one hash) does no harm.
    """
    hashed = sales.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias(KEY_HASH))
    return hashed.groupBy(KEY_HASH).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_rows(
    sales: DataFrame,
    tag_customers: Callable[[DataFrame], DataFrame],
    suspects: DataFrame,
    rules: Sequence[Rule],
    order_by: Sequence[str] = ORDER,
    key: str = "order_id",
    small: bool = False,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Identities of good rows that come second or later within their key.

    ``small`` says the suspects were found small enough to broadcast: then only rows of
    suspect keys get as far as the rules.  Otherwise all rows do, which moves none of
    them, whereas finding those of suspect keys would shuffle the wide rows.  The good
    ones are looked at twice; ``stage`` stores their few columns, so that the rules run once.
    """
    few = sales.filter(F.col(key).isNotNull())
    if small:
        hashed = few.withColumn(KEY_HASH, F.xxhash64(key))
        few = hashed.join(F.broadcast(suspects.select(KEY_HASH)), KEY_HASH, "left_semi")
    checked = evaluate(tag_customers(few), rules)
    narrow = checked.filter(F.col(FAILED) == 0).select(*dict.fromkeys([key, *order_by]), ROW_ID)
    if stage is not None:
        narrow = stage(narrow, "good-suspects")
    return flag_repeats(narrow, key, order_by, F.lit(True)).filter(REPEAT).select(ROW_ID)


#: Columns of a list of rows that is kept as bits: the rows of a file in blocks, one bit each.
FILE, BLOCK, BITS = "_list_file", "_list_block", "_list_bits"
#: A block's rows and bytes, as Spark's bitmap functions have them; 64 more for its key and Java's headers, beside the path.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 4_096 + 64


def listed_rows(repeated: DataFrame, scale: Scale, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A stored list of row identities in the form in which ``judge_by_exceptions`` can best join it.

    A short list is broadcast as it is.  Of a long one, identities of file and position
    become one bit for each row of a block, which is far less; if those are small
    enough, they are broadcast.  What is larger than that is left to a shuffle.
    """
    if lookups.fits_broadcast(repeated, scale):
        return F.broadcast(repeated)
    identity = repeated.schema[ROW_ID].dataType
    if not isinstance(identity, T.StructType) or identity.names != ["file", "row"]:
        return repeated
    file, row = F.col(f"{ROW_ID}.file"), F.col(f"{ROW_ID}.row")
    placed = repeated.select(file.alias(FILE), _block(row).alias(BLOCK), _position(row).alias("at"))
    blocks = stage(placed.groupBy(FILE, BLOCK).agg(F.bitmap_construct_agg("at").alias(BITS)), "repeated-blocks")
    size = F.coalesce(F.sum(F.length(F.col(FILE).cast("string")) + F.lit(BLOCK_BYTES)), F.lit(0))
    rows, size = blocks.agg(F.count("*"), size).first()
    small = rows <= scale.broadcast_rows and size <= scale.broadcast_bytes
    return F.broadcast(blocks) if small else repeated


def _block(row: Column) -> Column:
    return F.floor(row / F.lit(BLOCK_ROWS))


def _position(row: Column) -> Column:
    return F.pmod(row, F.lit(BLOCK_ROWS).cast("bigint"))


def _bit(bits: Column, at: Column) -> Column:
    """Whether the bit is set; none is in a block that isn't there."""
    byte = F.ascii(F.decode(F.substring(bits, (at / 8).cast("int") + 1, 1), "ISO-8859-1"))
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def _with_listed(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``_listed``: whether a row is in the list, in either of its forms."""
    if BITS not in rows.columns:
        found = df.join(rows.withColumn("_listed", F.lit(True)), ROW_ID, "left")
        return found.withColumn("_listed", F.col("_listed").isNotNull())
    row = F.col(f"{ROW_ID}.row")
    here = (F.col(f"{ROW_ID}.file") == F.col(FILE)) & (_block(row) == F.col(BLOCK))
    return df.join(rows, here, "left").withColumn("_listed", _bit(F.col(BITS), _position(row))).drop(FILE, BLOCK, BITS)


def judge_by_exceptions(
    sales: DataFrame, exceptions: Exceptions, rules: Sequence[Rule]
) -> DataFrame:
    """Same verdicts as ``judge``, from the exceptions."""
    checked = evaluate(exceptions.tag_customers(sales), rules)
    tagged = _with_listed(checked, exceptions.repeated_rows)
    return conclude(tagged, rules, F.col("_listed")).drop("_listed")
