"""Declarative row rules: each is a name, a dimension and a condition a good row meets."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks import contract as C
from oreworks.config import Domains
from oreworks.functions import columns as X
from oreworks.operators.normalize import RAW

KNOWN = "_customer_known"
FAILED = "_failed"
RULES_PER_MASK = 63


@dataclass(frozen=True)
class Rule:
    name: str
    dimension: str
    about: str
    inputs: tuple[str, ...]
    holds: Column
    # A guarded rule is silent about NULL inputs, so that a missing value is
    # reported once, by its completeness rule.
    guarded: bool = True

    @property
    def passes(self) -> Column:
        verdict = F.coalesce(self.holds, F.lit(False))
        if not self.guarded:
            return verdict
        return null_guard(self.inputs, verdict)


def null_guard(inputs: Sequence[str], condition: Column) -> Column:
    """The condition, taken as met when any input is NULL."""
    missing = reduce(or_, [F.col(c).isNull() for c in inputs])
    return F.when(missing, F.lit(True)).otherwise(condition)


def completeness_rules(fields: Sequence[str], typed: bool = False) -> list[Rule]:
    """One rule per field.  Numbers and dates cannot be blank, so only text is trimmed.

    ``typed``: a number or date that came and did not parse is filled in; ``typing_rules`` report it.
    """

    def filled(field: str) -> Column:
        if field not in C.NATIVE_FIELDS:
            return X.has_value(field)
        there = F.col(field).isNotNull()
        return there | X.has_value(f"{RAW}.{field}") if typed else there

    return [
        Rule(f"{C.COMPLETENESS}.{f}", C.COMPLETENESS, f"{f} is filled in", (f,), filled(f), guarded=False)
        for f in fields
    ]


def typing_rules(fields: Sequence[str] = C.NATIVE_FIELDS) -> list[Rule]:
    """One rule per number or date: what came can be read as its type.

    Needs the values as they came (``normalize.type_sales(raw=True)``).  A missing value passes; completeness reports it.
    """
    return [
        Rule(
            f"{C.TYPING}.{f}", C.TYPING, f"{f} can be read as its type", (f,),
            F.col(f).isNotNull() | ~X.has_value(f"{RAW}.{f}"), guarded=False,
        )
        for f in fields
    ]


def member_flag(field: str) -> str:
    """Name of the column that says whether a field's value is in the field's set (see ``lookups.flag_members``)."""
    return f"_in_{field}"


def domain_rules(d: Domains, by_table: Collection[str] = ()) -> list[Rule]:
    """Sets, signs and the period.  Fields in ``by_table`` have their set in a table and are flagged already."""
    first, last = (F.to_date(F.lit(day)) for day in d.period)
    allowed = (
        (C.RULE_STATUS, "status", d.statuses),
        (C.RULE_PAYMENT, "payment_method", d.payments),
        (C.RULE_STATE, "shipping_state", d.states),
    )
    positive = (
        (C.RULE_QUANTITY, "quantity"),
        (C.RULE_UNIT_PRICE, "unit_price"),
        (C.RULE_TOTAL, "total_amount"),
    )
    return [
        *(
            Rule(n, C.DOMAIN, f"{f} is in its table", (f,), F.col(member_flag(f))) if f in by_table
            else Rule(n, C.DOMAIN, f"{f} is one of {list(v)}", (f,), F.col(f).isin(*v))
            for n, f, v in allowed
        ),
        *(Rule(n, C.DOMAIN, f"{f} is above zero", (f,), F.col(f) > 0) for n, f in positive),
        Rule(
            C.RULE_PERIOD, C.DOMAIN, f"order_date is within {d.period[0]} and {d.period[1]}",
            ("order_date",), F.col("order_date").between(first, last),
        ),
    ]


def consistency_rule(d: Domains) -> Rule:
    return Rule(
        C.RULE_CONSISTENCY, C.CONSISTENCY, f"total_amount is quantity x unit_price within {d.tolerance}",
        ("total_amount", "quantity", "unit_price"), total_matches(d.tolerance),
    )


def total_matches(tolerance: Decimal) -> Column:
    """|total - quantity x price| <= tolerance, decided on decimals.

    Most rows are nowhere near the limit, and there the cheaper binary difference
    already settles it: the slack is far above its error and above the sixth place
    at which the decimals are cut.
    """
    total, price, quantity = F.col("total_amount"), F.col("unit_price"), F.col("quantity")
    product = quantity * price
    gap = F.abs(total - product)
    slack = (F.abs(quantity) + 2) * 1e-6 + (F.abs(total) + F.abs(product)) * 1e-12
    moderate = (F.abs(total) < 1e11) & (F.abs(price) < 1e11)
    exact_product = F.try_multiply(X.money_or_null(price), quantity.try_cast("decimal(10,0)"))
    exact = F.abs(F.try_subtract(X.money_or_null(total), exact_product)) <= F.lit(tolerance)
    limit = F.lit(float(tolerance))
    # Amounts beyond any decimal are compared as they are.
    exact = F.coalesce(exact, gap <= limit)
    return F.when(moderate & (gap < limit - slack), F.lit(True)).when(
        moderate & (gap > limit + slack), F.lit(False)
    ).otherwise(exact)


def integrity_rule() -> Rule:
    return Rule(C.RULE_INTEGRITY, C.INTEGRITY, "customer_id is registered", ("customer_id",), F.col(KNOWN))


def sales_rules(
    d: Domains, only: Collection[str] | None = None, integrity: bool = True, by_table: Collection[str] = (),
    typed: bool = False,
) -> list[Rule]:
    """The rule set in its fixed order; ``only`` narrows it by name, ``typed`` adds the typing rules."""
    typing = typing_rules() if typed else []
    rules = [*completeness_rules(d.required, typed), *typing, *domain_rules(d, by_table), consistency_rule(d)]
    if integrity:
        rules.append(integrity_rule())
    return [r for r in rules if only is None or r.name in only]


def passes_all(rules: Sequence[Rule]) -> Column:
    return reduce(and_, [r.passes for r in rules], F.lit(True))


def failed_mask(rules: Sequence[Rule]) -> Column:
    """One bit per failed rule; 0 means the row passes all of them.

    A number is far cheaper per row than a list of names, and is all that the many
    good rows need.
    """
    bits = [F.when(r.passes, F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint") for i, r in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))


def _masks(rules: Sequence[Rule]) -> list[tuple[str, Sequence[Rule]]]:
    """Mask columns and their rules: one column for up to 63 rules, else one more for each 63."""
    parts = [rules[i : i + RULES_PER_MASK] for i in range(0, len(rules), RULES_PER_MASK)] or [rules]
    return [(FAILED, rules)] if len(parts) == 1 else [(f"{FAILED}_{k}", part) for k, part in enumerate(parts)]


def mask_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == FAILED or c.startswith(f"{FAILED}_")]


def failed_names(rules: Sequence[Rule]) -> Column:
    """Names behind the bits of the masks, in rule order."""
    names = [
        F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(r.name))
        for mask, part in _masks(rules) for i, r in enumerate(part)
    ]
    found = F.array_compact(F.array(F.lit(None).cast("string"), *names))
    return F.when(F.col(FAILED) == 0, F.array().cast("array<string>")).otherwise(found)


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the masks of failed rules; ``_failed`` is 0 for a row that passes all.

    The observed counts go to whoever listens to the query.  They also keep the
    rules where they are: Spark moves no filter below an observation, so a filter on
    the mask reads the computed column instead of running all rules a second time.
    """
    masks = _masks(rules)
    judged = df.withColumns({name: failed_mask(part) for name, part in masks})
    if len(masks) > 1:
        judged = judged.withColumn(FAILED, reduce(lambda a, b: a.bitwiseOR(b), [F.col(name) for name, _ in masks]))
    return judged.observe(
        f"rules-{uuid.uuid4().hex}", F.count("*").alias("rows"), F.count_if(F.col(FAILED) != 0).alias("failed")
    )


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``_reasons``: names of all failed rules, in rule order; empty for a good row."""
    return evaluate(df, rules).withColumn("_reasons", failed_names(rules)).transform(lambda d: d.drop(*mask_columns(d)))


def failure_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, failures) for each rule on its own, from one pass."""
    counted = df.agg(*[F.count_if(~r.passes).alias(r.name.replace(".", "__")) for r in rules])
    pairs = [
        F.struct(F.lit(r.name).alias("rule"), F.col(r.name.replace(".", "__")).alias("failures")) for r in rules
    ]
    return counted.select(F.inline(F.array(*pairs)))
