"""URL filter: rules, and for the urls that no rule decides a character language model of accepted and rejected urls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreworks.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that the models tell apart: lower-case letters, one digit, these marks, and one for all others.
DIGITS, MARKS, OTHER = "0123456789", ":/.-_?=&#", "*"
START, END, ORDER = "^^^", "$", 3


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that decide, the longest first.
RULES = (
    Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "net", "/"),
)


@dataclass(frozen=True)
class Settings:
    """smoothing: occurrences that a shorter context's estimate counts for. size: of the alphabet, for unseen characters.

    small_grams: rows of the model up to which it is broadcast; its alphabet bounds it by 41**4 anyway.
    """

    smoothing: float = 2.0
    size: int = 41
    small_grams: int = 100_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both are empty for NULL and where there is no `://`."""
    rest = F.coalesce(_rest(url), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The name of the longest rule that holds for a host or its parent domain and the start of the path, else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """What the models read of a url. Urls that differ in digits only are one."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER + DIGITS, LOWER + "0" * 10)
    return F.concat(F.lit(START), F.regexp_replace(text, r"[^a-z0:/._?=&#\-]", OTHER), F.lit(END))


def _grams(texts: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("text") - ORDER))
    each = texts.withColumn("at", at)
    return each.withColumn("gram", F.substring(F.col("text"), F.col("at"), F.lit(ORDER + 1))).drop("at")


def model(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`gram, ratio` for every 4-gram of `texts` (`text, accepted, rejected` as counts).

    ratio is the difference of the two models' log probabilities of the gram's last character, in millionths. A model
    estimates it from the last 3, 2, 1 and 0 characters; each estimate is smoothed by the shorter one's. Counts are added up
    by text, then by gram, before anything is joined.
    """
    grams = stored(_grams(texts).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    kinds = ("accepted", "rejected")
    out = grams.select("gram")
    totals = grams.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).first()
    estimate = {k: F.lit(1.0 / settings.size) for k in kinds}
    for order in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        seen = grams.groupBy(tail.alias(f"tail{order}")).agg(*(F.sum(k).alias(f"{k}{order}") for k in kinds))
        out = out.withColumn(f"tail{order}", tail).join(seen, f"tail{order}")
        if order:
            context = F.substring("gram", ORDER + 1 - order, order)
            all_ = grams.groupBy(context.alias(f"context{order}")).agg(*(F.sum(k).alias(f"all_{k}{order}") for k in kinds))
            out = out.withColumn(f"context{order}", context).join(all_, f"context{order}")
        for k in kinds:
            every = F.col(f"all_{k}{order}") if order else F.lit(totals[k])
            estimate[k] = (F.col(f"{k}{order}") + settings.smoothing * estimate[k]) / (every + settings.smoothing)
    ratio = F.log(estimate["accepted"]) - F.log(estimate["rejected"])
    return out.select("gram", F.round(ratio * 1e6).cast("long").alias("ratio"))


def scores(texts: DataFrame, ratios: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`text, score`: the mean ratio of a text's characters, in millionths, rounded down."""
    grams = _grams(texts.select("text"))
    small = ratios.count() <= settings.small_grams
    joined = grams.join(F.broadcast(ratios) if small else ratios, "gram")
    return joined.groupBy("text").agg(F.floor(F.sum("ratio") / F.count("*")).cast("long").alias("score"))


def threshold(scored: DataFrame) -> Column:
    """Between the mean scores of accepted and rejected urls, as many standard deviations from either; 0 without both.

    From `score, accepted, rejected`. Sums are exact decimals, so their order doesn't matter.
    """
    wide = "decimal(38,0)"
    sums = scored.agg(*(
        F.sum(F.col(kind).cast(wide) * value).cast(wide).alias(f"{kind}_{k}")
        for kind in ("accepted", "rejected")
        for k, value in enumerate((F.lit(1).cast("decimal(1,0)"), F.col("score").cast("decimal(12,0)"),
                                   (F.col("score") * F.col("score")).cast("decimal(18,0)")))
    )).first()
    found = []
    for kind in ("accepted", "rejected"):
        n, one, two = (float(sums[f"{kind}_{k}"] or 0) for k in range(3))
        if not n:
            return F.lit(0.0)
        found.append((one / n, max(two / n - (one / n) ** 2, 1.0) ** 0.5))
    (yes, yes_spread), (no, no_spread) = found
    return F.lit((yes * no_spread + no * yes_spread) / (yes_spread + no_spread))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, settings: Settings = Settings()) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` for each row of `pages` (`page_id, url`).

    A rule decides; else the verdict is allow if the score reaches the threshold. Urls that rules decide are the examples
    of the two models. A NULL or malformed url has an empty host and path and is judged by what text it has. Rows and ids
    may repeat, ids may be NULL; equal urls get equal verdicts. Without examples of both kinds the threshold is 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), folded(F.col("url")).alias("text"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for rule in rules:
        decided = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(decided)
    rows = rows.withColumn("decided", decided)
    count = lambda verdict, name: F.count(F.when(F.col("decided") == verdict, 1)).alias(name)
    texts = stored(rows.groupBy("text").agg(count("allow", "accepted"), count("block", "rejected")))
    found = scores(texts, stored(model(texts, settings)), settings)
    scored = stored(texts.join(found, "text"))
    method = F.when(F.col("score") >= threshold(scored), "allow").otherwise("block")
    return rows.join(scored.select("text", "score"), "text").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score"
    )
