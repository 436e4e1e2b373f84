"""Evidence to score to verdict, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Policy

REASON = "code string, category string, weight double, hard boolean, start int"


def reason(code: str, category: str, weight: Column, hard: bool = False, start: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(category).alias("category"),
        clamp01(weight).alias("weight"),
        F.lit(hard).alias("hard"),
        (start if start is not None else F.lit(None)).cast("int").alias("start"),
    )


def reasons(*found: Column) -> Column:
    """An array of the reasons that aren't null, in the given order."""
    return F.array_compact(F.array(*found)).cast(f"array<struct<{REASON.replace(' ', ':').replace(',:', ',')}>>")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def clamp01(c: Column) -> Column:
    return F.greatest(F.least(c.cast("double"), F.lit(1.0)), F.lit(0.0))


def noisy_or(weights: Column) -> Column:
    """1 - prod(1 - w), in the array's order."""
    return 1.0 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1.0 - clamp01(w)))


def score_of(found: Column) -> Column:
    return noisy_or(F.transform(found, lambda r: r["weight"]))


def hard_block(found: Column, rules: tuple[str, ...] | bool) -> Column:
    if rules is True:
        return F.exists(found, lambda r: r["hard"])
    return F.exists(found, lambda r: r["hard"] & r["code"].isin(list(rules or ())))


def would_verdict(score: Column, hard: Column, policy: Policy, high_risk: Column | None = None) -> Column:
    base = (
        F.when(hard | (score >= policy.block), "block").when(score >= policy.flag, "flag").otherwise("allow")
    )
    risky = F.coalesce(high_risk, F.lit(False)) if high_risk is not None else F.lit(False)
    return F.when(risky & (base == "flag"), "block").otherwise(base)


def enforced(would: Column, mode: str) -> Column:
    if mode == "shadow":
        return F.lit("allow")
    if mode == "soft":
        return F.when(would == "block", "flag").otherwise(would)
    return would


def rank(verdict: Column) -> Column:
    return F.when(verdict == "block", 2).when(verdict == "flag", 1).otherwise(0)


def verdict_of_rank(r: Column) -> Column:
    return F.when(r >= 2, "block").when(r == 1, "flag").otherwise("allow")
