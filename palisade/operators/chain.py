"""The whole chain of tiers, stage by stage: each scorer meets just the rows that its gate asks for.

Rows are written once. A stage filters by what the stages before it have left, applies its scorer to (row, text), writes
what comes back, and folds it into the judgements, which are all that is written again: texts meet only the rows that ask. So a gate sees the verdict after the last fold, a scorer never runs on rows that need none, and
lost executors cost one stage. A scorer that fails gives an error in place of a score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Policy
from ..functions.scoring import enforced, hard_block, score_of, would_verdict
from ..sources.shared import written
from . import escalation as es

ROW = "_row"
_CALL = "struct<scorer:string,outcome:string>"
#: What is written once and stays behind, while a row's judgement goes from stage to stage.
_WIDE = ("_own", "text", "_passed")


@dataclass(frozen=True)
class Scorer:
    """``apply`` gets rows (_row, text, and what is passed) and gives (_row, score, error): one row for each, a score or an error.

    A score below ``min_confidence`` is told but weighs nothing; ``fail_mode`` overrides the policy's."""

    apply: Callable[[DataFrame], DataFrame]
    min_confidence: float = 0.0
    fail_mode: str | None = None


def _policy_of(policy: Policy, source: Column | None) -> tuple[Column, Column]:
    """Whether a row's source is skipped, and whether it always escalates."""
    if source is None:
        return F.lit(False), F.lit(False)
    named = {k: [s for s, v in policy.per_source.items() if v[k]] for k in (0, 1)}
    return tuple(F.coalesce(source.isin(named[k]), F.lit(False)) for k in (0, 1))


def _scored(df: DataFrame, texts: DataFrame | None, gate: Column, scorer: Scorer, name: str) -> DataFrame:
    """df with _asked, _score and _error of the rows that pass the gate. Their texts are df's own, or met by row in ``texts``."""
    asked = df.where(gate)
    # merged at any size, so that the work grows with the rows and none of them goes through the driver
    asked = (asked if texts is None else texts.join(asked.select(ROW).hint("merge"), ROW, "left_semi")).select(ROW, F.coalesce("text", F.lit("")).alias("text"), "_passed.*")
    found = written(scorer.apply(asked).select(ROW, F.col("score").cast("double").alias("_score"), F.col("error").cast("string").alias("_error")), f"chain-{name}")
    met = df.select(*[c for c in df.columns if c not in _WIDE]).join(found.withColumn("_asked", F.lit(True)), ROW, "left")
    # a score that is neither there nor wrong counts as a failure
    error = F.when(F.col("_asked") & F.col("_score").isNull(), F.coalesce("_error", F.lit("no score")))
    return met.withColumn("_error", error).withColumn("_score", F.when(F.col("_error").isNull(), F.col("_score"))).withColumn("_asked", F.coalesce("_asked", F.lit(False)))


def _folded(df: DataFrame, found: Column, risk: Column, policy: Policy, on: Column) -> DataFrame:
    """Rows ``on`` judged anew by their reasons and ``found``."""
    df = df.withColumn("reasons", F.when(on, F.concat("reasons", found)).otherwise(F.col("reasons")))
    would = would_verdict(score_of(F.col("reasons")), hard_block(F.col("reasons"), policy.hard_block_rules), policy, risk)
    return df.withColumn("score", F.when(on, score_of(F.col("reasons"))).otherwise(F.col("score"))).withColumn("would", F.when(on, would).otherwise(F.col("would")))


def _degraded(df: DataFrame, tier: int, closed: Column, risk: Column, policy: Policy, on: Column) -> DataFrame:
    """Rows ``on`` judged anew without the scorer that failed; failing closed takes them for high risk."""
    would = would_verdict(F.col("score"), hard_block(F.col("reasons"), policy.hard_block_rules), policy, risk | closed)
    failed = F.struct(F.lit(tier).alias("tier"), F.lit("degraded_mode").alias("reason"))
    return (
        df.withColumn("would", F.when(on, would).otherwise(F.col("would")))
        .withColumn("tier", F.when(on, tier).otherwise(F.col("tier")))
        .withColumn("degraded", F.when(on, failed).otherwise(F.col("degraded")))
    )


def _called(df: DataFrame, name: str) -> DataFrame:
    call = F.struct(F.lit(name).alias("scorer"), F.when(F.col("_error").isNull(), "scored").otherwise(F.col("_error")).alias("outcome")).cast(_CALL)
    return df.withColumn("calls", F.when(F.col("_asked"), F.array_append("calls", call)).otherwise(F.col("calls")))


def _staged(df: DataFrame, texts: DataFrame, name: str, gate: Column, scorer: Scorer, reason: Callable[[Column], Column], tier: int, risk: Column, policy: Policy, parallel: Column) -> DataFrame:
    """One stage. Rows in ``parallel`` only take the reason; they are judged when both their scorers are through."""
    df = _called(_scored(df, None if "text" in df.columns else texts, gate, scorer, name), name)
    weight = F.when(F.col("_score") < scorer.min_confidence, 0.0).otherwise(F.col("_score"))
    found, failed = es.reasons(reason(weight)), F.col("_error").isNotNull()
    closed = F.lit((scorer.fail_mode or policy.fail_mode) == "closed")
    df = df.withColumn("_late", F.when(parallel, F.concat("_late", found)).otherwise(F.col("_late")))
    df = df.withColumn("_failed", F.when(parallel & failed & F.col("_failed").isNull(), tier).otherwise(F.col("_failed")))
    alone = F.col("_asked") & ~parallel
    df = _folded(df, found, risk, policy, alone & ~failed).withColumn("tier", F.when(alone & ~failed, tier).otherwise(F.col("tier")))
    df = _degraded(df, tier, closed, risk, policy, alone & failed)
    return written(df.drop("_score", "_error", "_asked"), f"chain-after-{name}")


def staged_chain(
    df: DataFrame,
    policy: Policy,
    text: str = "sanitized",
    source: str | None = None,
    high_risk: str | None = None,
    ml: Scorer | None = None,
    embedding: Scorer | None = None,
    remote: Scorer | None = None,
    passed: list[str] | None = None,
) -> DataFrame:
    """Rows of guard() (reasons, score, would, text) -> those of all tiers: reasons, score, would, verdict,
    tier (of the last scorer that ran), degraded (tier, reason; null unless a scorer failed) and calls.

    * The classifier runs where the source always escalates, the verdict is flag, or it isn't allow at high risk;
      the embedding match where that holds after the classifier; the remote judge where what is left is flag, or at
      high risk. Of a source that is skipped nothing runs.
    * Where a source always escalates and both of the first two are there, they are folded together, and one that
      failed adds nothing, whatever the fail mode. Else a failure leaves the verdict as it is, or, failing closed,
      turns flag into block.
    * Scorers get the columns in ``passed`` too, a session's id for instance.
    * ``calls`` has (scorer, outcome) in order; ledger() adds them up. Other columns stay.
    """
    own = ["text", "reasons", "score", "would", "verdict", "tier", "degraded", "calls", "_late", "_failed"]
    kept = [c for c in df.columns if c not in own[1:]]
    risk_of = F.coalesce(F.col(high_risk), F.lit(False)) if high_risk else F.lit(False)
    skip, always = _policy_of(policy, F.col(source) if source else None)
    none = F.array().cast(df.schema["reasons"].dataType)
    held = df.select(
        F.struct(F.lit(True).alias("_any"), *[c for c in kept if c != text]).alias("_own"), F.monotonically_increasing_id().alias(ROW), F.col(text).alias("text"),
        "reasons", "score", "would", F.lit(0).alias("tier"), F.lit(None).cast("struct<tier:int,reason:string>").alias("degraded"),
        F.array().cast(f"array<{_CALL}>").alias("calls"), none.alias("_late"), F.lit(None).cast("int").alias("_failed"),
        F.struct(F.lit(True).alias("_any"), *(passed or [])).alias("_passed"), risk_of.alias("_risk"), skip.alias("_skip"), always.alias("_always"),
    )
    held = rows = written(held, "chain-rows")
    risk, asks = F.col("_risk"), ~F.col("_skip")
    both = F.col("_always") & asks & F.lit(ml is not None and embedding is not None)
    gate, last = asks & es.ml_gate(F.col("would"), F.col("_always"), risk), asks & es.remote_gate(F.col("would"), risk)
    texts = rows.where(gate | last)  # a row that neither asks for at first is never asked for
    if ml is not None:
        held = _staged(held, texts, "ml", gate, ml, es.ml_reason, 1, risk, policy, both)
    if embedding is not None:
        held = _staged(held, texts, "embedding", gate, embedding, es.embedding_reason, 2, risk, policy, both)
    if ml is not None and embedding is not None:
        held = _folded(held, F.col("_late"), risk, policy, both)
        ran = lambda code: F.exists("_late", lambda r: r["code"] == code)
        tier = F.when(ran("embedding_match"), 2).when(ran("ml_classifier"), 1).otherwise(F.col("tier"))
        failed = F.struct(F.col("_failed").alias("tier"), F.lit("degraded_mode").alias("reason"))
        held = held.withColumn("tier", F.when(both, tier).otherwise(F.col("tier"))).withColumn("degraded", F.when(F.col("_failed").isNotNull(), failed).otherwise(F.col("degraded")))
    if remote is not None:
        held = _staged(held, texts, "remote", last, remote, es.remote_reason, 2, risk, policy, F.lit(False))
    out = held if held is rows else rows.select(ROW, "_own", "text").join(held, ROW)
    out = out.withColumn("verdict", enforced(F.col("would"), policy.mode))
    return out.select(*[(F.col("text") if c == text else F.col("_own")[c]).alias(c) for c in kept], "reasons", "score", "would", "verdict", "tier", "degraded", "calls")


def ledger(df: DataFrame) -> DataFrame:
    """scorer, rows, scored, failed: what the calls of staged_chain() come to."""
    calls = df.select(F.explode("calls").alias("c")).select("c.*")
    scored = F.col("outcome") == "scored"
    return calls.groupBy("scorer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(scored).alias("scored"), F.count_if(~scored).alias("failed"))


def udf_scorer(load: Callable[[], Callable[[list[str]], list[float]]], tokens: int = es.CHUNK_TOKENS) -> Callable[[DataFrame], DataFrame]:
    """A Scorer's ``apply`` of a function on texts, by chunks; see classify()."""
    return lambda rows: es.classify(rows, load, ROW, "text", tokens).select(ROW, F.col("ml_score").alias("score"), F.col("ml_error").alias("error"))
