"""Multi-turn risk in batch: windows over a conversation's turns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cf
from ..functions import regexlib as rx
from ..functions.scoring import enforced, rank, reason, reasons, verdict_of_rank
from .folds import Decayed, ordered_fold


#: What is left of a score that doesn't count any more, and turns that a window may look back to until then.
LOST, FRAME = 1e-19, 400


def many_shot_weight(text: Column, threshold: int = cf.SESSION_MANY_SHOT) -> Column:
    """Null below the threshold of role markers."""
    n = F.least(F.lit(201), rx.count(text, rx.ROLE_MARKERS))
    return F.when(n >= threshold, F.least(F.lit(0.85), 0.5 + 0.04 * (n - threshold)))


def cumulative(df: DataFrame, keys: list[str], order: str, score: str, decay: float = cf.SESSION_DECAY) -> DataFrame:
    """Adds ``cumulative``: c(n) = decay * c(n-1) + score(n).

    A window looks back until a score has decayed below the last digit, which takes 196 turns by default; a slower decay
    is folded in order (see folds.py)."""
    back = math.ceil(math.log(LOST) / math.log(decay)) if 0 < decay < 1 else 1 if decay == 0 else FRAME + 1
    if back > FRAME:
        return ordered_fold(df, keys, [order], Decayed(score, "cumulative", decay))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, 0)
    so_far = F.collect_list(F.coalesce(F.col(score), F.lit(0.0))).over(w)
    return df.withColumn("cumulative", F.aggregate(so_far, F.lit(0.0), lambda c, s: c * decay + s))


def session_signals(
    df: DataFrame, keys: list[str], order: str, score: str = "score", text: str | None = None
) -> DataFrame:
    """Adds cumulative, w_many, w_cumulative and w_escalation (null where a signal is silent)."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = cumulative(df, keys, order, score)
    over = F.col("cumulative") - cf.SESSION_CUMULATIVE
    rise = F.col(score) - F.lag(score).over(w)
    return (
        out.withColumn("w_many", many_shot_weight(F.col(text)) if text else F.lit(None).cast("double"))
        .withColumn("w_cumulative", F.when(over >= 0, F.least(F.lit(0.8), 0.4 + over * 0.8)))
        .withColumn("w_escalation", F.when(rise >= cf.SESSION_DELTA, F.least(F.lit(0.85), 0.45 + rise * 0.5)))
    )


def session_fold(
    df: DataFrame, score: str = "score", would: str = "would", mode: str = "enforce", flag: float = cf.FLAG, block: float = cf.BLOCK
) -> DataFrame:
    """Adds session_score, session_would and session_verdict; a verdict never falls below the turn's own."""
    left = F.lit(1.0) - F.col(score)
    for k in ("w_many", "w_cumulative", "w_escalation"):
        left = left * (1.0 - F.coalesce(F.col(k), F.lit(0.0)))
    signalled = F.coalesce("w_many", "w_cumulative", "w_escalation").isNotNull()
    total = F.when(signalled, 1.0 - left).otherwise(F.col(score))
    own = F.when(total >= block, "block").when(total >= flag, "flag").otherwise("allow")
    folded = F.when(signalled, verdict_of_rank(F.greatest(rank(F.col(would)), rank(own)))).otherwise(F.col(would))
    return df.withColumn("session_score", total).withColumn("session_would", folded).withColumn(
        "session_verdict", enforced(F.col("session_would"), mode)
    )


def session_reasons() -> Column:
    """The signals of session_signals() as reasons."""
    named = (("manyshot_density", "structural", "w_many"), ("cumulative_risk", "semantic", "w_cumulative"), ("session_escalation", "semantic", "w_escalation"))
    return reasons(*[F.when(F.col(c).isNotNull(), reason(code, category, F.col(c))) for code, category, c in named])


def live_state(turns: DataFrame, key: str, ts: str, score: str, resets: DataFrame | None = None) -> DataFrame:
    """The state that is kept of each key: last turn's time and score, decayed sum and number of turns since its last
    reset (key, ts); a key without a turn since has none."""
    if resets is not None:
        last = resets.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_reset"))
        turns = turns.join(last, F.col(key).eqNullSafe(F.col("_k")), "left").where(F.col("_reset").isNull() | (F.col(ts) > F.col("_reset"))).drop("_k", "_reset")
    latest = cumulative(turns.select(key, ts, score), [key], ts, score)
    return latest.groupBy(key).agg(
        F.max(ts).alias("last_ts"), F.max_by(score, ts).alias("last_score"), F.max_by("cumulative", ts).alias("cumulative"), F.count(F.lit(1)).alias("n_turns")
    )


def sessions_by_gap(df: DataFrame, key: str, ts: str, seconds: int = cf.SESSION_TTL_SECONDS) -> DataFrame:
    """Adds session_no: a new session starts after a gap longer than ``seconds``."""
    w = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    starts = F.when(gap > seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def last_turns(turns: Column, most: int = cf.SESSION_TURNS) -> Column:
    return F.slice(turns, F.greatest(F.size(turns) - (most - 1), F.lit(1)), most)


def stream_prefixes(df: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """Adds ``buffer``: all chunks of a stream so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("buffer", F.array_join(F.collect_list(F.coalesce(F.col(chunk), F.lit(""))).over(w), ""))


def worst_so_far(df: DataFrame, key: str, order: str, verdict: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("worst", verdict_of_rank(F.max(rank(F.col(verdict))).over(w)))
