"""Where the metrics of checks go: to a callback, once for a batch job and once for each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[dict], None]


def check_metrics(verdict: str = "verdict", would: str = "would", score: str = "score", reasons: str = "reasons") -> list[Column]:
    """What is told of some checks: their number, verdicts, shadowed ones, scores and reasons. None hangs on order."""
    named = [F.count_if(F.col(verdict) == v).alias(v) for v in ("allow", "flag", "block")]
    return [
        F.count(F.lit(1)).alias("checks"), *named, F.count_if(F.col(verdict) != F.col(would)).alias("shadowed"),
        F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.sum(F.size(reasons)).alias("reasons"),
    ]


def observed(df: DataFrame, name: str = "checks", **columns: str) -> tuple[DataFrame, Observation]:
    """df, and what is told of its rows when an action has run through it: no pass of its own is needed."""
    observation = Observation(name)
    return df.observe(observation, *check_metrics(**columns)), observation


def told(df: DataFrame, sink: Sink, write: Callable[[DataFrame], None], **columns: str) -> None:
    """Writes df and hands the metrics of what was written to ``sink``."""
    rows, observation = observed(df, **columns)
    write(rows)
    sink(dict(observation.get))


def stream_to(stream: DataFrame, sink: Callable[[int, dict], None], checkpoint: str, write: Callable[[DataFrame], None], once: bool = False, **columns: str) -> StreamingQuery:
    """Starts a query that writes each micro-batch and hands its number and metrics to ``sink``: again with the same number,
    if a batch is repeated after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        told(batch, lambda metrics: sink(number, metrics), write, **columns)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
