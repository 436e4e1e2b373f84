"""Tool calls: names against a list, arguments as JSON through the whole first tier, and data that is tainted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Policy
from ..sources.shared import written
from . import companions as cp
from .guard import guard


def arguments_text(calls: DataFrame, arguments: str) -> DataFrame:
    """Adds _arguments: strings as they are, anything else as JSON; no arguments are ``{}``."""
    kind = calls.schema[arguments].dataType.typeName()
    text = F.col(arguments) if kind == "string" else F.to_json(arguments) if kind in ("struct", "map", "array", "variant") else F.col(arguments).cast("string")
    return calls.withColumn("_arguments", F.coalesce(text, F.lit("{}")))


def judge_tool_calls(
    calls: DataFrame,
    allow: DataFrame,
    marks: DataFrame | None = None,
    name: str = "name",
    arguments: str = "arguments",
    policy: Policy | None = None,
) -> DataFrame:
    """calls with allowed, tainted, sources, reasons, score and verdict.

    A name that isn't in ``allow`` (column ``name``; null: nothing is asked of names) blocks, and its arguments aren't read.
    Arguments are judged as a tool's text at high risk; where they hold a mark (mark_seq, text, source) of untrusted
    text, that is one more reason. ``sources`` are those of the marks, by their first mark."""
    policy = policy or Policy()
    kept = [c for c in calls.columns if c not in ("allowed", "tainted", "sources", "reasons", "score", "verdict")]
    rows = arguments_text(calls.select(*kept), arguments).withColumn("_call", F.monotonically_increasing_id())
    rows = written(cp.tool_allowed(rows, allow, name), "tool-calls")
    asked = rows.where("allowed").select("_call", "_arguments", F.lit("tool").alias("_source"), F.lit(True).alias("_risk"))
    judged = guard(asked, "_arguments", source="_source", high_risk="_risk", policy=policy).select("_call", "reasons")
    met = rows.join(judged, "_call", "left")
    found = F.coalesce("reasons", F.array().cast(judged.schema["reasons"].dataType))
    sources = F.lit(None).cast("array<string>")
    if marks is not None:
        hits = cp.taint_matches(asked, marks, "_call", "_arguments")
        met = met.join(cp.taint_sources(hits).select(F.col("doc_id").alias("_call"), F.col("sources").alias("_sources")), "_call", "left")
        sources = F.col("_sources")
    met = met.withColumn("tainted", sources.isNotNull()).withColumn("sources", sources)
    met = met.withColumn("_v", cp.tool_verdict(F.col("allowed"), F.col("tainted"), found, policy))
    return met.select(*kept, "allowed", "tainted", "sources", *[F.col(f"_v.{c}").alias(c) for c in ("reasons", "score", "verdict")])
