"""Exact order statistics of groups of any size, by narrowing ranges.

Values are counted once. For each sought place a range of values is kept that holds it, with the place within the range. A
round splits the ranges that hold too many different values at approximate quantiles, adds up the rows of each part, and
keeps the part with the place; a range of at most MOST values is sorted and read. So no task sorts a group,
and what meets in one place are MOST values at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Different values of a range that are read at once; parts of a range that holds more.
MOST, PARTS = 4096, 64


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """Place of the least value that ``share`` of all values don't exceed, from 0."""
    return lambda n: F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0)).cast("long")


def floor_rank(share: float) -> Callable[[Column], Column]:
    """floor(share * n), and the last place at most."""
    return lambda n: F.least(F.floor(n * F.lit(share)), n - 1).cast("long")


def order_statistics(df: DataFrame, column: str, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and a column for each of ``places``, which tell the place of the sought value among n sorted ones.

    Null values don't count; a group without a value has no row; null keys are a group. NaN is the largest value."""
    group = F.struct(F.lit(1).alias("_"), *by)
    counted = df.where(F.col(column).isNotNull()).groupBy(group.alias("_g"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = written(counted, "select-values")
    groups = counted.groupBy("_g").agg(F.sum("_n").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_many"))
    sought = F.array(*[F.struct(F.lit(k).alias("_name"), at(F.col("n")).alias("_k")) for k, at in places.items()])
    ranges = groups.select("_g", F.explode(sought).alias("s"), "_low", "_high", "_many").select("_g", "s.*", "_low", "_high", "_many")
    ranges = written(ranges, "select-ranges")
    while not (wide := ranges.where(F.col("_many") > MOST)).isEmpty():
        ranges = written(ranges.where(F.col("_many") <= MOST).unionByName(_narrowed(counted, wide)), "select-ranges")
    rows = _within(counted, ranges).groupBy("_g", "_name", "_k").agg(F.sort_array(F.collect_list(F.struct("_v", "_n"))).alias("_all"))
    running = rows.withColumn("_at", _first_beyond(F.col("_all"), F.col("_k")))
    found = running.select("_g", "_name", F.col("_all")[F.col("_at")]["_v"].alias("_value"))
    out = found.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == k, F.col("_value"))).alias(k) for k in places])
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in by], *places)


def _first_beyond(values: Column, place: Column) -> Column:
    """Index of the first value up to which more rows than ``place`` lie."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at"))

    def step(state: Column, x: Column) -> Column:
        seen = state["seen"] + x["_n"]
        return F.struct(seen.alias("seen"), F.when(seen <= place, state["at"] + 1).otherwise(state["at"]).alias("at"))

    return F.aggregate(values, start, step)["at"]


def _within(counted: DataFrame, ranges: DataFrame) -> DataFrame:
    return ranges.join(counted, "_g").where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _narrowed(counted: DataFrame, wide: DataFrame) -> DataFrame:
    """The part of each range that holds its place."""
    rows = _within(counted, wide).select("_g", "_name", "_k", "_v", "_n")
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    pivots = rows.groupBy("_g", "_name").agg(F.percentile_approx("_v", shares, F.lit(100 * PARTS)).alias("_pivots"))
    part = F.size(F.filter("_pivots", lambda p: p < F.col("_v")))
    parts = rows.join(pivots, ["_g", "_name"]).groupBy("_g", "_name", "_k", part.alias("_part"))
    parts = parts.agg(F.sum("_n").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_many"))
    before = F.sum("n").over(Window.partitionBy("_g", "_name").orderBy("_part")) - F.col("n")  # PARTS rows at most
    held = parts.withColumn("_before", before).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("n")))
    return held.select("_g", "_name", (F.col("_k") - F.col("_before")).alias("_k"), "_low", "_high", "_many")
