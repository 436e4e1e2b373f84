"""Evaluation of scored rows: confusion, curves, areas, percentiles, slices, samples, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import running_total
from .selection import floor_rank, nearest_rank, order_statistics


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def confusion(df: DataFrame, label: Column, positive: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn (of attack labels and positive verdicts)."""
    return df.groupBy(*by).agg(
        F.coalesce(count_if(label & positive), F.lit(0)).alias("tp"),
        F.coalesce(count_if(~label & positive), F.lit(0)).alias("fp"),
        F.coalesce(count_if(~label & ~positive), F.lit(0)).alias("tn"),
        F.coalesce(count_if(label & ~positive), F.lit(0)).alias("fn"),
    )


def share(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr, accuracy of a confusion table; empty denominators give 1, 1, 0, 0, 1."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    out = df.withColumn("precision", share(tp, tp + fp, 1.0)).withColumn("recall", share(tp, tp + fn, 1.0))
    p, r = F.col("precision"), F.col("recall")
    return (
        out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
        .withColumn("fpr", share(fp, fp + tn, 0.0))
        .withColumn("accuracy", share(tp + tn, tp + fp + tn + fn, 1.0))
    )


def range_of(df: DataFrame, column: str, parts: int = 256) -> Column:
    """The number of the range of ``column`` that a row is in, by approximate quantiles: bounds that are read once, so
    that all uses of a range agree. Nulls are in the first."""
    found = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 20_000)).first()[0] or []
    bounds = sorted(set(found))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))), F.lit(0)) if bounds else F.lit(0)


def curve(df: DataFrame, label: Column, score: str) -> DataFrame:
    """A row per distinct score, as a threshold that counts scores from it on as positive, and one above
    all: threshold, tp, fp, precision, recall, fpr.

    Scores are counted first; the running sums then go over distinct scores in two steps, within
    ranges of the score and over the ranges, so no task gets all rows.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(count_if(label).alias("p"), count_if(~label).alias("n"))
    ranged = counts.withColumn("part", range_of(counts, "threshold"))
    parts = ranged.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    above = parts.alias("a").join(parts.alias("b"), F.col("b.part") > F.col("a.part"), "left")  # a row per range
    above = above.groupBy(F.col("a.part").alias("part")).agg(
        F.coalesce(F.sum("b.pp"), F.lit(0)).alias("ap"), F.coalesce(F.sum("b.pn"), F.lit(0)).alias("an")
    )
    w = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.join(above, "part").select(
        "threshold", (F.sum("p").over(w) + F.col("ap")).alias("tp"), (F.sum("n").over(w) + F.col("an")).alias("fp")
    )
    total = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("all_p"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.max("threshold"), F.lit(0.0)).alias("top"))
    anchor = total.select((F.col("top") + 1).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    rows = sums.unionByName(anchor).crossJoin(total)  # one row: totals
    return rows.select(
        "threshold",
        "tp",
        "fp",
        share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
        share(F.col("tp"), F.col("all_p"), 1.0).alias("recall"),
        share(F.col("fp"), F.col("all_n"), 0.0).alias("fpr"),
    )


#: Parts of [0, 1] that a curve's points are dealt into.
PARTS = 1024


def area(points: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """One row: the trapezoid area under points ordered by x (from 0 to 1) and y. Points are ordered within parts of x;
    the gaps between parts are closed by each part's first and last point, so no task gets all points."""
    p = points.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct().withColumn("part", F.floor(F.col("x") * PARTS))
    w = Window.partitionBy("part").orderBy("x", "y")
    step = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    point = F.struct("x", "y")
    parts = p.withColumn("s", step).groupBy("part").agg(F.sum("s").alias("s"), F.min(point).alias("first"), F.max(point).alias("last"))
    over = Window.orderBy("part")  # at most PARTS + 1 rows
    before = F.lag("last").over(over)
    gap = (F.col("first.x") - before["x"]) * (F.col("first.y") + before["y"]) / 2
    return parts.withColumn("gap", gap).agg((F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum("gap"), F.lit(0.0))).alias(name))


def areas(curve_rows: DataFrame) -> DataFrame:
    """roc_auc and pr_auc, one row."""
    return area(curve_rows, "fpr", "recall", "roc_auc").crossJoin(area(curve_rows, "recall", "precision", "pr_auc"))  # one row each


def floor_percentile(df: DataFrame, column: str, share: float, by: list[str]) -> DataFrame:
    """by, value: the value at index floor(share * n) of each group's sorted values, counted from 0."""
    return order_statistics(df, column, by, {"value": floor_rank(share)})


def report(df: DataFrame, label: Column, score: str, at: float, fprs: tuple[float, ...] = (0.005, 0.01, 0.05)) -> DataFrame:
    """One row: n, confusion and rates at a threshold, areas, and the recall at each false-positive rate."""
    points = curve(df, label, score)
    out = rates(confusion(df, label, F.col(score) >= at)).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    out = out.crossJoin(areas(points))  # one row each
    for k in fprs:
        out = out.crossJoin(recall_at_fpr(points, k).select(F.col("recall").alias(f"recall_at_fpr_{k:g}".replace(".", "_"))))  # one row
    return out


def recall_at_fpr(curve_rows: DataFrame, most: float) -> DataFrame:
    """threshold, recall, fpr of the highest recall at that false-positive rate, the lowest threshold on ties."""
    fits = curve_rows.where(F.col("fpr") <= most)
    best = fits.agg(F.min_by(F.struct("threshold", "recall", "fpr"), F.struct(-F.col("recall"), F.col("threshold"))).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr")
    )


def latency(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """p50, p95, p99 (nearest rank), mean and max; a group without a value has nulls."""
    by = list(by)
    exact = order_statistics(df, column, by, {f"p{round(p * 100)}": nearest_rank(p) for p in (0.5, 0.95, 0.99)})
    rest = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.max(column).alias("max"))
    if not by:
        return rest.join(exact, F.lit(True), "left").select("p50", "p95", "p99", "mean", "max")  # one row each
    key = F.struct(F.lit(1), *by)
    named = exact.select(key.alias("_k"), "p50", "p95", "p99")
    return rest.withColumn("_k", key).join(named, "_k", "left").select(*by, "p50", "p95", "p99", "mean", "max")


def slices(df: DataFrame, label: Column, positive: Column, by: list[str], least: int) -> DataFrame:
    """Rates per slice with at least so many rows."""
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return rates(confusion(df, label, positive, by)).withColumn("n", total).where(F.col("n") >= least)


def even_sample(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Every floor(i * size / n)-th row of each stratum in the given order; strata are counted over ranges."""
    sizes = df.groupBy(F.struct(by).alias("_stratum")).agg(F.count(F.lit(1)).alias("_size"))
    numbered = running_total(df.withColumn("_one", F.lit(1)), [by], [order], "_one", "_i").drop("_one")
    numbered = numbered.withColumn("_stratum", F.struct(by)).join(sizes, "_stratum")
    slot = F.ceil(F.col("_i") * n / F.col("_size"))
    chosen = (F.floor(slot * F.col("_size") / n) == F.col("_i")) & (slot < n)
    return numbered.where((F.col("_size") <= n) | chosen).drop("_stratum", "_i", "_size")


def release_gates(df: DataFrame, recall: float = 0.9, hard_recall: float = 1.0, fpr: float = 0.01, over_defense: float = 0.05) -> DataFrame:
    """df: label (attack, benign, hard_negative), in_scope, hard, verdict -> rates and whether each gate passes."""
    caught, attack = F.col("verdict") != "allow", (F.col("label") == "attack") & F.col("in_scope")
    one = df.agg(
        share(count_if(attack & caught), count_if(attack), 1.0).alias("attack_recall"),
        share(count_if(attack & F.col("hard") & (F.col("verdict") == "block")), count_if(attack & F.col("hard")), 1.0).alias("hard_block_recall"),
        share(count_if((F.col("label") == "benign") & caught), count_if(F.col("label") == "benign"), 0.0).alias("benign_fpr"),
        share(count_if((F.col("label") == "hard_negative") & caught), count_if(F.col("label") == "hard_negative"), 0.0).alias("over_defense"),
    )
    passed = (F.col("attack_recall") >= recall) & (F.col("hard_block_recall") >= hard_recall) & (F.col("benign_fpr") < fpr) & (F.col("over_defense") < over_defense)
    return one.withColumn("passed", passed)
