"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate; each document's count inverts a Poisson
distribution at a uniform number hashed from its id, so it doesn't depend on partitions,
order or retries. Documents are exploded by their count and dealt out anew by a hash of
(id, copy), each part sorted by it: a global shuffle that can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: A source takes a share of the mix in proportion to its rows to this power.
EXPONENT = 0.5
#: Largest mean of one Poisson draw; a larger rate is the sum of several draws.
LARGEST_MEAN = 200.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of md5 over the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame,
    source_col: str = "source",
    weights: DataFrame | None = None,
    exponent: float = EXPONENT,
    target_ratio: float = 1.0,
) -> DataFrame:
    """A row per source: _source, rate (mean copies of a document), parts, cdf.

    ``weights`` (source, weight) gives target weights; a source it lacks has weight 0, weights
    below 0 or null count as 0. Without it a weight is the source's row count to the power
    ``exponent``. Null sources are one source of their own.
    """
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        weighted = counts.withColumn("_w", F.pow("_rows", F.lit(exponent)))
    else:
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.max("weight").alias("_weight"))
        weighted = counts.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").withColumn(
            "_w", F.greatest(F.coalesce(F.col("_weight").cast("double"), F.lit(0.0)), F.lit(0.0))
        )
    total = weighted.agg(F.sum("_w").alias("_all_w"), F.sum("_rows").alias("_all_rows"))
    rate = F.col("_all_rows") * target_ratio * F.col("_w") / F.col("_all_w") / F.col("_rows")
    rated = weighted.crossJoin(total).select(  # one row on the right: a scalar
        "_source", F.when(F.col("_all_w") > 0, rate).otherwise(0.0).alias("rate")
    )
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    return rated.withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / parts))


def poisson_cdf(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as far as 52 bits of a uniform number reach."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(s["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: DataFrame | None = None,
    exponent: float = EXPONENT,
    target_ratio: float = 1.0,
    seed: str = "mix-1",
) -> DataFrame:
    """All columns of ``docs`` and n_copies, copy (from 0), shuffle_key; in global shuffle order.

    * a document whose count is 0 has no row; a null id counts as the empty string.
    * rows with the same id (and source) get the same count; ties of shuffle_key can't occur
      between different ids and copies, short of md5 collisions.
    * texts are never looked at: empty, null and very long ones are carried whole.
    * columns of these three names in ``docs`` are replaced; all others stay, whatever their names.
      An empty table gives an empty one.

    The rates are written first, so that Spark knows their size: it broadcasts them below
    its threshold and otherwise joins by sorting, where adaptive execution splits hot sources.
    """
    own = ("n_copies", "copy", "shuffle_key")
    docs = docs.drop(*own)
    source, parts, cdf = fresh(docs, "_source", "_parts", "_cdf")
    rates = written(source_rates(docs, source_col, weights, exponent, target_ratio), "mix-rates").select(
        F.col("_source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)
    )
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draws = F.transform(
        F.sequence(F.lit(1), F.col(parts)),
        lambda i: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), key, i.cast("string")))),
    )
    counted = docs.join(rates, F.col(source_col).eqNullSafe(F.col(source))).withColumn(
        "n_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    )
    copies = (
        counted.where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn(
            "shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), key, F.col("copy").cast("string")))
        )
        .drop(source, parts, cdf)
    )
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixing_oracle(exponent: float = EXPONENT, target_ratio: float = 1.0, seed: str = "mix-1") -> str:
    """DuckDB SQL for mix_sources over ``documents`` (rates up to LARGEST_MEAN)."""
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    total AS (SELECT sum(pow(n, {exponent})) AS w, sum(n) AS n FROM counts),
    rates AS (SELECT source, total.n * {target_ratio}::DOUBLE * pow(counts.n, {exponent}) / total.w / counts.n AS rate
              FROM counts, total),
    cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
            UNION ALL
            SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
            WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
    drawn AS (SELECT *, ('0x' || substr(md5('{seed}:' || doc_id || ':1'), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u
              FROM documents),
    counted AS (SELECT d.doc_id, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u)::INTEGER AS n_copies
                FROM drawn d)
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.n_copies, r.copy::INTEGER AS copy,
           md5('{seed}/order:' || d.doc_id || ':' || r.copy) AS shuffle_key
    FROM documents d JOIN counted c USING (doc_id), LATERAL (SELECT unnest(range(c.n_copies)) AS copy) r
    """
