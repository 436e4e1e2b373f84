"""A cache of verdicts across batches: a bucketed table that is met by key and written back.

The key is a text's matching copy with what else a verdict hangs on: source, risk and locale. Of a batch, each key that
the table doesn't know is judged once; rows of one key share its verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS = 64


def verdict_key(matching: Column, source: Column, high_risk: Column, locale: Column) -> Column:
    """256 bits; a missing source is a user's, a missing risk or locale is none."""
    parts = (F.coalesce(source, F.lit("user")), F.coalesce(high_risk, F.lit(False)).cast("string"), F.coalesce(locale, F.lit("")), F.coalesce(matching, F.lit("")))
    lengths = [F.octet_length(p).cast("string") for p in parts]  # so that no part can pass for two
    return F.sha2(F.concat_ws(":", *lengths, *parts), 256)


class VerdictStore:
    """Rows (key, bucket, at, and what a verdict has) in Parquet, a folder for each bucket. Entries are only added;
    of a key that two runs added at once the earlier one counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def entries(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def known(self, keys: DataFrame) -> DataFrame | None:
        """The entries of ``keys`` (key, bucket). Reads their buckets only; the keys filter what is read there."""
        held = self.entries()
        if held is None:
            return None
        there = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # no more than there are buckets
        found = held.where(F.col("bucket").isin(there)).join(keys.select("key").distinct(), "key", "left_semi")
        values = [c for c in held.columns if c not in ("key", "bucket", "at")]
        return found.groupBy("key").agg(F.min_by(F.struct(*values), "at").alias("v")).select("key", "v.*")

    def add(self, entries: DataFrame) -> None:
        """entries (key, ...)"""
        rows = entries.withColumn("at", F.current_timestamp()).withColumn("bucket", self.bucket(F.col("key")))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def compacted(self, path: str) -> VerdictStore:
        """A copy with one entry a key and one file a bucket; the old table can go when no reader has it any more."""
        to = VerdictStore(self.spark, path, self.buckets)
        held = self.entries()
        if held is not None:
            values = [c for c in held.columns if c != "key"]
            one = held.groupBy("key").agg(F.min_by(F.struct(*values), "at").alias("v")).select("key", "v.*")
            one.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return to


def cached_verdicts(
    df: DataFrame,
    store: VerdictStore,
    judge: Callable[[DataFrame], DataFrame],
    matching: str = "matching",
    source: str | None = None,
    high_risk: str | None = None,
    locale: str | None = None,
) -> DataFrame:
    """df with what ``judge`` adds to a row, and cached: whether the store knew the verdict before.

    ``judge`` gets one row of each new key, with a column ``key``, and has to keep it. What it adds must hang on
    the key's parts only, as all rows of the key get it."""
    none = F.lit(None).cast("string")
    made = verdict_key(F.col(matching), F.col(source) if source else none, F.col(high_risk) if high_risk else F.lit(False), F.col(locale) if locale else none)
    keyed = written(df.withColumn("key", made), "verdict-rows")
    keys = written(keyed.select("key").distinct().withColumn("bucket", store.bucket(F.col("key"))), "verdict-keys")
    known = store.known(keys)
    if known is not None:
        known = written(known, "verdict-known")
    new = keys if known is None else keys.join(known.select("key"), "key", "left_anti")
    rows = keyed.join(new.select("key"), "key", "left_semi").dropDuplicates(["key"])
    judged = judge(rows)
    added = [c for c in judged.columns if c not in keyed.columns]
    fresh = written(judged.select("key", *added), "verdict-new")
    if not fresh.isEmpty():
        store.add(fresh)
    told = fresh.withColumn("cached", F.lit(False))
    if known is not None:
        told = told.unionByName(known.select("key", *added).withColumn("cached", F.lit(True)))
    return keyed.join(told, "key").select(*df.columns, *added, "cached")
