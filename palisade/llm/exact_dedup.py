"""Exact dedup: 128-bit content hash groups, smallest id stays, bytes compared inside groups.

Texts are equal when identical after each run of ASCII white space becomes one space.
The narrow fingerprint table decides the groups; whole texts move once, and only rows of
groups with more than one member go on to the byte comparison. There the text that stays is
copied to as many salts as the group needs, so a group with a third of all rows is compared
by many tasks. Rows that differ from their keeper (a hash collision) are grouped anew by
hash and text. Rows meet their group by a shuffle; those of the groups that hold over one in
HOT of all rows, which are fewer than HOT groups, meet it by a broadcast and are spread evenly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, text_of, written

#: A group with more than this part of all rows is hot.
HOT = 2000
#: Keys that the rows of hot groups are spread over.
SPREAD = 4096
#: Rows of a group that are compared with one copy of the keeper's text.
SALT_ROWS = 256


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * null text counts as empty; empty texts form a group like any other.
    * ties: the smallest id of a group stays. Repeated rows with one id count as members, and
      each of them has ``kept`` where that id is the group's smallest.
    * a null id never stays beside a known one; a group of null ids only has a null keep_id
      and keeps none. ``kept`` is never null.
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    # numbers that tell rows of one id, or of none, apart spread the hot groups
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"), F.monotonically_increasing_id().alias("_row"))
    hashed = source.withColumn("_h", content_hash(F.col("_norm")))
    prints = written(
        hashed.select("doc_id", "_row", "_h", F.sha2("_norm", 256).alias("text_sha256")), "exact-prints"
    )
    groups = prints.groupBy("_h").agg(
        F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    groups = written(groups.where("_n > 1"), "exact-groups")
    hot = groups.where(F.col("_n") > F.lit(max(prints.count() // HOT, 1)))
    wrong = _collisions(_with_groups(hashed, groups, hot).where("_n is not null"))
    rows = _with_groups(prints, groups, hot)
    rows = rows.withColumn("_keep", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))).withColumn("_n", F.coalesce("_n", F.lit(1)))
    keep, size = F.col("_keep"), F.col("_n")
    if not wrong.isEmpty():
        again = wrong.groupBy("_h", F.sha2("_norm", 256).alias("text_sha256"), "_norm").agg(
            F.min("doc_id").alias("_keep2"), F.count(F.lit(1)).alias("_n2")
        )
        less = wrong.groupBy("_h").agg(F.count(F.lit(1)).alias("_less"))
        rows = rows.join(again.drop("_norm"), ["_h", "text_sha256"], "left").join(less, "_h", "left")
        keep = F.when(F.col("_n2").isNull(), keep).otherwise(F.col("_keep2"))
        size = F.coalesce("_n2", size - F.coalesce("_less", F.lit(0)))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def _with_groups(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """With _keep and _n of each row's group, null where it is alone."""
    near = F.broadcast(hot.select(F.col("_h").alias("_hot"), F.col("_keep").alias("_hot_keep"), F.col("_n").alias("_hot_n")))  # under HOT rows
    spread = F.concat(F.lit("hot "), F.pmod(F.xxhash64("_row"), F.lit(SPREAD)).cast("string"))
    keyed = rows.join(near, F.col("_h") == F.col("_hot"), "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_h")).otherwise(spread))
    # merged at every size: broadcasting small sets of groups would only make runs differ
    met = keyed.join(groups.withColumnRenamed("_h", "_key").hint("merge"), "_key", "left")
    keep = F.when(F.col("_hot").isNull(), F.col("_keep")).otherwise(F.col("_hot_keep"))
    return met.select(*rows.columns, keep.alias("_keep"), F.coalesce("_hot_n", "_n").alias("_n"))


def _collisions(members: DataFrame) -> DataFrame:
    """Members (with _keep, _n) whose text isn't the keeper's: doc_id, _h, _norm. Nearly always empty."""
    members = written(members, "exact-members")
    salts = F.ceil(F.col("_n") / SALT_ROWS).cast("int")
    keepers = (
        members.where(F.col("doc_id").eqNullSafe(F.col("_keep")))
        .groupBy("_h", "_n")
        .agg(F.min("_norm").alias("_kept_norm"))
        .select("_h", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), "_kept_norm")
    )
    dealt = members.select(
        "doc_id", "_h", "_norm", F.pmod(F.xxhash64("_row"), salts).cast("int").alias("_salt")
    )
    # left join: where a group has null ids only, its keeper is found by the null-safe test above
    found = dealt.join(keepers, ["_h", "_salt"]).where("_norm <> _kept_norm")
    return written(found.select("doc_id", "_h", "_norm"), "exact-collisions")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the smallest id, nulls last; of
    rows with one id the one whose columns hash to less, and of wholly repeated rows one. Null texts count as
    empty, and of all empty texts one row stays."""
    one, other, key, n = fresh(docs, "_one", "_other", "_row", "_n")
    cols = [F.to_json(F.struct(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in docs.schema]
    nulls = [F.col(c).isNull() for c in docs.columns]
    rows = docs.withColumns({one: F.xxhash64(F.lit(1), *cols, *nulls), other: F.xxhash64(F.lit(2), *cols, *nulls)})  # 128 bits tell rows apart
    keyed = rows.withColumn(key, F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col(one).alias("one"), F.col(other).alias("other")))
    kept = exact_dedup(keyed, key, text_col).where("kept").groupBy(F.col("doc_id.one").alias(one), F.col("doc_id.other").alias(other))
    stay = written(kept.agg(F.count(F.lit(1)).alias(n)), "exact-kept")
    out = rows.join(stay.where(F.col(n) == 1).hint("merge"), [one, other], "left_semi")
    repeated = stay.where(F.col(n) > 1)
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated.hint("merge"), [one, other], "left_semi").dropDuplicates([one, other]))
    return out.drop(one, other)
