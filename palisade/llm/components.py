"""Connected components of a link table, by contraction within tasks, then by alternating stars.

A large star ties a vertex's larger neighbours to the least of its neighbours and itself; a small star ties
its smaller ones, and itself, to it. Both keep what is connected, and by turns they leave each component as
one star around its least vertex, in a number of rounds that grows with the logarithm of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Links that a part of a round holds; a table of few links isn't dealt into many parts.
PART_LINKS = 500_000
LEAST_PARTS = 12
#: Links that a task contracts at once.
RUN_LINKS = 1_000_000
_PARTITIONS = "spark.sql.shuffle.partitions"
_LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a > b, that connect what the given ones connect: each vertex with the least it reaches by them."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(one):
        one, other = root[one], root[other]
        apart = one != other
        one, other = one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(up := root[root], root):
            root = up
    tied = root != np.arange(len(names))
    return names[tied], names[root[tied]]


def _contracted(run: int):
    """A task's links as a forest, a run of links at a time."""

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        links = np.concatenate(held, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*links)], ["a", "b"])

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
            n += batch.num_rows
            if n >= run:
                made_now = made(held)
                held, n = [np.stack([c.to_numpy() for c in made_now.columns])], made_now.num_rows
                if 2 * n > run:
                    yield made_now
                    held, n = [], 0
        if held:
            yield made(held)

    return contracted


@contextmanager
def _parts_for(spark: SparkSession, links: int):
    """Shuffles of so many links in as many parts as these need, whatever the session takes for documents."""
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(max(LEAST_PARTS, -(-links // PART_LINKS))))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """The same, of links with a > b."""
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = links.join(least, F.col("a") == F.col("u"))
    tied = tied.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
    return tied.select("l.a", "l.b").where("a <> b").distinct()


def components(links: DataFrame, run: int = RUN_LINKS) -> DataFrame:
    """links (a, b), in either direction and with repeats -> (id, component): the least id reachable.

    Each task contracts the links it reads to a forest, ``run`` links at a time; what is left meets in fewer
    tasks, as long as that helps, and at last in one, if it is a run at most. No shuffle is needed for that.
    More links than that take rounds of stars, which end when each vertex but the centres has one link, to a
    centre. Each table is written, so that lost executors cost a round at most. Vertices without a link don't appear; null ends are ignored. A vertex with
    very many links is joined by sorting, where adaptive execution splits it.
    """
    known = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars = written(known.mapInArrow(_contracted(run), _LINK), "links")
    n, before = stars.count(), math.inf
    while run < n < 0.8 * before:  # runs of several tasks in one
        stars = written(stars.coalesce(-(-n // run)).mapInArrow(_contracted(run), _LINK), "links")
        before, n = n, stars.count()
    stars = written(stars.coalesce(1).mapInArrow(_contracted(run), _LINK), "links") if n <= run else _starred(stars, run)
    centres = stars.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(centres)


def _starred(stars: DataFrame, run: int) -> DataFrame:
    """Links of any number as stars, by rounds of shuffles."""
    spark = stars.sparkSession
    while True:
        with _parts_for(spark, stars.count()):
            if _settled(stars):
                return stars
            stars = written(_small_star(_large_star(stars.mapInArrow(_contracted(run), _LINK).distinct())), "links")


def _settled(stars: DataFrame) -> bool:
    """Whether no vertex has two links to smaller ones, or one from a larger and one to a smaller vertex."""
    ends = stars.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        stars.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()
