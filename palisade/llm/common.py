"""What several operators share: reading tables, the shared folder, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of this package defines it (Java regular expression).
SPACES = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) is a folder made and set.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # several processes, local-cluster too
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='palisade-')}"
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The table is left for the job's owner to clean together with the checkpoint folder,
    as lazily evaluated results may read it at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # what led to the table isn't read again: free its shuffle files
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as keep them apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    """How many parts the owner of the session wants data to be dealt into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
