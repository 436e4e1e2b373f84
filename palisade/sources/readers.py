"""Labelled corpora: JSON files, directories routed by file name, first-comma CSV, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import running_total

#: A labelled corpus entry.
ENTRY = (
    "id string, text string, label string, category string, source string, locale string, "
    "expect string, hardBlock boolean, outOfScope boolean, notes string"
)
BENCH = "id string, text string, label string, category string, sourceDataset string"


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries of files {name, version, entries}, with the file's corpus name. The schema is fixed, never inferred."""
    files = spark.read.schema(f"name string, version int, entries array<struct<{_fields(ENTRY)}>>").option("multiLine", True).json(list(paths))
    return files.select(F.col("name").alias("corpus"), F.inline("entries"))


def _fields(schema: str) -> str:
    return ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))


def read_bench(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a folder's JSON files, routed by file name: attacks_*, benign_*, notinject; others are skipped."""
    rows = spark.read.schema(BENCH).option("multiLine", True).json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(attacks|benign|notinject)(?:_.*)?\.json$", 1)
    return rows.withColumn("role", name).where("role <> ''")


def read_first_comma_csv(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, target) of lines that are split at their first comma; the header goes, quotes are stripped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    unquote = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    cut = F.instr("value", ",")
    split = lines.select(
        unquote(F.when(cut > 0, F.substring("value", F.lit(1), cut - 1)).otherwise(F.col("value"))).alias("prompt"),
        unquote(F.when(cut > 0, F.substring("value", cut + 1, F.length("value"))).otherwise("")).alias("target"),
    )
    return split.where(~((F.col("prompt") == "goal") & (F.col("target") == "target")))


def labelled(df: DataFrame, text: Column, label: str, category: str, dataset: str) -> DataFrame:
    """Non-blank texts as (text, label, category, sourceDataset)."""
    return df.where(F.trim(text) != "").select(
        text.alias("text"), F.lit(label).alias("label"), F.lit(category).alias("category"), F.lit(dataset).alias("sourceDataset")
    )


def sequence_ids(df: DataFrame, prefix: str, order: str, dense: bool = True) -> DataFrame:
    """Adds id: prefix and a number padded to five digits. Numbers are dense over the whole table: each range of
    ``order``, a column of any type that sorts, counts on from those before it, so no task sorts all rows."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), [], [order], "_one", "_before")
    number = (F.col("_before") + 1).cast("string")
    return numbered.withColumn("id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0")))).drop("_one", "_before")


def distinct_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each trimmed text: each task keeps one row of a text, however often it is there."""
    first = df.groupBy(F.trim(F.col(text)).alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return first.select("_row.*")


def write_corpus(df: DataFrame, path: str) -> None:
    """Rows as JSON files, and a manifest of their number by label and source beside them."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.groupBy("label", "sourceDataset").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/manifest")


def write_snapshot(df: DataFrame, path: str, run_date: str) -> None:
    """Appends a report under its date."""
    df.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def metrics_rows(df: DataFrame) -> DataFrame:
    """The flat event per check that a metrics sink takes."""
    return df.select(
        "verdict", F.col("would").alias("would_verdict"), "score", F.size("reasons").alias("n_reasons"),
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"),
    )
