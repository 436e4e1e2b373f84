"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as sql
from .collocations import collocations
from .common import table
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .license_scan import scan_licences
from .minhash_join import minhash_join
from .mixing import mix_sources, mixing_oracle
from .ngram_join import ngram_join
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import judge_toxicity
from .url_filter import filter_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_url_filter,
        op2_decontamination,
        op3_exact_dedup,
        op4_suffix_dedup,
        op5_ngram_join,
        op6_license_scan,
        op7_source_mixing,
        op8_toxicity,
        op9_substring_dedup,
        op10_token_counts,
        op11_collocations,
        op12_minhash_join,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in made}


def oracles() -> dict[str, str]:
    return {
        "op3_exact_dedup": sql.OP3_SQL,
        "op4_suffix_dedup": sql.OP4_SQL,
        "op5_ngram_join": sql.OP5_SQL,
        "op7_source_mixing": mixing_oracle(),
        "op9_substring_dedup": sql.OP9_SQL,
        "op11_collocations": sql.OP11_SQL,
        "op12_minhash_join": sql.OP12_SQL,
        "op13_hard_negatives": sql.OP13_SQL,
    }
