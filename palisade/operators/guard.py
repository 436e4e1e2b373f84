"""The whole first tier as a chain of column expressions, with Arrow UDFs behind native gates.

Rows are read and normalised once, whatever passes the gates: the UDF for other than ASCII gets a null where a text
needs nothing. Entropy and what may be decoded are one Arrow function over the two finished copies; what it finds is
normalised and searched by column expressions, level by level (see rescan.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Policy
from ..functions import scoring as sc
from ..functions import text as tx
from . import decode, rescan, rules

def with_copies(df: DataFrame, text: str, policy: Policy, locale: Column | None = None) -> DataFrame:
    """Adds truncated, model_copy, decode_copy, matching, and the counts that normalisation takes."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_text", tx.truncate_bytes(raw, policy.max_scan_bytes)).withColumn(
        "truncated", F.octet_length(raw) > policy.max_scan_bytes
    )
    df = df.withColumn("_ascii", tx.is_ascii(F.col("_text")))
    norm = tx.nfkc(F.when(~F.col("_ascii"), F.col("_text"))) if policy.nfkc else F.lit(None)
    df = df.withColumn("_norm", norm).withColumn("_norm", F.coalesce("_norm", "_text"))
    norm = F.col("_norm")
    # in ASCII without controls nothing is invisible, and nothing looks like something else
    df = df.withColumn("_plain", F.col("_ascii") & ~norm.rlike(tx.ASCII_CONTROL))
    plain = F.col("_plain")
    df = df.withColumn("_some", ~plain & norm.rlike(tx.INVISIBLE))
    counts = {k: F.when(F.col("_some"), F.regexp_count(norm, F.lit(p))).otherwise(0) for k, p in tx.CLASSES.items()}
    df = df.withColumn("_counts", F.struct(*[v.alias(k) for k, v in counts.items()]))
    stripped = tx.strip_invisible(norm, policy.bidi)
    if locale is not None and policy.bidi == "strip":
        stripped = F.when(tx.locale_base(locale).isin(list(policy.rtl_locales)), tx.strip_invisible(norm, "isolate")).otherwise(stripped)
    df = df.withColumn("model_copy", F.when(F.col("_some"), stripped).otherwise(norm))
    fold = F.struct(F.col("model_copy").alias("text"), F.lit(0).alias("n"))
    if policy.fold_confusables:
        fold = F.when(plain, fold).otherwise(tx.fold_confusables(F.col("model_copy")))
    df = df.withColumn("_fold", fold)
    folded = F.col("_fold.text")
    if policy.decode_encoded:
        folded = F.coalesce(F.when(folded.rlike(tx.MAY_BE_MORSE), tx.morse(folded)), folded)
    df = df.withColumn("_folded", folded).withColumn("decode_copy", tx.collapse_space(F.col("_folded")))
    joined = tx.join_spaced_letters(tx.join_split_words(F.col("_folded")))
    return df.withColumn("matching", F.lower(tx.collapse_space(joined)))


def guard(
    df: DataFrame,
    text: str = "text",
    source: str | None = None,
    locale: str | None = None,
    high_risk: str | None = None,
    policy: Policy | None = None,
) -> DataFrame:
    """Adds reasons, score, would, verdict and sanitized to each row; all other columns stay.

    Null and empty texts have no reason. Rows of a source that the policy skips keep only reasons of
    the hard-block set.
    """
    policy = policy or Policy()
    where = F.col(locale) if locale else F.lit(None).cast("string")
    risk = F.coalesce(F.col(high_risk), F.lit(False)) if high_risk else F.lit(False)
    made = with_copies(df, text, policy, where if locale else None)
    counts = {k: F.col(f"_counts.{k}") for k in tx.CLASSES}
    matching = F.col("matching")
    simple = [
        *rules.front_gate(F.col("_text"), F.col("truncated")),
        *rules.invisible_reasons(counts, F.when(F.col("_ascii"), F.length("_norm")).otherwise(tx.utf16_length(F.col("_norm"))), F.col("_fold.n")),
    ]
    made = made.withColumn("_l01", sc.reasons(*simple))
    second = rules.l2_reasons(matching, where, policy)
    if policy.adversarial_suffix:
        made = made.withColumn("_salad", decode.salad_runs(matching))
        n = F.col("_salad")
        second.insert(1, F.when(n >= 3, sc.reason("adversarial_suffix", "obfuscation", 0.3 + 0.05 * F.least(n - 3, F.lit(6)))))
    copy = F.col("decode_copy")
    gate = decode.looks_encoded(copy) | (copy.rlike("[0-9=]") & copy.rlike(decode.MAY_SPLIT))
    gate = gate if policy.decode_encoded else F.lit(None).cast("boolean")
    made = made.withColumn("_looked", rescan.look(matching, copy, gate))
    # what follows needs the finished copies only
    made = rescan.with_rescan(made, "_looked.looked", policy.decode_depth, "_decoded")
    made = made.withColumn("_second", sc.reasons(*second))
    second = []
    n = F.coalesce(F.col("_decoded.n"), F.lit(0))
    second += [
        F.when(F.col("_looked.entropy") > 5.5, sc.reason("entropy_anomaly", "obfuscation", F.lit(0.3))),
        F.when(n > 0, sc.reason("encoded_payload", "obfuscation", 0.8 + 0.05 * n)),
    ]
    made = rules.with_rule_reasons(made, "matching", "_l3")
    found = F.concat(F.col("_l01"), F.col("_second"), sc.reasons(*second), F.col("_l3"))
    if source:
        skipped = [s for s, (skip, _) in policy.per_source.items() if skip]
        hard = F.concat(F.col("_l01"), F.col("_l3"))
        kept = F.filter(hard, lambda r: r["hard"] | (F.lit(True) if policy.hard_block_rules is True else r["code"].isin(list(policy.hard_block_rules or ()))))
        found = F.when(F.col(source).isin(skipped), kept).otherwise(found)
    sanitized, changed = F.col("model_copy"), None
    if policy.neutralize != "off":
        blobs = F.coalesce(F.col("_decoded.blobs"), F.array().cast("array<string>"))
        made = made.withColumn("_sanitized", decode.neutralised(sanitized, blobs, policy.neutralize))
        sanitized, changed = F.col("_sanitized"), F.col("_sanitized") != F.col("model_copy")
        told = sc.reasons(F.when(changed, sc.reason("encoded_payload_neutralized", "obfuscation", F.lit(0.0))))
        found = F.concat(found, told) if not source else F.when(F.col(source).isin(skipped), found).otherwise(F.concat(found, told))
    made = made.withColumn("reasons", found).withColumn("score", sc.score_of(F.col("reasons")))
    would = sc.would_verdict(F.col("score"), sc.hard_block(F.col("reasons"), policy.hard_block_rules), policy, risk)
    made = made.withColumn("would", would).withColumn("verdict", sc.enforced(F.col("would"), policy.mode)).withColumn("sanitized", sanitized)
    keep = [c for c in df.columns if c not in ("reasons", "score", "would", "verdict", "sanitized")]
    return made.select(*keep, "reasons", "score", "would", "verdict", "sanitized")
