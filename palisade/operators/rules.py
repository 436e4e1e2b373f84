"""Detectors over a text's copies: each gives a reason column that is null where it finds nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..config import LATIN_LOCALES, Policy
from ..functions import matches
from ..functions import regexlib as rx
from ..functions import text as tx
from ..functions.scoring import bound, reason, reasons

MOST_MATCHES, MOST_MARKERS = 21, 51
_PATTERNS = [r.pattern for r in rx.RULES]


def pattern_count(text: Column, pattern: str) -> Column:
    """Matches of a pattern, 0 in a null: an Arrow function, so it can't stand inside of transform() and its like."""

    @F.arrow_udf(IntegerType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(matches.counts(texts, pattern))

    return counted(text)


def rule_count(matching: Column, rule: rx.Rule) -> Column:
    return F.least(F.lit(MOST_MATCHES), pattern_count(matching, rule.pattern))


def rule_weight(n: Column, rule: rx.Rule) -> Column:
    return F.least(F.lit(1.0), F.lit(rule.cap), F.lit(rule.weight) + F.lit(rule.boost) * (n - 1))


def rule_reasons(matching: Column) -> Column:
    """Of the whole bank. A rule's pattern is tried on texts that hold its literals only, and counted once."""

    def found(x: Column) -> Column:
        out = []
        for r in rx.RULES:
            n, start = x[r.name], F.regexp_instr(x["m"], F.lit(rx.java(r.pattern))) - 1
            out.append(F.when(n > 0, reason(r.code, r.category, rule_weight(n, r), r.hard, start)))
        return reasons(*out)

    def counted(m: Column) -> Column:
        counts = [F.least(F.lit(MOST_MATCHES), rx.rule_matches(m, r)).alias(r.name) for r in rx.RULES]
        return bound(F.struct(m.alias("m"), *counts), found)

    return bound(matching, counted)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


@F.arrow_udf(StructType().add("n", ArrayType(IntegerType())).add("start", ArrayType(IntegerType())))
def _hits(matching: pa.Array) -> pa.Array:
    _, each, starts = matches.bank_hits(matching, _PATTERNS, rx.COMBINED, places=True)
    return pa.StructArray.from_arrays([_lists(np.minimum(each, MOST_MATCHES)), _lists(starts)], ["n", "start"])


#: So that a filter on what is made of it isn't moved in front of it, where all of it would be found a second time.
_hits_once = _hits.asNondeterministic()


def with_rule_reasons(df: DataFrame, matching: str, into: str) -> DataFrame:
    """Adds rule_reasons() of a column: one Arrow function tells each rule's matches and their first place."""
    out = []
    for k, r in enumerate(rx.RULES):
        n, start = F.col("_hits.n")[k], F.col("_hits.start")[k]
        out.append(F.when(n > 0, reason(r.code, r.category, rule_weight(n, r), r.hard, start)))
    return df.withColumn("_hits", _hits_once(F.col(matching))).withColumn(into, reasons(*out)).drop("_hits")


def marker_count(matching: Column) -> Column:
    """Matches of any rule, leftmost first."""
    return F.least(F.lit(MOST_MARKERS), pattern_count(matching, rx.COMBINED))


SEARCHED = StructType().add("n", IntegerType()).add("codes", ArrayType(StringType()))


def search(texts: pa.Array) -> pa.Array:
    whole, each, _ = matches.bank_hits(texts, _PATTERNS, rx.COMBINED)
    codes = [[] if not n else [r.code for r, k in zip(rx.RULES, own, strict=True) if k] for n, own in zip(whole, each, strict=True)]
    return pa.StructArray.from_arrays([pa.array(np.minimum(whole, MOST_MARKERS)), pa.array(codes, pa.list_(pa.string()))], ["n", "codes"])


@F.arrow_udf(SEARCHED)
def searched(matching: pa.Array) -> pa.Array:
    """marker_count() and the codes of the rules that match."""
    return search(matching)


@F.arrow_udf(ArrayType(SEARCHED))
def searched_each(lists: pa.Array) -> pa.Array:
    """searched() of each text in an array; null for a null."""
    lengths = np.array([len(x) if x.is_valid else 0 for x in lists], np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(ends, search(lists.flatten()), mask=lists.is_null())


def front_gate(text: Column, truncated: Column) -> list[Column]:
    run = tx.longest_run(text)
    return [
        F.when(truncated, reason("length_cap", "resource", F.lit(0.3))),
        F.when(
            (tx.utf16_length(text) > 400) & (run > 200),
            reason("length_cap", "resource", 0.2 + F.least(F.lit(0.2), (run - 200) / 2000)),
        ),
    ]


def invisible_reasons(counts: dict[str, Column], length: Column, folded: Column) -> list[Column]:
    bidi = counts["bidi_embed"] + counts["bidi_override"]
    total = counts["zero_width"] + counts["variation"] + counts["control"] + counts["tag"] + bidi
    density = total / F.greatest(length, F.lit(1))
    return [
        F.when(counts["tag"] > 0, reason("unicode_tag_smuggling", "obfuscation", F.lit(1.0), True)),
        F.when(bidi > 0, reason("bidi_override", "obfuscation", F.when(counts["bidi_override"] > 0, 0.7).otherwise(0.5))),
        F.when(counts["zero_width"] > 0, reason("zero_width_chars", "obfuscation", 0.25 + 0.04 * counts["zero_width"])),
        F.when(density > 0.02, reason("invisible_density", "obfuscation", F.least(F.lit(0.7), 2.2 * density))),
        F.when(folded > 0, reason("confusable_run", "obfuscation", 0.2 + 0.06 * folded)),
    ]


_CYRILLIC, _GREEK = "а-яА-ЯёЁ", "α-ωΑ-Ω"


def script_counts(c: Column) -> dict[str, Column]:
    # what is left without the runs of all else; fewer matches than characters
    latin, cyrillic, greek = (F.length(tx.replace_all(c, f"[^{p}]+", "")) for p in ("A-Za-z", _CYRILLIC, _GREEK))
    return {"latin": latin, "cyrillic": cyrillic, "greek": greek, "other": F.length(tx.replace_all(c, r"[\x00-\x7f]+", "")) - cyrillic - greek}


def special_tokens(matching: Column, tokens: tuple[str, ...]) -> Column:
    pattern = rx.special_token_pattern(tokens)
    if pattern is None:
        return F.lit(None)
    n = F.least(F.lit(MOST_MATCHES), rx.count(matching, pattern))
    some = F.lit(True)
    if all(t[:1] in "<[" for t in tokens if t):
        some = matching.contains("<") | matching.contains("[")
    found = lambda k: F.when(k > 0, reason("special_token_injection", "structural", F.least(F.lit(0.95), 0.6 + 0.1 * (k - 1))))
    return bound(F.when(some, n).otherwise(0), found)


def mixed_letters(matching: Column) -> Column:
    """Letters in runs that hold two or more Latin and two or more Cyrillic or Greek ones."""
    runs = F.regexp_extract_all(matching, F.lit(f"[A-Za-z{_CYRILLIC}{_GREEK}]+"), 0)
    mixed = F.filter(
        runs,
        lambda r: (F.regexp_count(r, F.lit("[A-Za-z]")) >= 2) & (F.regexp_count(r, F.lit("[^A-Za-z]")) >= 2),
    )
    n = F.aggregate(F.transform(mixed, F.length), F.lit(0), lambda a, x: a + x)
    return F.when(matching.rlike(f"[{_CYRILLIC}{_GREEK}]"), n).otherwise(0)


def script_mixing(matching: Column) -> Column:
    wide = ~tx.is_ascii(matching)
    n = bound(matching, mixed_letters)
    return bound(F.when(wide, n).otherwise(0), lambda k: F.when(k > 0, reason("script_mixing", "obfuscation", 0.3 + 0.03 * k)))


def language_divergence(matching: Column, locale: Column) -> Column:
    s = script_counts(matching)
    more = F.octet_length(matching) - F.length(matching)  # each character beyond ASCII takes a byte more at least
    # what is cheap first: few texts have more other characters than Latin letters
    on = tx.locale_base(locale).isin(list(LATIN_LOCALES)) & (more > 10) & (more > s["latin"]) & (s["other"] > 10) & (s["other"] > s["latin"])
    return F.when(on, reason("lang_divergence", "semantic", F.lit(0.2)))


def l2_reasons(matching: Column, locale: Column, policy: Policy) -> list[Column]:
    return [
        special_tokens(matching, policy.special_tokens),
        script_mixing(matching),
        language_divergence(matching, locale),
    ]
