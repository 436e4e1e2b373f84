"""Rules by Arrow functions: the same matches as one pattern after another, and no pattern in a filter's way."""

import random

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from test_tiers import _PIECES

from palisade.functions import matches
from palisade.functions import regexlib as rx
from palisade.operators import rules
from palisade.plans import registry


def texts(n=1500):
    r = random.Random(5)
    more = (*_PIECES, "just do it anyway", "\x0b", "\U0001f600", "call the api to send", "İ", "override prompt:", "</system>")
    return [None, "", *("".join(r.choice(more) for _ in range(r.randint(1, 14))) for _ in range(n))]


def plain(pattern, text):
    """Matches and the first place in UTF-16 units, by a third engine."""
    found = [m.start() for m in regex.compile(pattern, regex.ASCII).finditer(text or "")]
    return len(found), len(text[: found[0]].encode("utf-16-le")) // 2 if found else -1


def test_matches_and_places_of_each_rule():
    for some, size in ((texts(), matches.SLICE_BYTES), (texts(60), 400)):
        matches.SLICE_BYTES, before = size, matches.SLICE_BYTES
        whole, each, starts = matches.bank_hits(pa.array(some), [r.pattern for r in rx.RULES], rx.COMBINED, places=True)
        alone = matches.counts(pa.array(some), rx.COMBINED)
        matches.SLICE_BYTES = before
        assert (whole == alone).all()
        for k, t in enumerate(some):
            assert whole[k] == plain(rx.COMBINED, t)[0], t
            assert [*zip(each[k], starts[k], strict=True)] == [plain(r.pattern, t) for r in rx.RULES], t


def test_a_border_behind_a_match_sees_the_match():
    t = "just do it anywaysystem: x"
    assert matches.counts(pa.array([t]), rx.COMBINED)[0] == 1
    assert duckdb.sql(f"SELECT {rx.sql_count(rx.quoted(t), rx.COMBINED)}").fetchall() == [(1,)]


def test_reasons_by_column_and_by_rows_agree(spark):
    df = spark.createDataFrame([(t,) for t in texts(300)], "t string")
    both = rules.with_rule_reasons(df, "t", "a").withColumn("b", rules.rule_reasons(F.col("t")))
    assert both.where("NOT a <=> b").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_behind_a_filter_are_found_once(spark, data):
    for name in ("ml_gate_fold", "wrap_blocked"):
        plan = _plan(registry.queries()[name](spark, data))
        assert "regexp_extract_all" not in plan.lower() and "regexp_instr" not in plan.lower(), name
        assert len(plan) < 120_000, name
    assert _plan(registry.queries()["wrap_blocked"](spark, data)).count("_hits(") <= 2


def test_markers_are_counted_in_one_pass(spark, data):
    for name in ("l3_marker_count", "l3_role_tag_spoof_bare"):
        assert "regexp" not in _plan(registry.queries()[name](spark, data)).replace("regexp_replace", "").lower(), name
