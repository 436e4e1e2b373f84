"""Scorers folded over tiers, tool calls, sources, and the rule bank's shortcuts."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from palisade.config import Policy
from palisade.functions import regexlib as rx
from palisade.functions.scoring import reason, reasons
from palisade.operators import companions, escalation, metrics
from palisade.sources import readers

_PIECES = (
    "ignore", "all", "previous", "instructions", " ", " ", ":", ".", "system", "<|im_start|>", "the", "rules", "call the tool", "to", "send", "é", "_", "x",
    "reveal", "your", "prompt", "do not say", "you can't", "http://a?", "secret", "](javascript:", "[", "![", ")", "new rules", "role", '"', "admin", "<policy>", "tool_call", "hidden", "above",
)


def texts(n=1500):
    r = random.Random(3)
    return ["".join(r.choice(_PIECES) for _ in range(r.randint(1, 14))) for _ in range(n)]


def test_a_text_that_a_rule_matches_holds_what_it_needs(spark):
    for r in rx.RULES:
        pattern = regex.compile(r.pattern, regex.ASCII)
        for t in texts():
            if pattern.search(t):
                assert all(any(x in t for x in group) for group in r.needs), (r.name, t)
    df = spark.createDataFrame([(t,) for t in texts(300)], "t string")
    plain = lambda p: F.regexp_count("t", F.lit(p.replace(r"\b", rx._BORDER)))  # noqa: E731  the border in full
    for r in rx.RULES:
        assert df.where(rx.rule_matches("t", r) != plain(r.pattern)).isEmpty(), r.name


def test_untrusted_text_may_not_call_itself_system(spark):
    df = spark.createDataFrame([("web",), (None,)], "source string")
    assert [r[0] for r in df.select(escalation.untrusted_source(F.col("source"))).collect()] == ["web", None]
    with pytest.raises(Exception, match="must not have the source"):
        spark.createDataFrame([("system",)], "source string").select(escalation.untrusted_source(F.col("source"))).collect()


def test_tool_verdicts(spark):
    some = reasons(reason("x", "semantic", F.lit(0.3)))
    df = spark.createDataFrame([(True, False), (True, True), (False, True)], "allowed boolean, tainted boolean")
    v = df.select(companions.tool_verdict(F.col("allowed"), F.col("tainted"), some, Policy()).alias("v")).select("v.verdict", "v.score", F.expr("transform(v.reasons, r -> r.code)")).collect()
    assert [(r[0], round(r[1], 6), r[2]) for r in v] == [("allow", 0.3, ["x"]), ("block", 0.93, ["x", "tainted_data_flow"]), ("block", 1.0, ["agentic_tool_hijack"])]


def test_judge_prompt_and_degradation(spark):
    row = spark.range(1).select(escalation.judge_prompt(F.lit("some text"), F.lit("---")).alias("p"), escalation.degradation(F.lit("timeout"), 2).alias("d")).first()
    assert row["p"].endswith("---\nsome text\n---") and (row["d"]["tier"], row["d"]["reason"]) == (2, "timeout")


def test_corpus_with_manifest(spark, tmp_path):
    df = spark.createDataFrame([("t", "attack", "c", "d"), ("u", "benign", "c", "d"), ("v", "benign", "c", "e")], "text string, label string, category string, sourceDataset string")
    readers.write_corpus(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/rows")).count() == 3
    assert {(r["label"], r["sourceDataset"]): r["n"] for r in spark.read.json(str(tmp_path / "out/manifest")).collect()} == {("attack", "d"): 1, ("benign", "d"): 1, ("benign", "e"): 1}


@pytest.mark.parametrize("most", [companions.MOST_CHARS, 0])
def test_taint_of_odd_marks(spark, monkeypatch, most):
    monkeypatch.setattr(companions, "MOST_CHARS", most)
    docs = spark.createDataFrame([(1, "xabcabcx" + "long mark " * 20), (2, None), (3, ""), (1, "abc")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "abc", "a"), (2, "bca", "b"), (3, "", "c"), (4, None, "d"), (5, "long mark " * 15, "e"), (6, "long mark " * 15 + "!", "f"), (7, "abc", "g")], "mark_seq long, text string, source string")
    got = sorted((r["doc_id"], r["mark_seq"]) for r in companions.taint_matches(docs, marks).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 5), (1, 7), (1, 7)]
    assert companions.taint_matches(docs, marks.limit(0)).count() == 0


def test_ranges_and_areas_of_odd_tables(spark):
    empty = spark.createDataFrame([], "y boolean, s double")
    assert metrics.areas(metrics.curve(empty, F.col("y"), "s")).count() == 1
    one = spark.createDataFrame([(True, 0.5), (False, 0.5)], "y boolean, s double")
    assert metrics.areas(metrics.curve(one, F.col("y"), "s")).first()["roc_auc"] == pytest.approx(0.5)
    ids = readers.sequence_ids(spark.range(500).select((F.col("id") * 37 % 501).alias("k")), "n-", "k")
    got = sorted((r["k"], r["id"]) for r in ids.collect())
    assert [x for _, x in got] == [f"n-{k + 1:05d}" for k in range(500)]
