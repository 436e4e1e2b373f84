"""The staged chain against a fold of each row by itself."""

import itertools

import pytest
from pyspark.sql import functions as F

from palisade.config import Policy
from palisade.functions.scoring import REASON
from palisade.operators import chain, escalation

_SCORES = {"ml": 0.3, "embedding": 0.2, "remote": 0.5}


def _decide(weights, hard, risk, policy):
    left = 1.0
    for w in weights:
        left *= 1 - w
    score = 1 - left
    base = "block" if hard or score >= policy.block else "flag" if score >= policy.flag else "allow"
    return score, "block" if risk and base == "flag" else base


def _plain(weights, hard, risk, source, fails, policy, has, floor):
    """score, would, tier, degraded tier and calls of one row, as the tiers are told to work."""
    skip, always = policy.per_source.get(source, (False, False))
    score, would = _decide(weights, hard, risk, policy)
    tier, degraded, calls = 0, None, []
    if skip:
        return score, would, tier, degraded, calls
    weights, late = list(weights), []
    together = always and has["ml"] and has["embedding"]
    for name, number in (("ml", 1), ("embedding", 2), ("remote", 2)):
        if name == "remote" and together:
            weights += late
            score, would = _decide(weights, hard, risk, policy)
        asked = would == "flag" or risk if name == "remote" else always or would == "flag" or (risk and would != "allow")
        if not has[name] or not asked:
            continue
        calls.append((name, "timeout" if name in fails else "scored"))
        weight = 0.0 if name == "ml" and _SCORES[name] < floor else _SCORES[name]
        if together and name != "remote":
            if name in fails:
                degraded = degraded or number
            else:
                late.append(weight)
                tier = number
        elif name in fails:
            tier, degraded = number, number
            would = _decide(weights, hard, risk or policy.fail_mode == "closed", policy)[1]
        else:
            weights.append(weight)
            tier = number
            score, would = _decide(weights, hard, risk, policy)
    return score, would, tier, degraded, calls


def _rows():
    cells = itertools.product([[], [0.2], [0.45], [0.6, 0.3], [0.9]], [False, True], [False, True, None], ["system", "user", "assistant", None], [(), ("ml",), ("embedding",), ("remote",), ("ml", "embedding", "remote")])
    return [(n, *c) for n, c in enumerate(cells)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(n, [("r", "semantic", w, False, None) for w in ws] + ([("template_forgery", "structural", 0.0, True, None)] if hard else []), risk, source, list(fails), f"text {n}") for n, ws, hard, risk, source, fails in _rows()]
    kind = "array<struct<" + REASON.replace(" ", ":").replace(",:", ",") + ">>"
    return spark.createDataFrame(rows, f"n int, reasons {kind}, risk boolean, source string, fails array<string>, t string").repartition(5)


def _stub(name, met):
    def apply(rows):
        met.setdefault(name, []).extend(r["n"] for r in rows.select("n").collect())
        failed = F.array_contains("fails", name)
        return rows.select(chain.ROW, F.when(~failed, _SCORES[name]).alias("score"), F.when(failed, "timeout").alias("error"))

    return apply


@pytest.mark.parametrize("mode,has,floor", [("open", "ml embedding remote", 0.0), ("closed", "ml embedding remote", 0.35), ("closed", "ml remote", 0.0), ("closed", "embedding", 0.0), ("open", "ml embedding", 0.0)])
def test_chain_equals_a_fold_of_each_row(spark, table, mode, has, floor):
    policy, met = Policy(fail_mode=mode), {}
    has = {k: k in has.split() for k in _SCORES}
    scorers = {k: chain.Scorer(_stub(k, met), floor if k == "ml" else 0.0) if has[k] else None for k in _SCORES}
    from palisade.functions.scoring import hard_block, score_of, would_verdict

    risk = F.coalesce("risk", F.lit(False))
    d = table.withColumn("score", score_of(F.col("reasons"))).withColumn("would", would_verdict(score_of(F.col("reasons")), hard_block(F.col("reasons"), policy.hard_block_rules), policy, risk))
    out = chain.staged_chain(d, policy, "t", "source", "risk", scorers["ml"], scorers["embedding"], scorers["remote"], passed=["n", "fails"])
    got = {r["n"]: r for r in out.collect()}
    asked = {k: [] for k in _SCORES}
    for n, ws, hard, risky, source, fails in _rows():
        score, would, tier, degraded, calls = _plain(ws, hard, bool(risky), source, fails, policy, has, floor)
        r = got[n]
        assert (r["would"], r["verdict"], r["tier"], r["degraded"] and r["degraded"]["tier"], [tuple(c) for c in r["calls"]]) == (would, would, tier, degraded, calls), n
        assert r["score"] == pytest.approx(score) and r["t"] == f"text {n}"
        for name, _ in calls:
            asked[name].append(n)
    for name in _SCORES:  # just the rows that the gates ask for, each once
        assert sorted(met.get(name, [])) == asked[name]
    told = {r["scorer"]: (r["rows"], r["scored"], r["failed"]) for r in chain.ledger(out).collect()}
    for name, rows in asked.items():
        failed = sum(name in _rows()[n][5] for n in rows)
        assert told.get(name, (0, 0, 0)) == (len(rows), len(rows) - failed, failed)


def test_chain_of_functions_and_odd_texts(spark):
    def load():
        return lambda texts: [0.9 if "bad" in t else 0.0 for t in texts]

    kind = "array<struct<" + REASON.replace(" ", ":").replace(",:", ",") + ">>"
    rows = [(1, "bad", [], 0.0, "allow"), (2, None, [], 0.0, "allow"), (3, "fine " * 3000 + "bad", [], 0.0, "allow")]
    d = spark.createDataFrame(rows, f"_row int, sanitized string, reasons {kind}, score double, would string").withColumn("source", F.lit("web"))
    out = {r["_row"]: r for r in chain.staged_chain(d, Policy(), source="source", ml=chain.Scorer(chain.udf_scorer(load))).collect()}
    assert {k: (r["verdict"], r["tier"]) for k, r in out.items()} == {1: ("block", 1), 2: ("allow", 1), 3: ("block", 1)}
    assert [c["code"] for c in out[1]["reasons"]] == ["ml_classifier"] and out[1]["reasons"][0]["category"] == "semantic"
    assert chain.staged_chain(d.limit(0), Policy(), source="source", ml=chain.Scorer(chain.udf_scorer(load))).count() == 0
    assert escalation.ml_reason(F.lit(0.5)) is not None


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_texts_are_written_once(spark, table, monkeypatch, threshold):
    """What a stage leaves behind has no text and none of the caller's columns, and only texts that may be asked for are read again."""
    from palisade.functions.scoring import score_of

    seen, write = {}, chain.written
    monkeypatch.setattr(chain, "written", lambda df, name: seen.setdefault(name, df.columns) and write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        scorers = {k: chain.Scorer(_stub(k, {})) for k in _SCORES}
        d = table.withColumn("score", score_of(F.col("reasons"))).withColumn("would", F.lit("flag")).withColumn("t", F.when(F.col("n") % 3 > 0, F.col("t")))
        out = chain.staged_chain(d, Policy(), "t", "source", "risk", scorers["ml"], scorers["embedding"], scorers["remote"], passed=["n", "fails"])
        assert out.columns == ["n", "risk", "source", "fails", "t", "reasons", "score", "would", "verdict", "tier", "degraded", "calls"]
        assert {r["n"]: r["t"] for r in out.collect()} == {r["n"]: r["t"] for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [k for k, columns in seen.items() if {"text", "_own", "_passed"} & set(columns)] == ["chain-rows"]


def test_the_query_writes_one_copy_of_a_text(spark, data, monkeypatch):
    from palisade.plans import registry

    kinds, write = {}, chain.written
    monkeypatch.setattr(chain, "written", lambda df, name: kinds.setdefault(name, df.schema) and write(df, name))
    registry.queries()["staged_chain"](spark, data)
    assert {f.name for f in kinds["chain-rows"]["_own"].dataType} == {"_any", "doc_id", "risk", "src"}
