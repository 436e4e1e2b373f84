"""Registered queries of the staged chain, the cache of verdicts, calls to a provider, and joins by containment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as cf
from ..functions import scoring as sc
from ..functions import regexlib as rx
from ..operators import chain, containment, remote, rules, toolcalls, verdicts
from ..sources import sinks
from ..sources.shared import shared_dir, written
from .registry import _CAN, _MARKS, _PAYLOADS, _ROLE_SQL, SCORED_SQL, judged, marks_of, query, seeded, table

_WEIGHT = "round((length(m) - length(replace(m, '{0}', ''))) / length(m)::DOUBLE, 6)"
_RISKY = "(doc_id % 7 = 0)"
_FAILS = {"ml": ("e", 11, 3), "embedding": ("a", 13, 5), "remote": ("o", 17, 1)}
_FLOOR = 0.05


def _judge(score: str, risk: str) -> str:
    return f"CASE WHEN {score} >= 0.85::DOUBLE OR hard THEN 'block' WHEN {score} >= 0.4::DOUBLE THEN CASE WHEN {risk} THEN 'block' ELSE 'flag' END ELSE 'allow' END"


def _score(weights: str) -> str:
    return f"1.0::DOUBLE - list_product(list_prepend(1.0::DOUBLE, list_transform({weights}, lambda x: 1.0::DOUBLE - x)))"


def _stage(name: str, before: str, gate: str, tier: int, apart: str) -> str:
    """A scorer in turn: rows in ``apart`` only take its weight."""
    letter, n, k = _FAILS[name]
    weight = _WEIGHT.format(letter)
    weight = f"CASE WHEN {weight} < {_FLOOR}::DOUBLE THEN 0.0::DOUBLE ELSE {weight} END" if name == "ml" else weight
    return f"""{name}_a AS (SELECT *, {gate} AS asked, doc_id % {n} = {k} AS fails FROM {before}),
{name}_b AS (SELECT * REPLACE (CASE WHEN asked AND NOT fails AND NOT {apart} THEN list_append(ws, {weight}) ELSE ws END AS ws, CASE WHEN asked AND NOT fails AND {apart} THEN list_append(late, {weight}) ELSE late END AS late) FROM {name}_a),
{name}_c AS (SELECT *, {_score('ws')} AS s FROM {name}_b),
{name} AS (SELECT * EXCLUDE (s, asked, fails) REPLACE (
  CASE WHEN asked AND NOT {apart} THEN s ELSE score END AS score,
  CASE WHEN asked AND NOT {apart} THEN {_judge('s', f'({_RISKY} OR fails)')} ELSE would END AS would,
  CASE WHEN asked AND NOT {apart} THEN {tier} ELSE tier END AS tier,
  CASE WHEN asked AND fails AND (NOT {apart} OR degraded IS NULL) THEN {tier} ELSE degraded END AS degraded,
  CASE WHEN asked THEN calls || ',{name}' || CASE WHEN fails THEN '!' ELSE '' END ELSE calls END AS calls) FROM {name}_c)"""


_GATE = "(NOT skip AND (always OR would = 'flag' OR (risk AND would <> 'allow')))"
STAGED_SQL = f"""WITH {SCORED_SQL}, roles AS (SELECT *, {_ROLE_SQL} AS src FROM judged),
rows_0 AS (SELECT doc_id, m, ws, hard, score, {_RISKY} AS risk, coalesce(src = 'system', false) AS skip, coalesce(src IN ('user', 'web'), false) AS always,
  {_judge('score', _RISKY)} AS would, 0 AS tier, NULL::INTEGER AS degraded, '' AS calls, []::DOUBLE[] AS late FROM roles),
{_stage('ml', 'rows_0', _GATE, 1, 'always')},
{_stage('embedding', 'ml', _GATE, 2, 'always')},
together AS (SELECT * REPLACE (CASE WHEN always THEN list_concat(ws, late) ELSE ws END AS ws) FROM embedding),
folded AS (SELECT * REPLACE (CASE WHEN always THEN {_score('ws')} ELSE score END AS score,
  CASE WHEN always THEN {_judge(_score('ws'), _RISKY)} ELSE would END AS would,
  CASE WHEN NOT always THEN tier WHEN calls LIKE '%embedding' THEN 2 WHEN calls LIKE ',ml,%' THEN 1 ELSE 0 END AS tier) FROM together),
{_stage('remote', 'folded', "(NOT skip AND (would = 'flag' OR risk))", 2, 'false')}
SELECT doc_id, round(score, 5) AS score, would AS verdict, tier, degraded, calls FROM remote"""


def stub(name: str, m: str = "m"):
    """A scorer by the share of a letter, which fails on some rows."""
    letter, n, k = _FAILS[name]

    def apply(rows):
        share = F.round((F.length("text") - F.length(F.replace(F.col("text"), F.lit(letter), F.lit("")))) / F.length("text"), 6)
        failed = F.col("doc_id") % n == k
        return rows.select(chain.ROW, F.when(~failed, share).alias("score"), F.when(failed, "timeout").alias("error"))

    return apply


@query("staged_chain", STAGED_SQL)
def staged_chain(spark, sf_dir):
    risk = F.col("doc_id") % 7 == 0
    d = judged(spark, sf_dir).withColumn("risk", risk).withColumn("src", F.expr(_ROLE_SQL))
    d = d.withColumn("would", sc.would_verdict(F.col("score"), F.col("hard"), cf.Policy(), risk))
    scorers = {k: chain.Scorer(stub(k), _FLOOR if k == "ml" else 0.0) for k in _FAILS}
    d = d.select("doc_id", "m", "reasons", "score", "would", "risk", "src")
    out = chain.staged_chain(d, cf.Policy(fail_mode="closed"), "m", "src", "risk", scorers["ml"], scorers["embedding"], scorers["remote"], passed=["doc_id"])
    called = F.transform("calls", lambda c: F.concat(F.lit(","), c["scorer"], F.when(c["outcome"] == "scored", "").otherwise("!")))
    return out.select("doc_id", F.round("score", 5).alias("score"), "verdict", "tier", F.col("degraded.tier").alias("degraded"), F.array_join(called, "").alias("calls"))


async def _share_of_o(text: str) -> dict:
    """A provider in place of one on the network: fails on some texts."""
    body = text.split("\n", 1)[1].rsplit("\n", 1)[0]
    if len(body) % 17 == 1:
        raise OSError("refused")
    return {"score": body.count("o") / max(len(body), 1), "label": "injection"}


@query("remote_calls", "SELECT doc_id, CASE WHEN length(text) % 17 <> 1 THEN length(text) - length(replace(text, 'o', '')) END AS hits, CASE WHEN length(text) % 17 = 1 THEN 'OSError: refused' END AS error FROM documents")
def remote_calls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), "text")
    out = remote.remote_scores(d, "text", lambda: _share_of_o, concurrency=32, seconds=30.0, passed=["doc_id", "n"])
    return out.select("doc_id", F.round(F.col("score") * F.col("n")).cast("long").alias("hits"), "error")


@query("taint_containment", f"WITH {_MARKS} SELECT d.doc_id, m.mark_seq, instr(d.text, m.text) - 1 AS start FROM documents d JOIN marks m ON length(m.text) > 0 AND contains(d.text, m.text)")
def taint_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = containment.containment(d, marks_of(spark, sf_dir))
    return found.select("doc.doc_id", "mark.mark_seq", "start")


_LEAKING = f"CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' see ' || {_CAN.replace('doc_id', '(doc_id - doc_id % 7)')} || ', ' || {_CAN.replace('doc_id', '(doc_id + 1)')} ELSE text END"


@query("canary_table", f"""WITH o AS (SELECT doc_id, {_LEAKING} AS t FROM documents), c AS (SELECT doc_id AS ord, {_CAN} AS canary FROM documents WHERE doc_id % 2 = 0)
SELECT o.doc_id, arg_min(canary, ord) AS canary, arg_min(instr(t, canary) - 1, ord) AS start FROM o JOIN c ON contains(t, canary) GROUP BY o.doc_id""")
def canary_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    canary = F.expr("concat('canary-', substr(sha2(concat('s3cret:', doc_id), 256), 1, 32))")
    leaking = F.expr("concat('canary-', substr(sha2(concat('s3cret:', doc_id - doc_id % 7), 256), 1, 32))")
    after = F.expr("concat('canary-', substr(sha2(concat('s3cret:', doc_id + 1), 256), 1, 32))")
    told = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" see "), leaking, F.lit(", "), after)).otherwise(F.col("text"))
    listed = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("ord"), canary.alias("canary"))
    out = containment.first_leaks(d.select("doc_id", told.alias("text")), listed, "canary-", 39)
    return out.where("leak is not null").select("doc_id", "leak.canary", F.col("leak.start").cast("long").alias("start"))


@query("verdict_store", f"""WITH {SCORED_SQL}, k AS (SELECT doc_id, m, coalesce(source, 'user') AS src, lang, would, round(score, 6) AS score FROM judged)
SELECT doc_id, would, score, EXISTS (SELECT 1 FROM k o WHERE o.doc_id % 3 <> 0 AND o.m = k.m AND o.src = k.src AND coalesce(o.lang, '') = coalesce(k.lang, '')) AS cached FROM k""")
def verdict_store(spark, sf_dir):
    """The second of two runs over one store; the first had two thirds of the rows."""
    store = verdicts.VerdictStore(spark, f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}", buckets=16)
    d = seeded(spark, sf_dir).select("doc_id", "source", "lang", "m")

    def judge(rows):
        found = rules.with_rule_reasons(rows, "m", "reasons").withColumn("score", sc.score_of(F.col("reasons")))
        would = sc.would_verdict(F.col("score"), sc.hard_block(F.col("reasons"), cf.HARD_BLOCK_RULES), cf.Policy())
        return found.select(*rows.columns, F.round("score", 6).alias("score"), would.alias("would"))

    how = {"matching": "m", "source": "source", "locale": "lang"}
    written(verdicts.cached_verdicts(d.where("doc_id % 3 <> 0"), store, judge, **how), "verdict-first")
    return verdicts.cached_verdicts(d, store, judge, **how).select("doc_id", "would", "score", "cached")


@query("metrics_sink", f"""WITH {SCORED_SQL} SELECT count(*) AS checks, count_if(would = 'allow') AS allow, count_if(would = 'flag') AS flag, count_if(would = 'block') AS block,
count_if(would = 'block') AS shadowed, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score, sum(len(ws))::BIGINT AS reasons FROM judged""")
def metrics_sink(spark, sf_dir):
    met = []
    d = judged(spark, sf_dir).withColumn("verdict", F.col("would")).withColumn("other", sc.enforced(F.col("would"), "soft"))
    sinks.told(d, met.append, lambda rows: rows.write.format("noop").mode("overwrite").save(), would="other")
    kind = "checks long, allow long, flag long, block long, shadowed long, mean_score double, max_score double, reasons long"
    row = [round(met[0][k], 5) if k.endswith("score") else met[0][k] for k in (x.split()[0] for x in kind.split(", "))]
    return spark.createDataFrame([tuple(row)], kind)


_NOTE = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {rx.quoted(p)}" for k, p in enumerate(_PAYLOADS)) + " ELSE 'nothing to tell' END"
_TOOL_DOCS = f"docs AS (SELECT doc_id, lang, source, lower('{{\"doc_id\":' || doc_id || ',\"note\":\"' || replace({_NOTE}, '\"', '\\\"') || '\"}}') AS m FROM documents)"


_TOKENS = rx.sql_count("m", rx.special_token_pattern(cf.SPECIAL_TOKENS))
_SPECIAL = f"CASE WHEN {_TOKENS} > 0 THEN [least(0.95::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * (least(21, {_TOKENS}) - 1))] ELSE [] END"
_TOOL_SCORED = "w AS (" + SCORED_SQL.split("), w AS (", 1)[1].replace(" AS ws, (", f" || {_SPECIAL} AS ws, (", 1)


@query("tool_arguments", f"""WITH {_TOOL_DOCS}, {_TOOL_SCORED}
SELECT doc_id, coalesce(lang IN ('en', 'de'), false) AS allowed, CASE WHEN lang IN ('en', 'de') THEN round(score, 6) ELSE 1.0 END AS score,
CASE WHEN lang IN ('en', 'de') AND would = 'allow' THEN 'allow' ELSE 'block' END AS verdict FROM judged""")
def tool_arguments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.struct("doc_id", F.expr(_NOTE).alias("note")).alias("arguments"))
    allow = spark.createDataFrame([("en",), ("de",)], "lang string")
    out = toolcalls.judge_tool_calls(d, allow, name="lang")
    return out.select("doc_id", "allowed", F.round("score", 6).alias("score"), "verdict")
