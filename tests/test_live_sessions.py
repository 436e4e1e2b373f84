"""Sessions in a stream, with gaps, resets, a restart and initial state, equal sessions in batch."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import session
from palisade.streaming import scanners

_START = dt.datetime(2024, 1, 1)
_KINDS = "conv_id string, ts timestamp, score double"


def _messages(seed, n, convs=6):
    """Turns and resets (no score) in order of time, with gaps of any length, some of just half an hour."""
    r, t, out = random.Random(seed), 0, []
    last = {}
    for _ in range(n):
        c = f"c{r.randrange(convs)}"
        t += r.choice([1, 5, 60, 400])
        if c in last and r.random() < 0.15:
            t = max(t, last[c] + r.choice([1800, 1801, 4000]))
        last[c] = t
        out.append((c, _START + dt.timedelta(seconds=t), None if r.random() < 0.08 else round(r.random(), 3)))
    return out


def _plain(messages, held=None):
    """(conv, ts) -> (score, cumulative, delta, number of the turn), and what is kept of each conversation."""
    held, out = dict(held or {}), {}
    for c, ts, score in messages:
        ms = int(ts.replace(tzinfo=dt.UTC).timestamp() * 1000)
        if score is None:
            held.pop(c, None)
            continue
        last = held.get(c)
        if last and ms - last[0] > 1_800_000:
            last = None
        total = 0.8 * (last[2] if last else 0.0) + score
        n = last[3] + 1 if last else 1
        out[c, ms] = (score, total, None if last is None else score - last[1], n)
        held[c] = (ms, score, total, n)
    return out, held


def _run(spark, frame, where, check, initial=None):
    made = scanners.live_sessions(spark.readStream.schema(_KINDS).option("maxFilesPerTrigger", 1).parquet(str(where)), initial, late="10 minutes")
    q = made.writeStream.format("parquet").option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start(str(where) + "-out")
    q.awaitTermination(300)
    return q


def _told(spark, where):
    rows = spark.read.parquet(str(where) + "-out").collect()
    return {(r["conv_id"], r["ms"]): (r["score"], pytest.approx(r["cumulative"]), None if r["delta"] is None or pd.isna(r["delta"]) else pytest.approx(r["delta"]), r["n_turns"]) for r in rows}


def test_gaps_resets_and_a_restart(spark, tmp_path):
    messages = _messages(1, 240)
    where, check = tmp_path / "in", tmp_path / "check"
    for part in (messages[:120], messages[120:]):  # the second run begins from the first one's checkpoint
        spark.createDataFrame(part, _KINDS).coalesce(1).write.mode("append").parquet(str(where))
        _run(spark, None, where, check)
    want, held = _plain(messages)
    got = _told(spark, where)
    assert got == want
    # what is kept: all sessions that the watermark hasn't passed, and none that it has
    now = {r["conv_id"]: (r["last_ms"], r["last_score"], r["cumulative"], r["n_turns"]) for r in scanners.read_sessions(spark, str(check)).collect()}
    end = max(int(ts.replace(tzinfo=dt.UTC).timestamp() * 1000) for _, ts, _ in messages)
    live = {c: v for c, v in held.items() if v[0] + 1_800_000 >= end - 600_000}
    assert live and set(live) <= set(now) <= set(held)
    assert all(now[c] == (v[0], v[1], pytest.approx(v[2]), v[3]) for c, v in held.items() if c in now)


def test_initial_state(spark, tmp_path):
    messages = _messages(2, 40, convs=3)
    first = int(_START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    held = {"c0": (first - 1000, 0.5, 1.5, 4), "c1": (first - 10_000_000, 0.9, 3.0, 9)}
    initial = spark.createDataFrame([(c, *v) for c, v in held.items()], "conv_id string, last_ms long, last_score double, cumulative double, n_turns long")
    spark.createDataFrame(messages, _KINDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(spark, None, tmp_path / "in", tmp_path / "check", initial)
    assert _told(spark, tmp_path / "in") == _plain(messages, held)[0]


def test_state_equals_the_batch_form(spark, tmp_path):
    messages = [m for m in _messages(3, 60, convs=4) if m[2] is not None]
    gaps = spark.createDataFrame(messages, _KINDS)
    spark_rows = session.sessions_by_gap(gaps, "conv_id", "ts")
    last = spark_rows.groupBy("conv_id").agg(F.max("session_no").alias("last"))
    recent = spark_rows.join(last, "conv_id").where("session_no = last")
    batch = {r["conv_id"]: (r["last_score"], r["cumulative"], r["n_turns"]) for r in session.live_state(recent, "conv_id", "ts", "score").collect()}
    held = _plain(messages)[1]
    assert batch == {c: (v[1], pytest.approx(v[2]), v[3]) for c, v in held.items()}
