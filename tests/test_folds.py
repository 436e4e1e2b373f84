"""Ordered folds over ranges equal folds in one loop, whatever a group's share of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import escalation, folds, session


def _plain_breaker(log, failures, cool):
    run, opened, out = 0, None, []
    for t, ok in log:
        state = "closed" if opened is None else "half-open" if t - opened >= cool else "open"
        if state != "open":
            if ok:
                run, opened = 0, None
            else:
                run += 1
                if state == "half-open" or run >= failures:
                    run, opened = 0, t
        out.append((state, state != "open"))
    return out


def test_summaries_of_a_breaker_equal_its_steps():
    r = random.Random(1)
    fold = folds.Breaker("t", "ok", 3, 10)
    for _ in range(400):
        times = sorted(r.randint(0, 60) for _ in range(r.randint(0, 30)))
        log = [(t, r.random() < r.choice([0.1, 0.5, 0.9])) for t in times]
        cut = r.randint(0, len(log))
        ends = [[list(x) for x in zip(*part, strict=True)] or [[], []] for part in (log[:cut], log[cut:])]
        _, entered = fold.apply(fold.start(), ends[0])
        _, want = fold.apply(entered, ends[1])
        summed = fold.extend(fold.extend(fold.summary(), [v[:7] for v in ends[1]]), [v[7:] for v in ends[1]])
        assert fold.after(entered, summed) == want
        assert [x[0] for x in _plain_breaker(log, 3, 10)] == fold.apply(fold.start(), [list(x) for x in zip(*log, strict=True)] or [[], []])[0][0]


@pytest.mark.parametrize("keys", [1, 5])
def test_breaker_of_hot_keys(spark, keys):
    r = random.Random(keys)
    start, t, rows = dt.datetime(2024, 1, 1), 0, []
    for _ in range(1500):
        t += r.choice([0, 1, 1, 2, 40])
        rows.append((r.choice([None, *range(keys)][: keys + 1]) if keys > 1 else 7, start + dt.timedelta(seconds=t), r.choice([True, False, False, None])))
    attempts = spark.createDataFrame(rows, "k int, ts timestamp, ok boolean")
    got = escalation.breaker_states(attempts, "k", "ts", "ok", failures=3, cool_seconds=30).collect()
    for key in {x[0] for x in rows}:
        log = sorted(((x[1], x[2]) for x in rows if x[0] == key), key=lambda x: (x[0], {None: 0, False: 1, True: 2}[x[1]]))
        want = _plain_breaker([((a - start).total_seconds(), b) for a, b in log], 3, 30)
        own = sorted(((x["ts"], x["ok"], x["state"], x["allowed"]) for x in got if x["k"] == key), key=lambda x: (x[0], {None: 0, False: 1, True: 2}[x[1]]))
        assert sorted(map(str, own)) == sorted(str((a, b, *s)) for (a, b), s in zip(log, want, strict=True))


def test_no_task_holds_a_hot_group(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id", (F.col("id") % 7).alias("v"))
    out = folds.running_total(df, ["k"], ["id"], "v", "before")
    per = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per) > 4 and max(per) < 1500
    total, rows = 0, {r["id"]: r["before"] for r in out.collect()}
    for k in range(4000):
        assert rows[k] == total
        total += k % 7


def test_running_totals_of_odd_rows(spark):
    rows = [(None, 1, 5), (None, 2, None), (None, 3, 1), ("a", 1, 2), ("a", 1, 2), ("b", None, 4)]
    got = folds.running_total(spark.createDataFrame(rows, "k string, o int, v long"), ["k"], ["o"], "v", "before").collect()
    assert sorted((str(r["k"]), r["before"]) for r in got) == [("None", 0), ("None", 5), ("None", 5), ("a", 0), ("a", 2), ("b", 0)]
    assert folds.running_total(spark.createDataFrame([], "k string, o int, v long"), ["k"], ["o"], "v", "before").count() == 0


@pytest.mark.parametrize("decay", [0.0, 0.5, 0.8, 0.99, 1.0])
def test_decayed_sums_of_any_decay(spark, decay):
    turns = spark.range(1000).select(F.lit(1).alias("c"), F.col("id").alias("t"), F.lit(1.0).alias("score"))
    got = {r["t"]: r["cumulative"] for r in session.cumulative(turns, ["c"], "t", "score", decay).collect()}
    want, c = {}, 0.0
    for k in range(1000):
        c = decay * c + 1.0
        want[k] = c
    assert got == pytest.approx(want, rel=1e-12)
