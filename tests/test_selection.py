"""Order statistics against sorted lists, with ranges that have to be narrowed."""

import math
import random

import pytest

from palisade.operators import metrics, selection


@pytest.mark.parametrize("most", [selection.MOST, 5])
def test_statistics_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST", most)
    monkeypatch.setattr(selection, "PARTS", 4)
    r = random.Random(most)
    rows = [("hot", r.choice([1.0, 2.0, 3.0, r.random() * 100])) for _ in range(3000)] + [(None, float(k)) for k in range(37)]
    rows += [("one", 5.0), ("ties", 7.0), ("ties", 7.0), ("none", None), ("odd", float("nan")), ("odd", 1.0), ("odd", float("-inf")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = (0.0, 0.01, 0.5, 0.95, 1.0)
    places = {f"n{i}": selection.nearest_rank(s) for i, s in enumerate(shares)} | {f"f{i}": selection.floor_rank(s) for i, s in enumerate(shares)}
    got = {x["k"]: x for x in selection.order_statistics(df, "v", ["k"], places).collect()}
    assert set(got) == {"hot", None, "one", "ties", "odd"}
    for key, row in got.items():
        values = sorted((v for k, v in rows if k == key and v is not None), key=lambda v: (math.isnan(v), v))
        for i, s in enumerate(shares):
            for name, at in ((f"n{i}", max(math.ceil(len(values) * s) - 1, 0)), (f"f{i}", min(math.floor(len(values) * s), len(values) - 1))):
                assert str(row[name]) == str(values[at]), (key, name)


def test_one_group_of_all_rows_and_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST", 16)
    df = spark.range(20_000).selectExpr("(id * 7919) % 20011 AS v", "'x' AS k")
    values = sorted((k * 7919) % 20011 for k in range(20_000))
    row = metrics.latency(df, "v").first()
    assert (row["p50"], row["p95"], row["p99"], row["max"]) == (values[9_999], values[18_999], values[19_799], values[-1])
    assert metrics.floor_percentile(df, "v", 0.99, ["k"]).first()["value"] == values[19_800]
    assert metrics.latency(df.limit(0), "v").first()["p50"] is None and metrics.floor_percentile(df.limit(0), "v", 0.5, ["k"]).count() == 0
