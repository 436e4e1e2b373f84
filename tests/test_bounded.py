"""Python holds few texts at once, whatever the batch; perturbations are those of Python's own generator."""

import random

import numpy as np
import pyarrow as pa

from palisade.functions import matches
from palisade.operators import egress, escalation, remote


def test_slices_are_bounded_and_whole():
    texts = pa.array(["x" * 400, None, "", "é" * 900, "y"] * 50).slice(3, 200)
    cut = list(matches.slices(texts, 1000))
    assert [at for at, _ in cut] == list(np.cumsum([0, *(len(p) for _, p in cut)])[:-1])
    assert [t for _, p in cut for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 1000 for _, p in cut)


def test_phones_of_long_batches(spark):
    long = "x" * (matches.PYTHON_BYTES // 2)
    rows = [(k, t) for k, t in enumerate([None, "", f"{long} +1 (415) 555-0132", f"{long} 4111 1111 1111 1111", "call 020 7946 0958 now", long])]
    got = dict(spark.createDataFrame(rows, "k int, t string").coalesce(1).select("k", egress.phones("t")).collect())
    assert got == {0: [], 1: [], 2: ["+1 (415) 555-0132"], 3: [], 4: ["020 7946 0958"], 5: []}


def test_calls_wait_for_few_texts_and_carry_what_is_passed(spark):
    def load():
        async def scan(text):
            return {"score": 0.5}

        return scan

    rows = [(k, "x" * (matches.PYTHON_BYTES // 2) if k % 2 else None) for k in range(7)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    out = remote.remote_scores(df, "t", load, seconds=30.0, passed=["k"])
    assert out.columns == ["k", "score", "label", "categories", "error"]
    assert sorted(tuple(r) for r in out.select("k", "score").collect()) == [(k, 0.5 if k % 2 else None) for k in range(7)]
    assert "t" in remote.remote_scores(df, "t", load).columns


def test_perturbations_are_those_of_the_plain_loop(spark):
    def plain(seed, text, p):
        r, out = random.Random(seed), list(text)
        for at in range(len(out)):
            if r.random() < p:
                if r.random() < 0.5 or at + 1 >= len(out):
                    out[at] = ""
                else:
                    out[at], out[at + 1] = out[at + 1], out[at]
        return "".join(out)

    g, state = random.Random(1), np.random.RandomState()
    for k in range(400):
        t = "".join(g.choice("abcdé ") for _ in range(g.choice((0, 1, 2, 3, 40, 900))))
        for p in (0.0, 0.1, 0.6, 1.0):
            assert escalation._perturbed(f"{k}:1", t, p, state) == plain(f"{k}:1", t, p)
    df = spark.createDataFrame([(1, "abc" * 50), (2, None), (3, "")], "k int, t string")
    plan = escalation.smoothing(df, "k", "t", lambda ts: [len(t) / 200 for t in ts])
    got = {r["k"]: round(r["score"], 9) for r in plan.collect()}
    assert got == {1: round(sum(len(plain(f"1:{i}", "abc" * 50, 0.1)) / 200 for i in range(1, 6)) / 5, 9), 2: 0.0, 3: 0.0}
