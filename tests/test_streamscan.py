"""Streams scanned as they grow equal streams that are scanned whole after each chunk."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F
from test_streaming import run_stream

from palisade.config import Policy
from palisade.functions import regexlib as rx
from palisade.operators import session, streamscan
from palisade.streaming import scanners

_PIECES = (
    "ignore", "all", "previous", "instructions", " ", " ", ":", ".", "system", "<|im_start|>", "<|im_", "start|>", "the", "rules", "call the tool", "to", "send",
    "é", "_", "x", "reveal", "your", "prompt", "do not say", "you can't", "http://a?", "secret", "](javascript:", "[", "![", ")", "new rules", "role", '"',
    "admin", "<policy>", "tool_call", "hidden", "above", "dan", "{", "}", "<script", " src=", "fetch(", "'https://a", "\n", "\t", "ruleset", "İ", "SYSTEM", "￿",
)
_WHOLE = [regex.compile(r.pattern, regex.ASCII) for r in rx.RULES]


def _pieces(r, most=40):
    text = "".join(r.choice(_PIECES) for _ in range(r.randint(1, most)))
    out = []
    while text:
        n = r.choice([1, 1, 2, 3, 5, 8, 13])
        out.append(text[:n])
        text = text[n:]
    return out


def _quadratic(chunks, most):
    """(counts, cut) after each chunk."""
    out, text = [], ""
    for c in chunks:
        text += c
        raw = text.encode()
        low = raw[:most].decode(errors="ignore").lower().replace("￿", "")
        out.append(([min(21, sum(1 for _ in p.finditer(low))) for p in _WHOLE], len(raw) > most))
    return out


@pytest.mark.parametrize("most", [65536, 90])
def test_counts_after_each_chunk(most):
    r = random.Random(most)
    for _ in range(400):
        chunks, told = _pieces(r), [([0] * len(_WHOLE), False)]

        def judge(counts, cut, told=told):
            told.append((list(counts), cut))
            return 0

        scan = streamscan.StreamScan(judge, most)
        want = _quadratic(chunks, most)
        for c, w in zip(chunks, want, strict=True):
            scan.push(c)
            assert told[-1] == w  # beyond the end nothing is told anew
            scan = streamscan.StreamScan(judge, most).of(scan.state())


def test_time_is_linear():
    def seconds(n):
        scan, began = streamscan.StreamScan(streamscan.by_presence, 10**9), time.process_time()
        for _ in range(n):
            scan.push("some text: the system goes on, and the rules ")
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 8 * seconds(2000) and len(streamscan.StreamScan(streamscan.by_presence).state()[0]) < 200


def test_batch_equals_the_quadratic_form(spark):
    r = random.Random(3)
    rows = [(s, n, c) for s in range(60) for n, c in enumerate(_pieces(r, 25))]
    rows += [(100, 0, None), (100, 1, ""), (101, 5, "<|im_start|>"), (101, 2, "x"), (None, 1, "ignore all previous "), (None, 2, "instructions")]
    rows += [(200, n, "reveal the pro" if n == 1500 else "mpt" if n == 1501 else "a ") for n in range(3000)]  # a hot stream
    chunks = spark.createDataFrame(rows, "s int, n int, chunk string").repartition(6)
    got = sorted(map(tuple, streamscan.scan_chunks(chunks, "s", "n", "chunk").collect()), key=str)
    d = session.stream_prefixes(chunks, "s", "n", "chunk")
    found = [(r["s"], r["n"], r["chunk"], (r["buffer"] or "").lower()) for r in d.collect()]
    ranks = {}
    for s, n, _, low in found:
        counts = [sum(1 for _ in p.finditer(low.replace("￿", ""))) for p in _WHOLE]
        ranks[s, n] = streamscan.by_presence(counts, False)
    names = ("allow", "flag", "block")
    want = [(s, n, c, names[max(v for (t, m), v in ranks.items() if t == s and m <= n)]) for s, n, c, _ in found]
    assert got == sorted(want, key=str)


def test_streaming_equals_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"s{s}", n, c) for s in range(25) for n, c in enumerate(_pieces(r, 25))]
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    judge = streamscan.by_policy(Policy())
    want = {(x["stream_id"], x["seq"]): x["worst"] for x in streamscan.scan_chunks(df, "stream_id", "seq", "chunk", judge, collapse=True).collect()}
    got = {(x["stream_id"], x["seq"]): x["worst"] for x in run_stream(spark, df, tmp_path, lambda s: scanners.scan_rules(s, judge))}
    assert got == want and {"allow", "flag", "block"} <= set(want.values())


def test_policies():
    counts = [0] * len(rx.RULES)
    hard = list(counts)
    hard[0] = 1
    soft = list(counts)
    soft[[r.name for r in rx.RULES].index("instruction_override_1")] = 1
    for policy, c, cut, want in (
        (Policy(), counts, False, 0), (Policy(), counts, True, 0), (Policy(flag=0.3), counts, True, 1), (Policy(), hard, False, 2), (Policy(), soft, False, 1),
        (Policy(mode="shadow"), hard, False, 0), (Policy(mode="soft"), hard, False, 1), (Policy(hard_block_rules=()), hard, False, 2),
    ):
        assert streamscan.by_policy(policy)(c, cut) == want
    assert streamscan.by_policy(Policy(), high_risk=True)(soft, False) == 2


def test_a_cut_stream_counts_as_truncated(spark):
    rows = [(1, 0, "x" * 50), (1, 1, "y" * 20), (1, 2, "<|im_start|>")]
    d = streamscan.scan_chunks(spark.createDataFrame(rows, "s int, n int, c string"), "s", "n", "c", streamscan.by_policy(Policy(flag=0.3)), most=60)
    assert [r["worst"] for r in d.orderBy("n").collect()] == ["allow", "flag", "flag"]
    assert d.where(F.col("worst") == "block").isEmpty()
