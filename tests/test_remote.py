"""A provider behind a local server that answers late, fails and answers badly; and verdicts kept across batches."""

import asyncio
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from palisade.operators import remote, verdicts

_PEAK = {"now": 0, "most": 0, "texts": []}
_LOCK = threading.Lock()


class _Judge(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["text"] if "text" in body else body["messages"][0]["content"]
        with _LOCK:
            _PEAK["now"] += 1
            _PEAK["most"] = max(_PEAK["most"], _PEAK["now"])
            _PEAK["texts"].append(text)
        time.sleep(1.5 if "late" in text else 0.03)
        with _LOCK:
            _PEAK["now"] -= 1
        answer = json.dumps({"score": len(text) / 100, "label": "injection", "categories": ["a", "b"]})
        if "chat" in self.path:
            answer = json.dumps({"choices": [{"message": {"content": 'I say {"label": "benign"} so' if "kind" in text else "nothing"}}]})
        answer = {"bad json": "{", "no score": '{"label": "x"}', "nan": '{"score": NaN}', "huge": '{"score": 7}', "list": "[1]"}.get(text, answer).encode()
        try:
            self.send_response(503 if text == "fail" else 200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)
        except OSError:
            pass  # the caller has gone


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Judge)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_in_order_and_errors_of_rows(spark, url):
    texts = ["fine", "late one", "fail", "bad json", "no score", "nan", "huge", "list", None, "", "é" * 10, *(f"text {'x' * (k % 40)}" for k in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    _PEAK["most"] = 0
    got = {r["id"]: r for r in remote.remote_scores(rows, "text", remote.http_guard(url), concurrency=5, seconds=1.0, delimited=False).collect()}
    assert 1 < _PEAK["most"] <= 10  # two tasks
    for n, t in enumerate(texts):
        r = got[n]
        if t is None:
            assert (r["score"], r["error"]) == (None, None)
        elif t in ("late one", "fail", "bad json", "no score", "nan", "list"):
            assert r["score"] is None and {"late one": "timeout", "fail": "status 503", "bad json": "JSONDecodeError"}.get(t, "no score") in r["error"]
        elif t == "huge":
            assert (r["score"], r["error"]) == (1.0, None)
        else:
            assert (r["score"], r["label"], r["categories"], r["error"]) == (pytest.approx(len(t) / 100), "injection", ["a", "b"], None)


def test_delimited_texts_other_columns_and_chat(spark, url):
    rows = spark.createDataFrame([(1, "kind words", 0.1)], "id int, text string, score double")
    _PEAK["texts"].clear()
    assert remote.remote_scores(rows, "text", remote.http_guard(url), seconds=5.0).first()["error"] is None
    begin, text, end = _PEAK["texts"][0].split("\n")
    assert begin == end and len(begin) > 30 and text == "kind words"
    r = remote.remote_scores(rows, "text", remote.chat_guard(f"{url}/chat", "m", lambda t: f"Judge: {t}", "k"), seconds=5.0).first()
    assert (r["score"], r["label"], r["text"]) == (0.0, "benign", "kind words")
    other = rows.withColumn("text", F.lit("rude"))
    assert "no JSON" in remote.remote_scores(other, "text", remote.chat_guard(f"{url}/chat", "m", lambda t: t), seconds=5.0).first()["error"]


def test_unreachable_and_broken_providers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    got = remote.remote_scores(rows, "text", remote.http_guard("http://127.0.0.1:9"), seconds=2.0).orderBy("id").collect()
    assert got[0]["error"] and got[1]["error"] is None

    def load():
        raise OSError("no model")

    got = remote.remote_scores(rows, "text", load).orderBy("id").collect()
    assert got[0]["error"] == "OSError: no model" and got[1]["error"] is None
    assert remote.remote_scores(rows.limit(0), "text", load).count() == 0


def test_attempts_and_bounds():
    state = {"calls": 0, "now": 0, "most": 0}

    async def scan(text):
        state["calls"] += 1
        state["now"] += 1
        state["most"] = max(state["most"], state["now"])
        await asyncio.sleep(0.001)
        state["now"] -= 1
        if state["calls"] % 2:
            raise OSError("now and then")
        return {"score": 0.5}

    got = asyncio.run(remote.called(scan, ["x"], attempts=2))
    assert got[0][0] == 0.5 and state["calls"] == 2
    asyncio.run(remote.called(scan, ["x"] * 50, concurrency=7))
    assert state["most"] == 7


def _judge(met):
    def judge(rows):
        met.append(sorted(r["matching"] for r in rows.select("matching").collect()))
        return rows.withColumn("score", F.length("matching") / 10).withColumn("verdict", F.when(F.length("matching") > 3, "block").otherwise("allow"))

    return judge


def test_second_run_judges_new_keys_only(spark, tmp_path):
    store, met = verdicts.VerdictStore(spark, str(tmp_path / "store"), buckets=5), []
    rows = [(n, t, s, r, lo) for n, (t, s, r, lo) in enumerate([("abc", "web", False, None), ("abc", "web", False, None), ("abc", "web", True, None), ("abc", None, False, None), ("abc", "user", None, ""), ("abcdef", "web", False, "en"), ("", "web", False, None)] + [("hot", "web", False, None)] * 300)]
    schema = "id int, matching string, source string, risk boolean, lang string"

    def run(table):
        return {r["id"]: r for r in verdicts.cached_verdicts(spark.createDataFrame(table, schema), store, _judge(met), source="source", high_risk="risk", locale="lang").collect()}

    first = run(rows)
    assert met[0] == ["", "abc", "abc", "abc", "abcdef", "hot"] and len(first) == len(rows)
    assert not any(r["cached"] for r in first.values()) and first[5]["verdict"] == "block" and first[0]["score"] == pytest.approx(0.3)
    second = run([*rows, (900, "new", "web", False, None), (901, "abc", "web", False, "de")])
    assert met[1] == ["abc", "new"]
    assert {k for k, r in second.items() if not r["cached"]} == {900, 901}
    assert {k: (r["score"], r["verdict"]) for k, r in second.items() if k < 900} == {k: (r["score"], r["verdict"]) for k, r in first.items()}
    run(rows[:3])
    assert met[2] == []
    assert run([]) == {} and met[3] == []


def test_entries_of_two_runs_at_once_and_compaction(spark, tmp_path):
    store = verdicts.VerdictStore(spark, str(tmp_path / "store"), buckets=3)
    assert store.entries() is None
    key = spark.createDataFrame([("k1",), ("k2",)], "key string")
    store.add(key.withColumn("verdict", F.lit("first")))
    time.sleep(0.01)
    store.add(key.withColumn("verdict", F.lit("second")))
    asked = key.unionByName(spark.createDataFrame([("k3",)], "key string")).withColumn("bucket", store.bucket(F.col("key")))
    for s in (store, store.compacted(str(tmp_path / "compact"))):
        assert sorted(map(tuple, s.known(asked).collect())) == [("k1", "first"), ("k2", "first")]
    assert store.compacted(str(tmp_path / "again")).entries().count() == 2


def test_keys_tell_their_parts_apart(spark):
    rows = [("a", "b", False, "c"), ("a:b", "", False, "c"), ("ab", None, True, None), ("a", "b", None, "c"), ("ab", "user", True, "")]
    d = spark.createDataFrame(rows, "m string, s string, r boolean, l string")
    keys = [r[0] for r in d.select(verdicts.verdict_key(*map(F.col, "msrl"))).collect()]
    assert keys[0] == keys[3] and keys[2] == keys[4] and len(set(keys)) == 3
