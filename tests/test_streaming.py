"""Streaming results equal batch results on the same ordered input."""

import shutil

from pyspark.sql import functions as F

from palisade.operators import session
from palisade.streaming import scanners

_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_stream(spark, frame, path, made):
    frame.repartition(1).write.parquet(str(path / "in"))
    out, check = str(path / "out"), str(path / "check")
    stream = made(spark.readStream.schema(frame.schema).parquet(str(path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(180)
    got = spark.read.parquet(out).collect()
    shutil.rmtree(path, ignore_errors=True)
    return got


def test_stream_scanner(spark, tmp_path):
    rows = [("a", 0, "hello <|im_"), ("a", 1, "start|> you"), ("a", 2, ""), ("b", 0, "fine"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    judge = lambda t: "block" if "<|im_start|>" in t else "allow"
    got = {(r["stream_id"], r["seq"]): (r["worst"], r["abort"]) for r in run_stream(spark, df, tmp_path, lambda s: scanners.scan_streams(s, judge))}
    assert got == {("a", 0): ("allow", False), ("a", 1): ("block", True), ("a", 2): ("block", True), ("b", 0): ("allow", False), ("b", 1): ("allow", False)}


def test_session_risk_equals_batch(spark, data, tmp_path):
    d = spark.read.parquet(f"{data}/conversations.parquet").where("conv_id < 20")
    turns = d.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", ((F.col("turn") * 7 + F.col("conv_id")) % 10 / 10.0).alias("score"))
    batch = {(r["conv_id"], r["turn"]): round(r["cumulative"], 9) for r in session.cumulative(turns, ["conv_id"], "turn", "score").collect()}
    got = {(r["conv_id"], r["turn"]): round(r["cumulative"], 9) for r in run_stream(spark, turns, tmp_path, scanners.session_risk)}
    assert got == batch
