"""Structured Streaming: chunked streams that are scanned as they grow, and session risk over turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as cf
from ..operators.streamscan import Judge, StreamScan

_NAMES = ("allow", "flag", "block")
_RANK = {"allow": 0, "flag": 1, "block": 2}
SCANNED = "stream_id string, seq long, partial string, worst string, abort boolean"
LIVE = "conv_id string, ms long, score double, cumulative double, delta double, n_turns long"
SESSIONS = "conv_id string, turn long, score double, cumulative double, delta double, n_turns int"


class StreamScanner(StatefulProcessor):
    """Keeps each stream's buffer and worst verdict. ``verdict`` judges a whole text; rows of a micro-batch come in
    any order, so they are sorted by their number first."""

    def __init__(self, verdict: Callable[[str], str], most: int = cf.MAX_SCAN_BYTES):
        self.verdict, self.most = verdict, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "buffer string, worst string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        buffer, worst = self.state.get() if self.state.exists() else ("", "allow")
        out = []
        for seq, chunk in zip(new["seq"], new["chunk"], strict=True):
            buffer = (buffer + (chunk or "")).encode()[: self.most].decode(errors="ignore")
            worst = max(worst, self.verdict(buffer), key=_RANK.get)
            out.append((key[0], seq, chunk or "", worst, worst == "block"))
        self.state.update((buffer, worst))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "partial", "worst", "abort"])

    def close(self) -> None:
        pass


class RuleScanner(StatefulProcessor):
    """The rule bank over each stream, in linear time: keeps the tail that a match may still need, see StreamScan."""

    def __init__(self, judge: Judge, most: int = cf.MAX_SCAN_BYTES, collapse: bool = True):
        self.judge, self.most, self.collapse = judge, most, collapse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "text string, n_bytes long, cut boolean, rank int, settled array<int>, restart array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        scan = StreamScan(self.judge, self.most, self.collapse)
        if self.state.exists():
            scan.of(self.state.get())
        out = []
        for seq, chunk in zip(new["seq"], new["chunk"], strict=True):
            worst = scan.push(chunk)
            out.append((key[0], seq, chunk or "", _NAMES[worst], worst == 2))
        self.state.update(scan.state())
        yield pd.DataFrame(out, columns=["stream_id", "seq", "partial", "worst", "abort"])

    def close(self) -> None:
        pass


class SessionRisk(StatefulProcessor):
    """Keeps each conversation's decayed sum, last score and number of turns, for as long as the TTL."""

    def __init__(self, decay: float = cf.SESSION_DECAY, ttl_ms: int = cf.SESSION_TTL_SECONDS * 1000):
        self.decay, self.ttl = decay, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "cumulative double, last double, turns int", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("turn")
        total, last, turns = self.state.get() if self.state.exists() else (0.0, None, 0)
        out = []
        for turn, score in zip(new["turn"], new["score"], strict=True):
            total = self.decay * total + score
            out.append((key[0], turn, score, total, None if last is None else score - last, min(turns + 1, cf.SESSION_TURNS)))
            last, turns = score, turns + 1
        self.state.update((total, last, turns))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "score", "cumulative", "delta", "n_turns"])

    def close(self) -> None:
        pass


class LiveSessions(StatefulProcessor):
    """Keeps what live_state() tells of each conversation: last turn's time and score, decayed sum and number of turns.

    A turn that comes strictly later than ``idle`` after the last one begins anew; a reset (score null) forgets. Both go by
    the messages' own times, so a restart or a slow stream changes nothing. A timer in event time forgets
    conversations that stay idle, when the watermark has passed them: nothing that a later turn could tell apart."""

    def __init__(self, decay: float = cf.SESSION_DECAY, idle_seconds: int = cf.SESSION_TTL_SECONDS):
        self.decay, self.idle_ms = decay, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "last_ms long, last_score double, cumulative double, n_turns long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ms", "score"], na_position="first")
        held = self.state.get() if self.state.exists() else None
        out = []
        for ms, score in zip(new["ms"].astype("int64"), new["score"], strict=True):
            if pd.isna(score):
                held = None
                continue
            if held is not None and ms - held[0] > self.idle_ms:
                held = None
            last, total, turns = (held[1], held[2], held[3]) if held else (None, 0.0, 0)
            total = self.decay * total + score
            out.append((key[0], ms, score, total, None if last is None else score - last, turns + 1))
            held = (int(ms), float(score), float(total), turns + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)
            self.handle.registerTimer(held[0] + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["conv_id", "ms", "score", "cumulative", "delta", "n_turns"])

    def handleExpiredTimer(self, key: Any, timer_values: Any, expired: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] + self.idle_ms < expired.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({c: [] for c in ("conv_id", "ms", "score", "cumulative", "delta", "n_turns")})

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timer_values: Any) -> None:
        """Sessions that are carried over: rows as live_state() has them, with last_ms."""
        row = initial.iloc[0]
        self.state.update((int(row["last_ms"]), float(row["last_score"]), float(row["cumulative"]), int(row["n_turns"])))
        self.handle.registerTimer(int(row["last_ms"]) + self.idle_ms + 1)

    def close(self) -> None:
        pass


def scan_streams(chunks: DataFrame, verdict: Callable[[str], str]) -> DataFrame:
    """chunks (stream_id string, seq long, chunk string), streaming -> SCANNED rows. Needs the RocksDB state store."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(StreamScanner(verdict), SCANNED, "Append", "None")


def scan_rules(chunks: DataFrame, judge: Judge, most: int = cf.MAX_SCAN_BYTES, collapse: bool = True) -> DataFrame:
    """scan_streams() by the rule bank; ``judge`` is by_presence or by_policy(...)."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(RuleScanner(judge, most, collapse), SCANNED, "Append", "None")


def session_risk(turns: DataFrame) -> DataFrame:
    """turns (conv_id string, turn long, score double), streaming -> SESSIONS rows. Needs the RocksDB state store."""
    return turns.groupBy("conv_id").transformWithStateInPandas(SessionRisk(), SESSIONS, "Append", "ProcessingTime")


def live_sessions(
    messages: DataFrame, initial: DataFrame | None = None, decay: float = cf.SESSION_DECAY, idle_seconds: int = cf.SESSION_TTL_SECONDS, late: str = "0 seconds"
) -> DataFrame:
    """messages (conv_id string, ts timestamp, score double; a null score is a reset), streaming -> LIVE rows, one a turn.

    ``initial``: (conv_id, last_ms, last_score, cumulative, n_turns) of sessions to begin with. State is read back with
    read_sessions(). Needs the RocksDB state store."""
    timed = messages.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    grouped = initial.groupBy("conv_id") if initial is not None else None
    return timed.groupBy("conv_id").transformWithStateInPandas(LiveSessions(decay, idle_seconds), LIVE, "Append", "EventTime", grouped)


def read_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped query's checkpoint holds: conv_id, last_ms, last_score, cumulative, n_turns."""
    held = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    return held.select(F.col("key.conv_id").alias("conv_id"), "value.*")
