"""Streams of chunks that are scanned as they grow, in linear time.

After each chunk the rule bank judges all text so far. A rule's matches before its *restart* can't change any
more, whatever follows: no match that begins earlier may still need text beyond the end. So a rule keeps the
number of its settled matches and its restart, and a stream the text from the least restart on.

A restart is found by the rule's own pattern. Behind it stands a symbol that no text holds, so an attempt ends only by
failing or by reaching the text's end; the leftmost one that reaches it is where the rest has to be looked at again.
At the end a word border is taken to hold, as the next character decides on it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cf
from ..functions import regexlib as rx
from ..functions.scoring import verdict_of_rank
from .folds import running_total

#: What stands for the text that may follow; streams drop it.
_NEVER = "\uffff"
MOST_MATCHES = 21
#: counts of the bank's rules, and whether the text was cut -> 0 allow, 1 flag, 2 block.
Judge = Callable[[list[int], bool], int]
_SPACE = regex.compile(r"\s+", regex.ASCII)


class _Rule:
    def __init__(self, rule: rx.Rule):
        self.whole = regex.compile(rule.pattern, regex.ASCII)
        open_end = rule.pattern.replace(r"\b", r"(?:\b|\Z)")
        self.open = regex.compile(f"(?:{open_end}){_NEVER}", regex.ASCII)

    def settle(self, text: str, at: int) -> tuple[int, int, int]:
        """(settled matches from ``at`` on, the new restart, matches from there on)."""
        settled = 0
        while True:
            alive = self.open.search(text, at, partial=True)
            restart = alive.start() if alive else len(text)
            match = self.whole.search(text, at)
            if match is None or match.start() >= restart:
                break
            settled, at = settled + 1, match.end()
        return settled, restart, sum(1 for _ in self.whole.finditer(text, restart)) if match else 0


_bank: list[_Rule] = []


def bank() -> list[_Rule]:
    """The rules, compiled once per worker."""
    if not _bank:
        _bank.extend(map(_Rule, rx.RULES))
    return _bank


class StreamScan:
    """One stream's scan: the text from the least restart on, with a character before it, and each rule's settled
    matches and restart in that text. ``state`` and ``of`` carry it over as plain values."""

    def __init__(self, judge: Judge, most: int = cf.MAX_SCAN_BYTES, collapse: bool = False):
        self.judge, self.most, self.collapse = judge, most, collapse
        self.text, self.n_bytes, self.cut, self.rank = "", 0, False, 0
        self.settled, self.restart = [0] * len(rx.RULES), [0] * len(rx.RULES)

    def push(self, chunk: str | None) -> int:
        """The worst rank so far. Beyond ``most`` bytes nothing is read."""
        was_cut, new = self.cut, self._taken(chunk or "")
        if new or self.cut > was_cut:
            counts = self._scanned(new)
            self.rank = max(self.rank, self.judge(counts, self.cut))
        return self.rank

    def _taken(self, chunk: str) -> str:
        if self.cut:
            return ""
        raw = chunk.encode()
        left = self.most - self.n_bytes
        if len(raw) > left:
            self.cut, raw = True, raw[:left]
            chunk = raw.decode(errors="ignore")  # a character that doesn't fit whole is left out
        self.n_bytes += len(raw)
        low = chunk.lower().replace(_NEVER, "")
        if not self.collapse:
            return low
        low = _SPACE.sub(" ", low)
        return low[1:] if low[:1] == " " == self.text[-1:] else low

    def _scanned(self, new: str) -> list[int]:
        text, counts = self.text + new, []
        for k, rule in enumerate(bank()):
            settled, self.restart[k], more = rule.settle(text, self.restart[k])
            self.settled[k] += settled
            counts.append(min(MOST_MATCHES, self.settled[k] + more))
        keep = max(min(self.restart) - 1, 0)  # the character before tells a word border
        self.text, self.restart = text[keep:], [r - keep for r in self.restart]
        return counts

    def state(self) -> tuple:
        return self.text, self.n_bytes, self.cut, self.rank, self.settled, self.restart

    def of(self, state: tuple) -> StreamScan:
        self.text, self.n_bytes, self.cut, self.rank, settled, restart = state
        self.settled, self.restart = list(settled), list(restart)
        return self


def by_presence(counts: list[int], cut: bool) -> int:
    """Any rule flags, a hard one blocks."""
    return 2 if any(n and r.hard for n, r in zip(counts, rx.RULES, strict=True)) else int(any(counts))


def by_policy(policy: cf.Policy, high_risk: bool = False) -> Judge:
    """Score, thresholds and mode of a policy, as for whole texts."""

    def judge(counts: list[int], cut: bool) -> int:
        left, hard = 0.7 if cut else 1.0, False
        for n, r in zip(counts, rx.RULES, strict=True):
            if n:
                left *= 1.0 - min(1.0, r.cap, r.weight + r.boost * (n - 1))
                hard |= r.hard and (policy.hard_block_rules is True or r.code in (policy.hard_block_rules or ()))
        score = 1.0 - left
        rank = 2 if hard or score >= policy.block else 1 if score >= policy.flag else 0
        rank = 2 if high_risk and rank == 1 else rank
        return 0 if policy.mode == "shadow" else min(rank, 1) if policy.mode == "soft" else rank

    return judge


def scan_chunks(
    chunks: DataFrame, key: str, order: str, chunk: str, judge: Judge = by_presence, most: int = cf.MAX_SCAN_BYTES, collapse: bool = False
) -> DataFrame:
    """Adds worst (allow, flag or block): of each stream's text up to each chunk the worst verdict.

    Only the first ``most`` bytes of a stream are ever read, so what meets in one task is bounded by them: chunks are
    placed by a running sum over ranges, those that are empty or lie beyond leave, and a stream's others are
    scanned in order. What comes back are the chunks at which its verdict rose, two at most, and these meet all of
    its chunks. Null chunks count as empty; a null key is a stream; chunks with one number are taken by their text.
    """
    size = F.octet_length(F.coalesce(F.col(chunk), F.lit("")))
    narrow = chunks.select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.col(chunk).alias("_chunk"), size.cast("long").alias("_size"))
    placed = running_total(narrow.where("_size > 0"), ["_key"], ["_at", "_chunk"], "_size", "_before")
    read = placed.where(F.col("_before") <= most).select("_key", "_at", "_chunk")
    kind = chunks.schema[order].dataType.simpleString()

    def scan(stream: pd.DataFrame) -> pd.DataFrame:
        scan, rose = StreamScan(judge, most, collapse), [None, None]
        for at, text in stream.sort_values(["_at", "_chunk"])[["_at", "_chunk"]].itertuples(index=False):
            before, now = scan.rank, scan.push(text)
            for r in range(before, now):
                rose[r] = at
        return pd.DataFrame({"_key": stream["_key"].iloc[:1], "_flag": [rose[0]], "_block": [rose[1]]})

    key_kind = chunks.schema[key].dataType.simpleString()
    rose = read.groupBy("_key").applyInPandas(scan, f"_key {key_kind}, _flag {kind}, _block {kind}")
    met = chunks.join(rose.where("_flag is not null"), chunks[key].eqNullSafe(F.col("_key")), "left")
    rank = F.when(F.col(order) >= F.col("_block"), 2).when(F.col(order) >= F.col("_flag"), 1).otherwise(0)
    return met.withColumn("worst", verdict_of_rank(rank)).drop("_key", "_flag", "_block")
