"""Ordered folds over groups of any size: what a row adds hangs on all rows of its group before it.

Rows are dealt into ranges of (group, order), so a group with a third of all rows lies in many partitions, and
are kept there by a checkpoint. A first pass sums up each partition's last group: what a fold does to any state that may
enter there. The driver chains these summaries, a few numbers for a partition, to the state in which each
partition begins. A second pass applies the fold, batch by batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import checkpointed


class Fold:
    """States and summaries are small picklable values. ``values`` are lists, one for each input column."""

    #: Names of input columns, and DDL and Arrow types of the columns that are added.
    inputs: list[str]
    adds: dict[str, tuple[str, pa.DataType]]

    def start(self) -> Any:
        """The state before a group's first row."""
        raise NotImplementedError

    def apply(self, state: Any, values: list[list]) -> tuple[list[list], Any]:
        """The added columns for some rows, and the state after them."""
        raise NotImplementedError

    def summary(self) -> Any:
        """What no rows do."""
        raise NotImplementedError

    def extend(self, summary: Any, values: list[list]) -> Any:
        """What the summed-up rows and then these do."""
        raise NotImplementedError

    def after(self, state: Any, summary: Any) -> Any:
        """The state in which the summed-up rows leave a state."""
        raise NotImplementedError


def _runs(batch: pa.RecordBatch, keys: list[int]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of runs of rows with one key."""
    rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
    start = 0
    for at in range(1, len(rows) + 1):
        if at == len(rows) or rows[at] != rows[start]:
            yield rows[start], start, at
            start = at


def _values(batch: pa.RecordBatch, inputs: list[int], start: int, end: int) -> list[list]:
    return [batch.column(k).slice(start, end - start).to_pylist() for k in inputs]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold, parts: int | None = None) -> DataFrame:
    """df with the fold's columns; rows of a group are taken by ``order``. Null keys form a group of their own; without
    keys, all rows are one group.

    Rows that are equal in all keys and order columns lie in one partition, and are taken by their other columns'
    hash. Columns that df has already are replaced."""
    spark = df.sparkSession
    base = df.drop(*fold.adds)
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    simple = [f.name for f in base.schema if f.dataType.typeName() not in ("map", "variant")]
    tie = F.xxhash64(*simple)
    dealt = base.repartitionByRange(n, *keys, *order)
    held = checkpointed(dealt.sortWithinPartitions(*keys, *order, tie))
    key_at, input_at = [base.columns.index(k) for k in keys], [base.columns.index(k) for k in fold.inputs]
    names, begins = [*base.columns, *fold.adds], _begins(held, key_at, input_at, fold)
    sent = spark.sparkContext.broadcast(begins)  # a state for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = sent.value.get(TaskContext.get().partitionId(), (None, None))
        begun = key is not None
        for batch in batches:
            added: list[list] = [[] for _ in fold.adds]
            for own, start, end in _runs(batch, key_at):
                if not begun or own != key:
                    key, state, begun = own, fold.start(), True
                columns, state = fold.apply(state, _values(batch, input_at, start, end))
                for all_rows, some in zip(added, columns, strict=True):
                    all_rows.extend(some)
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(added, fold.adds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    schema = StructType([*base.schema.fields, *StructType.fromDDL(", ".join(f"{k} {ddl}" for k, (ddl, _) in fold.adds.items())).fields])
    return held.mapInArrow(run, schema)


def _begins(held: DataFrame, key_at: list[int], input_at: list[int], fold: Fold) -> dict[int, tuple]:
    """For partitions whose first group began before them: (key, state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = summary = None
        alone, any_row = True, False
        for batch in batches:
            for own, start, end in _runs(batch, key_at):
                if not any_row:
                    first, last, summary, any_row = own, own, fold.summary(), True
                elif own != last:
                    last, summary, alone = own, fold.summary(), False
                summary = fold.extend(summary, _values(batch, input_at, start, end))
        if any_row:
            told = pickle.dumps((first, last, alone, summary))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([told], pa.binary())], ["part", "told"])

    begins, key, state = {}, None, None
    for row in held.mapInArrow(run, "part int, told binary").orderBy("part").toLocalIterator():
        first, last, alone, summary = pickle.loads(row["told"])
        entered = state if key is not None and key == first else None
        if entered is not None:
            begins[row["part"]] = (key, entered)
        state = fold.after(entered if alone and entered is not None else fold.start(), summary)
        key = last
    return begins


class Decayed(Fold):
    """c(n) = decay * c(n - 1) + value(n), where null counts as 0."""

    def __init__(self, value: str, into: str, decay: float):
        self.inputs, self.adds, self.decay = [value], {into: ("double", pa.float64())}, decay

    def start(self) -> float:
        return 0.0

    def apply(self, state: float, values: list[list]) -> tuple[list[list], float]:
        out = []
        for v in values[0]:
            state = self.decay * state + (v or 0.0)
            out.append(state)
        return [out], state

    def summary(self) -> tuple[int, float]:
        return 0, 0.0

    def extend(self, summary: tuple[int, float], values: list[list]) -> tuple[int, float]:
        return summary[0] + len(values[0]), self.apply(summary[1], values)[1]

    def after(self, state: float, summary: tuple[int, float]) -> float:
        return self.decay ** summary[0] * state + summary[1]


class Running(Fold):
    """What stood before a row: the sum of the values of its group's earlier rows; null counts as 0."""

    def __init__(self, value: str, into: str):
        self.inputs, self.adds = [value], {into: ("bigint", pa.int64())}

    def start(self) -> int:
        return 0

    def apply(self, state: int, values: list[list]) -> tuple[list[list], int]:
        out = []
        for v in values[0]:
            out.append(state)
            state += v or 0
        return [out], state

    def summary(self) -> int:
        return 0

    def extend(self, summary: int, values: list[list]) -> int:
        return summary + sum(v or 0 for v in values[0])

    def after(self, state: int, summary: int) -> int:
        return state + summary


class Breaker(Fold):
    """A circuit breaker over attempts (time in microseconds, ok): closed until so many failures in a row, then open for
    a while, then half open: one attempt decides. Adds the state that an attempt meets and whether it is made.

    A state is a number of failures in a row, or (time,) of the failure that opened it. The summary of a range says
    what becomes of each number, and of openings by their time: pieces (latest opening, state), of which those
    that come to one state are one. Openings later than the last piece's are still open."""

    adds = {"state": ("string", pa.string()), "allowed": ("boolean", pa.bool_())}

    def __init__(self, ts: str, ok: str, failures: int = 5, cool_us: int = 30_000_000):
        self.inputs, self.failures, self.cool = [ts, ok], failures, cool_us

    def start(self) -> int:
        return 0

    def step(self, state: int | tuple, t: int, ok: bool) -> int | tuple:
        if isinstance(state, tuple):
            return state if t - state[0] < self.cool else 0 if ok else (t,)
        return 0 if ok else state + 1 if state + 1 < self.failures else (t,)

    def apply(self, state: int | tuple, values: list[list]) -> tuple[list[list], int | tuple]:
        names, allowed = [], []
        for t, ok in zip(*values, strict=True):
            opened = isinstance(state, tuple)
            rests = opened and t - state[0] < self.cool
            names.append("open" if rests else "half-open" if opened else "closed")
            allowed.append(not rests)
            state = self.step(state, t, bool(ok))
        return [names, allowed], state

    def summary(self) -> tuple[list, list]:
        return list(range(self.failures)), []

    def extend(self, summary: tuple[list, list], values: list[list]) -> tuple[list, list]:
        closed, pieces = list(summary[0]), list(summary[1])
        for t, ok in zip(*values, strict=True):
            ok = bool(ok)
            same = closed[0]
            closed = [self.step(same, t, ok)] * len(closed) if all(x == same for x in closed) else [self.step(x, t, ok) for x in closed]
            stepped: list = []
            for latest, state in pieces:
                state = self.step(state, t, ok)
                if stepped and stepped[-1][1] == state:
                    stepped[-1] = (latest, state)
                else:
                    stepped.append((latest, state))
            if not stepped or t - self.cool > stepped[-1][0]:
                state = 0 if ok else (t,)
                if stepped and stepped[-1][1] == state:
                    stepped[-1] = (t - self.cool, state)
                else:
                    stepped.append((t - self.cool, state))
            pieces = stepped
        return closed, pieces

    def after(self, state: int | tuple, summary: tuple[list, list]) -> int | tuple:
        if not isinstance(state, tuple):
            return summary[0][state]
        return next((s for latest, s in summary[1] if state[0] <= latest), state)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of a whole number over the rows before each one in its group."""
    return ordered_fold(df, keys, order, Running(value, into))

