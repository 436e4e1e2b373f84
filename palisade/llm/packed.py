"""Shuffling many small numbers: packed into binary cells, one row per batch and bucket.

Some operators look up a hash for every word of a corpus. As rows these would cost far more than
the numbers themselves, so a task sorts its numbers by bucket and emits one row (bucket,
cells...) per bucket; the rows of a bucket meet in one task, which unpacks them into arrays.
Spark does the dealing, spilling and retrying. There are as many buckets as the session has
shuffle partitions, or more where the input has over BUCKET_BYTES of text for each, so that what
a task holds doesn't grow with the input. A key that is frequent within a batch is resolved or
reduced there, before it is dealt.

Places go back to documents by id. Where one id stands for rows of different texts (the layout
tells), a mark of 64 bits of the text goes with the id; else it costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Bytes of text for each bucket at most.
BUCKET_BYTES = 48 << 20
#: Bytes of text that a task packs at once: these for each bucket, within bounds.
PER_BUCKET, MOST_SLICE = 400, 64 << 20


@dataclass(frozen=True)
class Layout:
    """How a table is dealt: the number of buckets, and whether each id stands for one text only."""

    buckets: int
    unique: bool

    def slice_bytes(self, least: int) -> int:
        """More buckets take longer slices, so that their cells don't shrink to nothing."""
        return max(least, min(PER_BUCKET * self.buckets, MOST_SLICE))

    def mark(self, text: str = "text") -> Column:
        """What tells rows of one id apart: nothing where ids are unique."""
        return F.lit(0).cast("long") if self.unique else F.xxhash64(text)


def layout(rows: DataFrame) -> Layout:
    """Of rows (doc_id, text), by one pass over them that deals an id and two hashes a row."""
    h = rows.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    per_id = h.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("n").alias("n"))
    size, several = per_id.agg(F.sum("n"), F.max(F.col("low") != F.col("high"))).first()
    return Layout(max(shuffle_partitions(rows.sparkSession), -(-(size or 0) // BUCKET_BYTES)), not several)


def planes(numbers: np.ndarray) -> bytes:
    """Bytes of an array, all lowest bytes first, so that a compressing shuffle meets runs of zeros."""
    size = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, size).T.tobytes()


def from_planes(cell: bytes, kind) -> np.ndarray:
    if not cell:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def narrow(numbers: np.ndarray) -> bytes:
    """planes() of non-negative numbers without the planes of zeros at the end, behind a byte with how many are left:
    these would cost nothing once compressed, but take memory wherever a cell is held."""
    size = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize)[:, :size].T.tobytes()


def from_narrow(cell: bytes, kind) -> np.ndarray:
    if len(cell) < 2:
        return np.zeros(0, kind)
    rows = np.frombuffer(cell, np.uint8, offset=1).reshape(cell[0], -1)
    out = np.zeros((rows.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : len(rows)] = rows.T
    return out.reshape(-1).view(kind)


def deltas(sorted_numbers: np.ndarray) -> bytes:
    """planes() of the steps of a non-decreasing array of non-negative numbers."""
    return planes(np.diff(sorted_numbers.astype(np.int64), prepend=0))


def from_deltas(cell: bytes) -> np.ndarray:
    return np.cumsum(from_planes(cell, np.int64))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper 32 bits of 64-bit hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def parts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket starts in it."""
    kind = np.uint16 if buckets <= 1 << 16 else np.int64
    order = np.argsort(bucket.astype(kind), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in kinds], list(kinds))


def dealt(messages: DataFrame, buckets: int, column: str = "bucket") -> DataFrame:
    """One partition per bucket."""
    return messages.repartitionById(buckets, messages[column].cast("int"))


def marks_cell(marks: np.ndarray) -> bytes:
    """Marks of documents; nothing where there are none."""
    return planes(marks) if marks.any() else b""


def from_marks_cell(cell: bytes, many: int) -> np.ndarray:
    return from_planes(cell, np.int64) if cell else np.zeros(many, np.int64)


def gathered(each: Callable[[dict[str, list]], Iterator[pa.RecordBatch]], names: list[str]):
    """A mapInArrow function that hands all rows of a partition to ``each`` as lists by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, list] = {k: [] for k in names}
        for got in batches:
            for k in names:
                cells[k].extend(got.column(got.schema.get_field_index(k)).to_pylist())
        if cells[names[0]]:
            yield from each(cells)

    return run
