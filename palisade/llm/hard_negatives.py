"""Hard-negative mining by distributed radix selection.

Anchors are met by all rows in blocks of ANCHORS: a block's vectors are broadcast, every row scores against
them in its own task, and no vector is shuffled. A block takes two selections:

* positives: for each anchor, the first POSITIVES rows of its label, over all scores;
* negatives: for each anchor and positive, the first NEGATIVES rows of other labels, in the window of scores
  that the positive's score allows.

A selection finds the score of the kth row of each window digit by digit. In one pass each task makes a
histogram of DIGIT bits of its scores in each window (as distances from the window's upper end) and sends
its first buckets until they hold k rows; no later bucket of that task can hold the kth row. The sums tell the
bucket of the kth row, which is the window of the next digit, until a bucket is one score wide. Then the
qualifying rows are gathered: all above the kth score, which are fewer than k in a window, and of those that
tie at it the k smallest ids of each task. So ties of any number send k rows a task at most.

Scores are exact: products of whole numbers in float32 or float64 where their norms say that all sums stay
below 2**24 or 2**53, else in integers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .common import shared_dir, written

#: How often and how large: of the contract.
POSITIVES, NEGATIVES = 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
SCALE = 256
#: Anchors of a block: their vectors are all that is broadcast, with a few numbers for each window.
ANCHORS = 2048
#: Bits of a digit, and scores that a task holds at once.
DIGIT, CELLS = 8, 2_000_000
#: Bytes of vectors in a partition of rows, and of the anchors of a block.
PART_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
#: Scores and components beyond this aren't taken.
LARGEST = 2.0**60
_WINDOW = {"w": pa.int32(), "digit": pa.int32(), "n": pa.int64()}
_FOUND = {"w": pa.int32(), "id": pa.int64(), "score": pa.int64()}


class ScoreRange(ValueError):
    """Scores of these vectors don't fit 64 bits."""


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'int' if v == pa.int32() else 'binary' if v == pa.binary() else 'long'}" for k, v in kinds.items())


def quantised(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite or the vector is null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector, anchor): the vector as bytes, with its squared norm."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
        if len(flat) and max(int(flat.max()), -int(flat.min())) >= LARGEST:
            raise ScoreRange("components don't fit 61 bits")
        square = np.append(0.0, np.cumsum(flat.astype(np.float64) ** 2))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(3),
                pa.array([packed.planes(flat[s:e]) for s, e in zip(ends, ends[1:], strict=False)], pa.binary()),
                pa.array(square[ends[1:]] - square[ends[:-1]]),
            ],
            ["id", "label", "anchor", "cell", "square"],
        )


def _matrix(cells: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, what is beyond dim meets nothing."""
    out = np.zeros((len(cells), dim), np.int64)
    for k, cell in enumerate(cells):
        v = packed.from_planes(cell, np.int64)[:dim]
        out[k, : len(v)] = v
    return out


def _kind(bound: float):
    """A type in which all sums of products below the bound are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Block:
    """What tasks need of a block of anchors: vectors by label, and windows of scores to select in.

    Window w belongs to anchor ``own[w]`` and holds the scores from ``low[w]`` to ``high[w]``; in it ``need[w]`` rows
    are sought, of the anchor's label or of others."""

    def __init__(self, ids, labels, cells, square):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        dim = max(len(c) for c in cells) // 8
        self.vectors = _matrix([cells[k] for k in order], dim)
        self.square = np.array(square)[order]
        self.same = True
        self.own = self.low = self.high = self.need = np.zeros(0, np.int64)

    def windows(self, same: bool, own: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> None:
        """In order of the anchors."""
        self.same, self.own, self.low, self.high, self.need = same, own, low, high, need

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of all rows of the batches that lie in a window."""
        n = len(self.ids)
        at = np.searchsorted(self.own, np.arange(n + 1))  # the anchors' first windows
        many = np.diff(at)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, self.own, self.low)
        np.maximum.at(most, self.own, self.high)
        for ids, labels, rows, first, last in self._products(batches):
            anchors = self.vectors[first:last].astype(rows.dtype)
            score = rows @ anchors.T
            row, anchor = np.nonzero((score >= least[first:last].astype(score.dtype)) & (score <= most[first:last].astype(score.dtype)))
            got, who, anchor = score[row, anchor].astype(np.int64), ids[row], anchor + first
            mine = (who != self.ids[anchor]) & ((labels[row] == self.labels[anchor]) == self.same)
            got, who, anchor = got[mine], who[mine], anchor[mine]
            pair = np.repeat(np.arange(len(got)), many[anchor])  # once for each window of the anchor
            w = np.arange(len(pair)) - np.repeat(np.cumsum(many[anchor]) - many[anchor], many[anchor]) + at[anchor][pair]
            fits = (got[pair] >= self.low[w]) & (got[pair] <= self.high[w])
            yield w[fits], got[pair][fits], who[pair][fits]

    def _products(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(ids, labels, vectors) of some rows, and the first and end anchor that they may meet."""
        step, norm = max(1, CELLS // max(len(self.ids), 1)), float(self.square.max(initial=0))
        for batch in batches:
            kind = _kind(math.sqrt(max(batch.column(3).to_pylist(), default=0) * norm) + 1)
            for s in range(0, batch.num_rows, step):
                cut = batch.slice(s, step)
                ids, labels = cut.column(0).to_numpy(), cut.column(1).to_numpy()
                rows = _matrix(cut.column(2).to_pylist(), self.vectors.shape[1]).astype(kind)
                if not self.same:
                    yield ids, labels, rows, 0, len(self.ids)
                    continue
                for label in np.unique(labels):
                    first, last = np.searchsorted(self.labels, [label, label + 1])
                    if first < last:
                        own = labels == label
                        yield ids[own], labels[own], rows[own], first, last


def _shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits below the next digit of distances up to high - low."""
    bits = np.array([int(x).bit_length() for x in high - low], np.int64)
    return np.maximum(bits - DIGIT, 0)


def _histograms(block) -> Callable:
    """A task's first buckets of each window, until they hold as many rows as are sought there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        shift, total = _shift(b.low, b.high), np.zeros(len(b.own) << DIGIT, np.int64)
        for w, score, _ in b.scored(batches):
            digit = (b.high[w] - score) >> shift[w]
            place, n = np.unique((w << DIGIT) + digit, return_counts=True)
            total[place] += n
        counts = total.reshape(-1, 1 << DIGIT)
        before = np.cumsum(counts, axis=1) - counts
        w, digit = np.nonzero((counts > 0) & (before < b.need[:, None]))
        yield packed.batch({"w": w, "digit": digit, "n": counts[w, digit]}, _WINDOW)

    return run


def _qualifying(block) -> Callable:
    """All rows above the windows' kth scores (``low``), and of those at it a task's smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        held = [np.zeros((3, 0), np.int64)]
        for w, score, who in b.scored(batches):
            held.append(np.stack([w, score, who]))
            if sum(x.shape[1] for x in held) > CELLS:
                held = [_first(np.concatenate(held, axis=1), b.need)]
        w, score, who = _first(np.concatenate(held, axis=1), b.need)
        yield packed.batch({"w": w, "id": who, "score": score}, _FOUND)

    return run


def _first(found: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of (window, score, id), each window's first rows: by score, then the smallest ids."""
    w, score, who = found
    order = np.lexsort((who, -score, w))
    found = found[:, order]
    w = found[0]
    start = np.searchsorted(w, w)
    return found[:, np.arange(len(w)) - start < need[w]]


def _select(rows: DataFrame, block: Block, same: bool, own: np.ndarray, low: np.ndarray, high: np.ndarray, need: int) -> DataFrame:
    """(w, id, score, rank): the first ``need`` rows of each window."""
    context, floor = rows.sparkSession.sparkContext, low.copy()
    at, top, seek = low.copy(), high.copy(), np.full(len(own), need, np.int64)
    while len(wide := np.flatnonzero(top > at)):
        block.windows(same, own[wide], at[wide], top[wide], seek[wide])
        sent = context.broadcast(block)
        sums = rows.mapInArrow(_histograms(sent), _ddl(_WINDOW)).groupBy("w", "digit").agg(F.sum("n").alias("n"))
        got = sums.toPandas().sort_values(["w", "digit"])  # at most 2**DIGIT of a window, and only those that matter
        sent.unpersist()
        w, digit, n = (got[c].to_numpy(np.int64) for c in ("w", "digit", "n"))
        before = np.cumsum(n) - n
        before -= before[np.searchsorted(w, w)]
        w, shift = wide[w], _shift(at, top)
        reach = (before < seek[w]) & (before + n >= seek[w])  # the bucket of the row that is sought
        w, digit, before = w[reach], digit[reach], before[reach]
        end = top[w] - (digit << shift[w])
        begin = np.maximum(end - (np.int64(1) << shift[w]) + 1, at[w])
        full = np.zeros(len(own), bool)
        full[w] = True
        top[~full & (top > at)] = np.iinfo(np.int64).min  # fewer rows than are sought: all of them qualify
        at[w], top[w], floor[w] = begin, end, begin
        seek[w] -= before
    block.windows(same, own, floor, high, np.full(len(own), need, np.int64))
    sent = context.broadcast(block)
    found = rows.mapInArrow(_qualifying(sent), _ddl(_FOUND))
    order = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)


def _mined(rows: DataFrame, block: Block, most_square: float) -> DataFrame:
    """The result of a block of anchors."""
    reach = np.floor(np.sqrt(block.square * most_square) * (1 + 1e-9)).astype(np.int64) + 2
    chosen = _select(rows, block, True, np.arange(len(block.ids)), -reach, reach, POSITIVES).toPandas()
    chosen = chosen.sort_values(["w", "rank"])
    own, score = chosen["w"].to_numpy(np.int64), chosen["score"].to_numpy(np.int64)
    low, high = -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100
    allowed = low <= high
    own, score, low, high = own[allowed], score[allowed], low[allowed], high[allowed]
    windows = list(zip(range(len(own)), block.ids[own].tolist(), chosen["id"].to_numpy(np.int64)[allowed].tolist(), score.tolist(), strict=True))
    told = rows.sparkSession.createDataFrame(windows, "w int, anchor_id long, positive_id long, positive_score long")
    found = _select(rows, block, False, own, low, high, NEGATIVES)
    return found.join(F.broadcast(told), "w").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", most: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row for which
    ``anchors`` holds) and each of its positives, the hardest rows of other labels, from rank 1.

    Scores are inner products of floor(SCALE * x); of equal scores the smaller id comes first.

    * rows with a null id, label or vector, or with a null or non-finite component, take no part.
    * vectors of different lengths meet as if the shorter one ended in zeros; an empty one scores 0.
    * repeated rows: each is a row of its own, but none meets an anchor of its own id; anchors of one id have
      their own results each. Labels are whole numbers.
    * a table without rows or without anchors gives an empty result; other columns are ignored.
    * vectors whose scores might pass 61 bits end the query with ScoreRange.
    """
    spark = rows.sparkSession
    fine = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        quantised(vector_col).alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and v is not null")
    size, dims = fine.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(dims or 0) * 8 // PART_BYTES))
    prepared = fine.mapInArrow(_cells, "id long, label long, anchor boolean, cell binary, square double").repartition(parts)
    prepared = written(prepared, "negatives-rows")
    found, square = prepared.where("anchor").agg(F.count(F.lit(1)), F.max("square")).first()
    out = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return spark.createDataFrame([], schema)
    most_square = prepared.agg(F.max("square")).first()[0]
    if math.sqrt(square * most_square) >= LARGEST:
        raise ScoreRange(f"scores of up to {math.sqrt(square * most_square):.3g} don't fit 64 bits")
    blocks = max(-(-found // most), -(-found * (dims // size + 1) * 8 // BLOCK_BYTES))
    dealt = prepared.where("anchor").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    dealt = written(dealt, "negatives-anchors")
    meet = prepared.select("id", "label", "cell", "square")
    for k in range(blocks):
        held = dealt.where(F.col("block") == k).select("id", "label", "cell", "square").collect()
        if held:
            _mined(meet, Block(*zip(*held, strict=True)), most_square).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
