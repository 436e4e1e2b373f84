"""Which marks stand in which texts, for any number of marks of any length, by grams.

A mark is dealt by its rarest gram, a run of GRAM characters; shorter ones by what they have. Texts send
only grams that some mark is dealt by, told by a bitmap of fixed size, and learn which marks may stand in them: their
lengths, where in the mark the gram stands, and 128 bits of their text. Each text then looks at its own places of these
grams and compares what stands there by these bits. So no task holds all marks, none are broadcast, and texts move once.

How rare a gram is comes from counts over all texts in SLOTS numbers, which decide only where work is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Lengths of grams, the longest that fits a mark; slots of counts; bits of the bitmap.
GRAMS = (12, 4, 2, 1)
SLOTS, BITS = 1 << 16, 1 << 25
U64 = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def gram_hashes(text: str, size: int) -> np.ndarray:
    """A hash of each run of so many characters, with the size in it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, size, U64)
    for k in range(size):
        h = (h + points[k : k + n]) * U64(0x9E3779B97F4A7C15 | 1)
        h ^= h >> U64(29)
    return _mixed(h)


def size_of(length: int) -> int:
    return next(g for g in GRAMS if g <= length)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _counted(sizes: list[int]):
    """How many texts of a task hold a gram in each slot, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held = np.unique(np.concatenate([gram_hashes(text, g) for g in sizes]) % U64(SLOTS))
                total[held.astype(np.int64)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, SLOTS, 4096), pa.int32()), pa.array([total[s : s + 4096].tobytes() for s in range(0, SLOTS, 4096)], pa.binary())], ["part", "counts"])

    return run


def _summed(key: str, cell: str, kind, op):
    def run(rows: pa.Table) -> pa.Table:
        total = None
        for c in rows.column(cell).to_pylist():
            got = np.frombuffer(c, kind)
            total = got.copy() if total is None else op(total, got, out=total)
        return pa.table({key: rows.column(key)[:1], cell: pa.array([total.tobytes()], pa.binary())})

    return run


def _dealt(counts: np.ndarray):
    """Marks (mark, text) -> (mark, gram, size, at, length, bits): the rarest gram, of equals the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = size_of(len(text))
                h = gram_hashes(text, size)
                at = int(counts[(h % U64(SLOTS)).astype(np.int64)].argmin())
                out.append((mark, int(h[at].view(np.int64)), size, at, len(text), digest(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["mark", "gram", "size", "at", "length", "bits"])

    return run


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's grams in the bitmap, by parts."""
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[(batch.column(0).to_numpy().view(U64) % U64(BITS)).astype(np.int64)] = True
    step = BITS // 64
    for part in range(64):
        own = bits[part * step : (part + 1) * step]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["part", "bits"])


def _probed(sizes: list[int], sent):
    """Texts (row, text) -> (row, gram): the grams that a mark may be dealt by, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            rows, grams = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.unique(np.concatenate([gram_hashes(text, g) for g in sizes]))
                at = (h % U64(BITS)).astype(np.int64)
                h = h[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                rows.append(np.full(len(h), row, np.int64))
                grams.append(h)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(grams).view(np.int64))], ["row", "gram"])

    return run


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, candidates) -> (row, mark, start): the first place of each mark that stands in the text."""
    for batch in batches:
        rows, marks, starts = [], [], []
        for row, text, told in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            seen: dict[tuple[int, int], bytes] = {}
            places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for c in told:
                if c["size"] not in places:
                    h = gram_hashes(text, c["size"])
                    order = np.argsort(h, kind="stable")
                    places[c["size"]] = h[order], order
                h, order = places[c["size"]]
                gram = np.int64(c["gram"]).view(U64)
                for p in order[np.searchsorted(h, gram) : np.searchsorted(h, gram, side="right")].tolist():
                    start, end = p - c["at"], p - c["at"] + c["length"]
                    if start < 0 or end > len(text):
                        continue
                    key = (start, end)
                    if key not in seen:
                        seen[key] = digest(text[start:end])
                    if seen[key] == c["bits"]:
                        rows.append(row)
                        marks.append(c["mark"])
                        starts.append(start)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int64())], ["row", "mark", "start"])


def containment(docs: DataFrame, marks: DataFrame, text_col: str = "text", mark_text: str = "text") -> DataFrame:
    """Each row of ``docs`` (doc) with each row of ``marks`` (mark) whose text stands in it: doc, mark (structs of all
    columns), start (the first place, in characters).

    Null and empty texts and marks meet nothing. Repeated rows give theirs again; marks of one text are looked for once."""
    spark = docs.sparkSession
    told = marks.where(F.length(mark_text) > 0).select(F.struct(*marks.columns).alias("mark"), F.col(mark_text).alias("_t"), F.sha2(mark_text, 256).alias("_key"))
    own = written(told.groupBy("_key").agg(F.min("_t").alias("text")).select(F.monotonically_increasing_id().alias("mark"), "_key", "text"), "contain-marks")
    texts = docs.where(F.length(text_col) > 0).select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    texts = written(texts, "contain-texts")
    lengths = own.agg(*[F.max((F.length("text") >= g) & ((F.length("text") < b) if b else F.lit(True))).alias(str(g)) for g, b in zip(GRAMS, (None, *GRAMS), strict=False)]).first()
    sizes = [g for g in GRAMS if lengths[str(g)]]
    if not sizes:
        return texts.where("false").crossJoin(told.where("false")).select("doc", "mark", F.lit(0).cast("long").alias("start"))  # neither has a row
    counted = texts.select("text").mapInArrow(_counted(sizes), "part int, counts binary").groupBy("part").applyInArrow(_summed("part", "counts", np.int64, np.add), "part int, counts binary")
    counts = np.zeros(SLOTS, np.int64)
    for r in counted.collect():  # SLOTS numbers
        counts[r["part"] : r["part"] + 4096] = np.frombuffer(r["counts"], np.int64)
    dealt = written(own.select("mark", "text").mapInArrow(_dealt(counts), "mark long, gram long, size int, at long, length long, bits binary"), "contain-dealt")
    mapped = dealt.select("gram").mapInArrow(_mapped, "part int, bits binary").groupBy("part").applyInArrow(_summed("part", "bits", np.uint8, np.bitwise_or), "part int, bits binary")
    bits = np.zeros(BITS // 8, np.uint8)
    for r in mapped.collect():  # BITS bits
        bits[r["part"] * (BITS // 512) : (r["part"] + 1) * (BITS // 512)] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    grams = texts.select("row", "text").mapInArrow(_probed(sizes, sent), "row long, gram long")
    maybe = grams.join(dealt, "gram").groupBy("row").agg(F.collect_list(F.struct("mark", "gram", "size", "at", "length", "bits")).alias("told"))
    found = texts.select("row", "text").join(maybe, "row").select("row", "text", "told").mapInArrow(_found, "row long, mark long, start long")
    found = written(found, "contain-found")
    named = found.join(own.select(F.col("mark").alias("_m"), "_key"), found["mark"] == F.col("_m")).select("row", "start", "_key")
    return named.join(told.select("mark", "_key"), "_key").join(texts.select("row", "doc"), "row").select("doc", "mark", "start")


def first_leaks(outputs: DataFrame, canaries: DataFrame, prefix: str, length: int, text_col: str = "text", canary_col: str = "canary", order_col: str = "ord") -> DataFrame:
    """outputs with leak: struct(canary, start) of the first listed canary that a text holds, else null.

    Canaries are made alike: a prefix and ``length`` characters in all, so they are cut out of the texts where the prefix
    stands and met by equality, however many there are. Others, and empty ones, are never found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = outputs.withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "leak-rows")
    cut = F.transform(F.split(text, rf"(?=\Q{prefix}\E)"), lambda p: F.substring(p, 1, length))
    held = rows.where(text.contains(prefix)).select("_row", text.alias("_text"), F.explode(F.array_distinct(cut)).alias("_canary"))
    listed = canaries.where(F.col(canary_col).startswith(prefix) & (F.length(canary_col) == length)).groupBy(F.col(canary_col).alias("_canary")).agg(F.min(order_col).alias("_ord"))
    found = held.join(listed, "_canary").select("_row", "_ord", F.struct(F.col("_canary").alias("canary"), (F.expr("instr(_text, _canary)") - 1).alias("start")).alias("leak"))
    first = found.groupBy("_row").agg(F.min_by("leak", "_ord").alias("leak"))
    return rows.join(first, "_row", "left").drop("_row")
