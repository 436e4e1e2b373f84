"""Substring dedup over words, by fixed-block anchors.

A window of WINDOW words holds, wherever it lies, a whole block of BLOCK words at a multiple of
BLOCK from its document's start, as 2 * BLOCK - 1 <= WINDOW. So:

1. each document's non-overlapping blocks are indexed by hash, and each rolling window of
   BLOCK words of every document probes the index. A probe hits if the block stands in a document
   with a smaller id; both ends of the hits are anchors (40 bits and more: a filter);
2. anchors are extended: each WINDOW-word window around one is looked up by two
   64-bit hashes, made of two different hashes of its words, and is covered if a smaller document has it. The union of a document's covered
   windows are its maximal exact repeats.

Hashes travel packed (see packed.py). A block or window that is frequent within a batch of texts is
resolved there, and only what that leaves open is dealt, so a passage with a third of all
documents sends a few entries per batch. Whole texts move twice, by document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetools as bt
from . import packed, places
from .common import written

WINDOW, BLOCK = 13, 7
_SECOND = 0xAF251AF3B0F025B5
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
_KINDS = {"bucket": pa.int32(), "done": pa.bool_(), "hash": pa.binary(), "other": pa.binary(), "at": pa.binary(), "ids": pa.binary(), "mark": pa.binary(), "first": pa.binary()}
_SCHEMA = "bucket int, done boolean, hash binary, other binary, at binary, ids binary, mark binary, first binary"


class Words:
    """The words of some texts: hashes, and for each word its text and number in the text."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.text = bt.spans(bt.not_space(b), offsets)
        self.b, self.hash = b, bt.word_hashes(b, self.start, self.end)
        self.per = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.per) - self.per

    def windows(self, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, made of different hashes of the words, of the windows that start there."""
        other = bt.word_hashes(self.b, self.start, self.end, seed=1)
        return bt.window_hashes(self.hash, width)[at], bt.window_hashes(other, width, _SECOND)[at]

    def whole(self, width: int) -> np.ndarray:
        """Where windows of that many words start that lie in one text, of WINDOW words at least."""
        m = len(self.text) - width + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.text[:m] == self.text[width - 1 :]) & (self.per[self.text[:m]] >= WINDOW))


def _repeats(key: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose key (and other key) occurs again, ordered by key, and each one's group number."""
    order = np.argsort(key)
    sorted_key = key[order]
    same = np.append(False, sorted_key[1:] == sorted_key[:-1])[: len(key)]
    again = same | np.append(same[1:], False)
    own, group = order[again], np.cumsum(~same[again])
    if other is None or not len(own):
        return own, group
    by = np.lexsort((other[own], group))
    own, group = own[by], group[by]
    same = np.append(False, (group[1:] == group[:-1]) & (other[own][1:] == other[own][:-1]))
    again = same | np.append(same[1:], False)
    return own[again], np.cumsum(~same[again])


def _least(group: np.ndarray, values: np.ndarray, use: np.ndarray) -> np.ndarray:
    """For each entry, the least value among those of its group that are in use; else the largest int64."""
    out = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, group[use], values[use])
    return out[group]


def _anchors(group: np.ndarray, ids: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of groups are anchors, and the least document of each one's group's blocks."""
    least = _least(group, ids, aligned)
    hit = ids > least
    any_hit = np.zeros(int(group.max()) + 1, bool)
    any_hit[group[hit]] = True
    return hit | (aligned & (ids == least) & any_hit[group]), least


class Messages:
    """Entries (hash, place) of one slice of texts, packed by bucket.

    Open entries are looked up in their hash's bucket; done ones only have their places passed on, and
    go to any bucket."""

    def __init__(self, w: Words, ids: np.ndarray, mark: np.ndarray, buckets: int):
        self.w, self.ids, self.mark, self.buckets = w, ids.astype(np.int64), mark, buckets
        self.out: dict[str, list] = {k: [] for k in _KINDS}

    def add(self, bucket: np.ndarray, h: np.ndarray | None, at: np.ndarray, other: np.ndarray | None = None) -> None:
        order, starts = packed.parts(bucket, self.buckets)
        first = self.w.first
        for k in np.flatnonzero(np.diff(starts)):
            own = order[starts[k] : starts[k + 1]]
            used = np.unique(self.w.text[at[own]])
            self.out["bucket"].append(int(k))
            self.out["done"].append(h is None)
            self.out["hash"].append(b"" if h is None else packed.planes(h[own]))
            self.out["other"].append(b"" if other is None else packed.planes(other[own]))
            self.out["at"].append(packed.planes(np.diff(at[own].astype(np.int32), prepend=np.int32(0))))
            self.out["ids"].append(packed.planes(self.ids[used]))
            self.out["mark"].append(packed.marks_cell(self.mark[used]))
            self.out["first"].append(packed.planes(first[used].astype(np.int32)))

    def batch(self) -> pa.RecordBatch:
        return packed.batch(self.out, _KINDS)


def _unpacked(cells: dict[str, list], done: bool, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, other hash, document id and mark and number in the document of all entries that are done or aren't."""
    hs, others, docs, marks, ats = [np.zeros(0, kind)], [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for is_done, h, other, at, ids, mark, first in zip(*(cells[k] for k in ("done", "hash", "other", "at", "ids", "mark", "first")), strict=True):
        if is_done != done:
            continue
        at, first = np.cumsum(packed.from_planes(at, np.int32)), packed.from_planes(first, np.int32)
        document = np.searchsorted(first, at, side="right") - 1
        hs.append(packed.from_planes(h, kind))
        others.append(packed.from_planes(other, kind))
        docs.append(packed.from_planes(ids, np.int64)[document])
        marks.append(packed.from_marks_cell(mark, len(first))[document])
        ats.append((at - first[document]).astype(np.int32))
    return tuple(np.concatenate(x) for x in (hs, others, docs, marks, ats))


def _looked_up(kind, chosen, buckets: int):
    """A bucket's work: chosen(group, ids, at) tells the entries whose places go on."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        _, _, ids, mark, at = _unpacked(cells, True, kind)
        if len(ids):
            yield places.emitted(ids, mark, at, np.zeros(len(at), np.int32), buckets)
        h, other, ids, mark, at = _unpacked(cells, False, kind)
        own, group = _repeats(h, other if len(other) else None)
        if len(own):
            ids, mark, at = ids[own], mark[own], at[own]
            found = chosen(group, ids, at)
            yield places.emitted(ids[found], mark[found], at[found], np.zeros(int(found.sum()), np.int32), buckets)

    return packed.gathered(each, list(_KINDS))


def _block_messages(buckets: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for row, end, b, offsets in bt.text_slices(batch.column(2), slice_bytes):
                w = Words(b, offsets)
                at = w.whole(BLOCK)
                if not len(at):
                    continue
                g = bt.window_hashes(w.hash, BLOCK)[at]
                ids = all_ids[row:end][w.text[at]]
                is_open, message = np.ones(len(at), bool), Messages(w, all_ids[row:end], marks[row:end], buckets)
                own, group = _repeats(g)
                if len(own):
                    anchor, least = _anchors(group, ids[own], (at - w.first[w.text[at]])[own] % BLOCK == 0)
                    is_open[own] = ids[own] <= least  # larger ones have been decided
                    done = np.sort(own[anchor])
                    message.add((at[done] + row) // 64 % buckets, None, at[done])
                message.add(packed.bucket_of(g[is_open], buckets), g[is_open].astype(np.uint32), at[is_open])
                yield message.batch()

    return run


def _window_messages(buckets: int, slice_bytes: int):
    """Rows of doc_id, mark, text and the document's anchors: windows around these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            anchors = batch.column(3)
            for row, end, b, offsets in bt.text_slices(batch.column(2), slice_bytes):
                w = Words(b, offsets)
                near = np.zeros(len(w.text) + 1, bool)
                for k in range(row, end):
                    first = w.first[k - row]
                    p = first + np.frombuffer(anchors[k].as_py(), np.int32)
                    for j in range(WINDOW - BLOCK + 1):
                        near[np.maximum(p - j, first)] = True
                at = w.whole(WINDOW)
                at = at[near[at]]
                if not len(at):
                    continue
                h, other = w.windows(WINDOW, at)
                ids = all_ids[row:end][w.text[at]]
                is_open, message = np.ones(len(at), bool), Messages(w, all_ids[row:end], marks[row:end], buckets)
                own, group = _repeats(h, other)
                if len(own):
                    least = _least(group, ids[own], np.ones(len(own), bool))
                    is_open[own] = ids[own] <= least
                    done = np.sort(own[ids[own] > least])
                    message.add((at[done] + row) // 64 % buckets, None, at[done])
                message.add(packed.bucket_of(other[is_open], buckets), h[is_open], at[is_open], other[is_open])
                yield message.batch()

    return run


def _later(group: np.ndarray, ids: np.ndarray, _at: np.ndarray) -> np.ndarray:
    return ids > _least(group, ids, np.ones(len(ids), bool))


def _blocks_hit(group: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _anchors(group, ids, at % BLOCK == 0)[0]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text and the document's covered windows: what is left."""
    for batch in batches:
        covers = batch.column(2)
        for row, end, b, offsets in bt.text_slices(batch.column(1), SLICE):
            w = Words(b, offsets)
            change = np.zeros(len(w.text) + 1, np.int32)
            for k in range(row, end):
                if covers[k].is_valid:
                    p = w.first[k - row] + np.unique(np.frombuffer(covers[k].as_py(), np.int32))
                    change[p] += 1
                    change[p + WINDOW] -= 1
            kept = np.cumsum(change[:-1]) == 0
            last = np.zeros(len(offsets) - 1, np.int64)
            word = np.flatnonzero(kept)
            last[w.text[word]] = word  # the last one written stays
            edge = np.zeros(len(b) + 1, np.int32)
            edge[w.start[word]] += 1
            edge[w.end[word]] -= 1
            mask = np.cumsum(edge[:-1]) > 0
            gap = w.end[word[word != last[w.text[word]]]]
            mask[gap] = True
            out = np.where(bt.not_space(b), b, np.uint8(32))[mask]
            ends = np.concatenate([[0], np.cumsum(mask)])[offsets]
            n_kept = np.bincount(w.text[word], minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row),
                    pa.array(w.per.astype(np.int64)),
                    pa.array((w.per - n_kept).astype(np.int64)),
                    pa.array([hashlib.sha256(out[s:e]).hexdigest() for s, e in zip(ends, ends[1:], strict=False)]),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces).

    A word is removed if it lies in a window of WINDOW words that also starts in a document with a
    smaller id; windows are judged on the input. ids are integers.

    * null and empty texts have no words; texts under WINDOW words lose none; very long ones count whole.
    * rows with one id aren't smaller than each other, whether their texts are equal (equal results)
      or not (each row is judged by itself); a row with a null id neither removes nor loses words.
      An empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = narrow.where("doc_id is not null and text is not null")
    plan = packed.layout(known)
    buckets, size = plan.buckets, plan.slice_bytes(SLICE)
    narrow, known = (d.select("doc_id", plan.mark().alias("mark"), "text") for d in (narrow, known))
    blocks = known.mapInArrow(_block_messages(buckets, size), _SCHEMA)
    hits = packed.dealt(blocks, buckets).mapInArrow(_looked_up(np.uint32, _blocks_hit, buckets), places.SCHEMA)
    anchors = written(places.by_document(hits, buckets).select("doc_id", "mark", "at"), "substring-anchors")
    texts = known.join(anchors.hint("shuffle_hash"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "at")
    windows = texts.mapInArrow(_window_messages(buckets, size), _SCHEMA)
    later = packed.dealt(windows, buckets).mapInArrow(_looked_up(np.uint64, _later, buckets), places.SCHEMA)
    covers = written(places.by_document(later, buckets).select("doc_id", "mark", "at"), "substring-covers")
    judged = narrow.join(covers.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "at")
    return judged.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
