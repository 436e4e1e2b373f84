"""Suffix-array dedup: every byte that a repeated LENGTH-byte string covers, over the whole corpus.

A suffix array of a shard tells all its repeated strings, so equal LENGTH-byte strings have to meet
in one shard. Each such string is dealt by its anchor: its GRAM-byte substring with the least hash
(the leftmost of equals). Strings that start one after another mostly share an anchor, so what
a document sends to a shard is a region: a run of starts and the bytes they need.

1. Regions (anchor hash, content hash, place) are dealt by anchor. Of regions with equal content
   the first in the corpus stands for all; in the others every string starts earlier, so they are
   covered. This also collapses groups of copies, within a task before anything is dealt.
2. Anchors with regions of different content are where strings may repeat in part. Their regions'
   bytes go to the anchor's shard, whose suffix array (induced sorting) and permuted common
   prefixes group equal strings; all but the first of a group are covered.
   An anchor with over SHARD bytes of regions (a short line in very many contexts) is split: its
   regions are cut where the anchor's place in the string passes a multiple of RUN, and a piece is
   dealt by the CORE bytes around the anchor that all its strings hold. Equal strings have equal
   cores, and other contexts other ones.
3. Documents drop the covered bytes.

Whole texts move twice, by document id; hashes and places travel packed (see packed.py).
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
from .suffix_array import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated; of an anchor (a power of two).
LENGTH, GRAM = 100, 32
SLICE = 1 << 20
#: A byte that UTF-8 text never holds; it ends each region of a shard.
BORDER = 255
#: Anchors with more bytes of regions than this are split.
SHARD = 6 << 20
#: Bytes of regions whose suffixes are sorted at once, cut between anchors; short arrays stay in the cache.
ARRAY = 1 << 18
#: Starts of a piece of a split anchor, and the bytes that its strings have in common.
RUN = 9
CORE = LENGTH - RUN + 1
_KINDS = {"bucket": pa.int32(), "done": pa.bool_(), "anchor": pa.binary(), "content": pa.binary(), "at": pa.binary(), "count": pa.binary(), "ids": pa.binary(), "mark": pa.binary(), "first": pa.binary()}
_SCHEMA = "bucket int, done boolean, anchor binary, content binary, at binary, count binary, ids binary, mark binary, first binary"
_REGIONS = {"bucket": pa.int32(), "anchor": pa.binary(), "count": pa.binary(), "ids": pa.binary(), "mark": pa.binary(), "at": pa.binary(), "text": pa.binary()}
_REGIONS_SCHEMA = "bucket int, anchor binary, count binary, ids binary, mark binary, at binary, text binary"
_BYTE = np.random.default_rng(11).integers(0, 1 << 32, (2, 256), dtype=np.uint64).astype(np.uint32)
_FACTOR = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def gram_hashes(b: np.ndarray, which: int) -> np.ndarray:
    """32-bit hashes of the GRAM bytes from each position, by doubling."""
    h, width = _BYTE[which][b], 1
    while width < GRAM:
        h = h[:-width] * _FACTOR[which] + h[width:]
        h ^= h >> np.uint32(15)
        width *= 2
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    out, done = a, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def regions(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, text, anchor hash) of each run of strings with one anchor."""
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(b, 0)
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_least(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, bool)
    for s, e in zip(offsets, offsets[1:], strict=False):
        inside[s : max(s, e - LENGTH + 1)] = True
    inside = inside[: len(anchor)]
    begins = inside & np.append(True, (anchor[1:] != anchor[:-1]) | ~inside[:-1])
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    begins |= inside & edge[: len(anchor)]
    first = np.flatnonzero(begins)
    # starts up to the next region or the end of its text
    total = np.concatenate([[0], np.cumsum(inside)])
    count = np.diff(np.append(total[first], total[-1]))
    a = anchor[first]
    second = gram_hashes_at(b, a)
    text = np.searchsorted(offsets, first, side="right") - 1
    return first, count, text, (second << np.uint64(32)) | h[a].astype(np.uint64)


def gram_hashes_at(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second hash of the GRAM bytes at some positions, as uint64 below 2**32."""
    out = np.zeros(len(at), np.uint32)
    for k in range(GRAM):
        out = (out ^ _BYTE[1][b[at + k]]) * _FACTOR[1]
        out ^= out >> np.uint32(16)
    return out.astype(np.uint64)


def _later(new: np.ndarray, ids: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of entries by (class, id, mark, place), where classes begin at ``new``: those with an earlier one in
    their class. That is one of a smaller id or an earlier place of the same row; other rows with the
    same id, and the same place of a repeated row, aren't earlier."""
    row = new | np.append(True, (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1]))
    lead, first = (np.maximum.accumulate(np.where(x, np.arange(len(x)), 0)) for x in (new, row))
    return (ids != ids[lead]) | (at != at[first])


def _later_copies(key: np.ndarray, ids: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries whose key stands with an earlier place too."""
    order = np.argsort(key)
    same = np.append(False, key[order][1:] == key[order][:-1])
    own = order[same | np.append(same[1:], False)]
    later = np.zeros(len(key), bool)
    if len(own):
        own = own[np.lexsort((at[own], mark[own], ids[own], key[own]))]
        new = np.append(True, key[own][1:] != key[own][:-1])
        later[own] = _later(new, ids[own], mark[own], at[own])
    return later


def _region_messages(buckets: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, marks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for row, end, b, offsets in bt.text_slices(batch.column(2), slice_bytes):
                first, count, text, anchor = regions(b, offsets)
                if not len(first):
                    continue
                content = bt.span_hashes(b, first, first + count + LENGTH - 1)
                ids, mark = all_ids[row:end], marks[row:end]
                out: dict[str, list] = {k: [] for k in _KINDS}

                def add(own, bucket, done):
                    order, starts = packed.parts(bucket, buckets)
                    for k in np.flatnonzero(np.diff(starts)):
                        e = own[order[starts[k] : starts[k + 1]]]
                        used = np.unique(text[e])
                        out["bucket"].append(int(k))
                        out["done"].append(done)
                        out["anchor"].append(b"" if done else packed.planes(anchor[e].astype(np.uint32)))
                        out["content"].append(b"" if done else packed.planes(content[e]))
                        out["at"].append(packed.planes(np.diff(first[e].astype(np.int32), prepend=np.int32(0))))
                        out["count"].append(count[e].astype(np.uint8).tobytes())
                        out["ids"].append(packed.planes(ids[used]))
                        out["mark"].append(packed.marks_cell(mark[used]))
                        out["first"].append(packed.planes(offsets[used].astype(np.int32)))

                later = _later_copies(content ^ anchor, ids[text], mark[text], first - offsets[text])
                done, rest = np.flatnonzero(later), np.flatnonzero(~later)
                add(done, (done + row) // 64 % buckets, True)
                add(rest, packed.bucket_of(anchor[rest], buckets), False)
                yield packed.batch(out, _KINDS)

    return run


def _places(cells: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document id and mark, start in it, number of starts and done of all entries."""
    docs, marks, ats, dones = [], [], [], []
    for done, at, ids, mark, first in zip(*(cells[k] for k in ("done", "at", "ids", "mark", "first")), strict=True):
        at, first = np.cumsum(packed.from_planes(at, np.int32)), packed.from_planes(first, np.int32)
        document = np.searchsorted(first, at, side="right") - 1
        docs.append(packed.from_planes(ids, np.int64)[document])
        marks.append(packed.from_marks_cell(mark, len(first))[document])
        ats.append(at - first[document])
        dones.append(np.full(len(at), done))
    count = np.concatenate([np.frombuffer(c, np.uint8) for c in cells["count"]]).astype(np.int32)
    return np.concatenate(docs), np.concatenate(marks), np.concatenate(ats), count, np.concatenate(dones)


def _classes(buckets: int, shard_bytes: int):
    """A bucket of regions: places whose flag is the number of covered starts or, for regions that a
    suffix array has to judge, less by one than minus (128 times the code of its shard and that number);
    the code is twice the bucket, and one more where the anchor is split."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        ids, mark, at, count, done = _places(cells)
        if done.any():
            yield places.emitted(ids[done], mark[done], at[done], count[done], buckets)
        ids, mark, at, count = ids[~done], mark[~done], at[~done], count[~done]
        anchor = np.concatenate([packed.from_planes(c, np.uint32) for c in cells["anchor"]])
        content = np.concatenate([packed.from_planes(c, np.uint64) for c in cells["content"]])
        if not len(anchor):
            return
        order = np.argsort(anchor)
        same = np.append(False, anchor[order][1:] == anchor[order][:-1])
        again = order[same | np.append(same[1:], False)]
        if not len(again):
            return
        again = again[np.lexsort((at[again], mark[again], ids[again], content[again], anchor[again]))]
        a, c = anchor[again], content[again]
        new_anchor = np.append(True, a[1:] != a[:-1])
        new_class = new_anchor | np.append(True, c[1:] != c[:-1])
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group[new_class])[group] > 1
        ids, mark, at, count = ids[again], mark[again], at[again], count[again]
        later = _later(new_class, ids, mark, at)
        # of each class its first region, and those of other rows with the same id, which aren't later
        row = new_class | np.append(True, (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1]))
        judged = row & ~later & several
        size = np.bincount(group, weights=(count + LENGTH - 1) * judged)
        code = 2 * cells["bucket"][0] + (size[group] > shard_bytes)
        flag = np.where(judged, -(code * 128 + count) - 1, count)
        send = judged | later
        yield places.emitted(ids[send], mark[send], at[send], flag[send], buckets)

    return packed.gathered(each, list(_KINDS))


def _pieces(b: np.ndarray, at: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(region, first start, number of starts, hash of the core) of the pieces that regions with their anchors
    at these places are cut into."""
    region = np.repeat(np.arange(len(at)), count)
    start = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(len(region))
    part = (anchor[region] - start) // RUN
    first = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (part[1:] != part[:-1])))
    core = anchor[region[first]] - part[first] * RUN  # the last start that a piece can have
    return region[first], start[first], np.diff(np.append(first, len(region))), bt.span_hashes(b, core, core + CORE)


def _region_texts(buckets: int, slice_bytes: int):
    """Rows of doc_id, mark, text, at, flag: the regions that suffix arrays judge, with their bytes. A piece of a
    split anchor that stands earlier in the same slice goes without its bytes: it is covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, marks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            ats, flags = batch.column(3), batch.column(4)
            for row, end, b, offsets in bt.text_slices(batch.column(2), slice_bytes):
                where, what, text = [], [], []
                for k in range(row, end):
                    flag = np.frombuffer(flags[k].as_py(), np.int32)
                    own = flag < 0
                    where.append(np.frombuffer(ats[k].as_py(), np.int32)[own] + offsets[k - row])
                    what.append(-(flag[own] + 1))
                    text.append(np.full(int(own.sum()), k - row))
                at, what, text = np.concatenate(where).astype(np.int64), np.concatenate(what), np.concatenate(text)
                if not len(at):
                    continue
                code, count = what // 128, (what % 128).astype(np.int64)
                # the anchor again: the least hash among the grams of the region's first string
                h = gram_hashes(b, 0)
                key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
                grams = at[:, None] + np.arange(LENGTH - GRAM + 1)
                place = (key[grams].min(1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                anchor, shard, covered = h[place], code // 2, np.zeros(len(at), bool)
                split = code % 2 == 1
                if split.any():
                    of, first, many, core = _pieces(b, at[split], count[split], place[split])
                    t = text[split][of]
                    content = bt.span_hashes(b, first, first + many + LENGTH - 1) ^ core
                    later = _later_copies(content, all_ids[row:end][t], marks[row:end][t], first - offsets[t])
                    join = lambda one, other: np.concatenate([one[~split], other])
                    at, count, text, covered = join(at, first), join(count, many), join(text, t), join(covered, later)
                    anchor, shard = join(anchor, core.astype(np.uint32)), join(shard, packed.bucket_of(core, buckets))
                length = np.where(covered, 0, count + LENGTH - 1)
                order = np.lexsort((covered, shard))
                bounds = np.flatnonzero(np.append(True, (np.diff(shard[order]) != 0) | (covered[order][1:] != covered[order][:-1])))
                out: dict[str, list] = {k: [] for k in _REGIONS}
                for s, e in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
                    own = order[s:e]
                    begin = np.cumsum(length[own]) - length[own]
                    spot = np.arange(int(length[own].sum())) + np.repeat(at[own] - begin, length[own])
                    out["bucket"].append(int(shard[own[0]]))
                    out["anchor"].append(packed.planes(anchor[own]))
                    out["count"].append(count[own].astype(np.uint8).tobytes())
                    out["ids"].append(packed.planes(all_ids[row:end][text[own]]))
                    out["mark"].append(packed.marks_cell(marks[row:end][text[own]]))
                    out["at"].append(packed.planes((at[own] - offsets[text[own]]).astype(np.int32)))
                    out["text"].append(b[spot].tobytes())
                yield packed.batch(out, _REGIONS)

    return run


def _judged(buckets: int):
    """A shard's regions: places and numbers of covered starts."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        counts = [np.frombuffer(c, np.uint8) for c in cells["count"]]
        covered = np.repeat([not t for t in cells["text"]], [len(c) for c in counts])
        mark = np.concatenate([packed.from_marks_cell(c, len(n)) for c, n in zip(cells["mark"], counts, strict=True)])
        count = np.concatenate(counts).astype(np.int64)
        anchor = np.concatenate([packed.from_planes(c, np.uint32) for c in cells["anchor"]])
        ids = np.concatenate([packed.from_planes(c, np.int64) for c in cells["ids"]])
        at = np.concatenate([packed.from_planes(c, np.int32) for c in cells["at"]]).astype(np.int64)
        if covered.any():
            yield places.emitted(ids[covered], mark[covered], at[covered], count[covered], buckets)
            count, anchor, ids, mark, at = (x[~covered] for x in (count, anchor, ids, mark, at))
        text = np.frombuffer(b"".join(cells["text"]), np.uint8)
        cells["text"].clear()
        length = count + LENGTH - 1
        begin = np.cumsum(length) - length
        order = np.argsort(anchor, kind="stable")
        # arrays of about ARRAY bytes, cut between anchors
        size = np.cumsum(length[order])
        cut = np.append(True, anchor[order][1:] != anchor[order][:-1])
        starts, used = [0], 0
        for k in np.flatnonzero(cut)[1:]:
            if size[k - 1] - used > ARRAY:
                starts.append(int(k))
                used = size[k - 1]
        for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
            own = order[s:e]
            own = own[np.lexsort((at[own], mark[own], ids[own]))]
            same = (ids[own][1:] == ids[own][:-1]) & (mark[own][1:] == mark[own][:-1]) & (at[own][1:] == at[own][:-1])
            own = own[np.append(True, ~same)[: len(own)]]  # a repeated row's regions once
            yield places.emitted(*_covered(text, begin[own], count[own], ids[own], mark[own], at[own]), buckets)

    return packed.gathered(each, list(_REGIONS))


def _covered(text: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray, mark: np.ndarray, at: np.ndarray):
    """(ids, marks, first starts, numbers) of the covered runs of starts; regions are in corpus order."""
    length = count + LENGTH - 1
    base = np.cumsum(length + 1) - (length + 1)
    spot = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    s = np.full(int((length + 1).sum()), BORDER, np.uint8)
    region = np.repeat(np.arange(len(count)), length)
    s[np.arange(len(spot)) + region] = text[spot]
    sa = suffix_array(np.append(s.astype(np.int64) + 1, 0), 257)
    # starts of whole strings, in the order of the array
    owner = np.repeat(np.arange(len(count)), count)
    start = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    equal = np.zeros(len(s) + 1, bool)
    equal[start] = permuted_prefixes(s, sa, start, LENGTH) >= LENGTH
    valid = np.zeros(len(s) + 1, bool)
    valid[start] = True
    ranked = sa[valid[sa]]
    group = np.cumsum(~equal[ranked]) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, len(s))
    np.minimum.at(least, group, ranked)  # text order is corpus order
    covered = np.zeros(len(s) + 2, bool)
    covered[ranked] = ranked > least[group]
    if np.any((ids[1:] == ids[:-1]) & (mark[1:] != mark[:-1])):  # rows with one id aren't earlier than each other
        r, lead = (np.searchsorted(base, x, side="right") - 1 for x in (ranked, least[group]))
        tied = np.flatnonzero((ids[r] == ids[lead]) & (mark[r] != mark[lead]))
        tied = tied[np.lexsort((ranked[tied], mark[r[tied]], group[tied]))]
        g, m = group[tied], mark[r[tied]]
        covered[ranked[tied[np.append(True, (g[1:] != g[:-1]) | (m[1:] != m[:-1]))[: len(tied)]]]] = False
    first = np.flatnonzero(covered[:-1] & ~np.append(False, covered[:-2]))
    last = np.flatnonzero(covered[:-1] & ~covered[1:])
    r = np.searchsorted(base, first, side="right") - 1
    return ids[r], mark[r], (at[r] + first - base[r]).astype(np.int32), (last - first + 1).astype(np.int32)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text and two sets of covered starts: what is left."""
    for batch in batches:
        for row, end, b, offsets in bt.text_slices(batch.column(1), SLICE):
            change = np.zeros(len(b) + 1, np.int32)
            for ats, flags in ((batch.column(2), batch.column(3)), (batch.column(4), batch.column(5))):
                for k in range(row, end):
                    if ats[k].is_valid:
                        flag = np.frombuffer(flags[k].as_py(), np.int32)
                        p = np.frombuffer(ats[k].as_py(), np.int32)[flag > 0] + offsets[k - row]
                        np.add.at(change, p, 1)
                        np.add.at(change, p + flag[flag > 0] + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(b) + 1, bool)
            edge[offsets] = True
            begins = gone & (~np.append(False, gone[:-1]) | edge[:-1]) if len(b) else gone
            at = lambda mask: np.concatenate([[0], np.cumsum(mask)])[offsets]
            left, ends = b[~gone], at(~gone)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(at(gone)).astype(np.int64)),
                    pa.array(np.diff(at(begins)).astype(np.int64)),
                    pa.array([hashlib.sha256(left[s:e]).hexdigest() for s, e in zip(ends, ends[1:], strict=False)]),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes).

    Texts are UTF-8 bytes. A byte is removed if a LENGTH-byte string covers it that also starts
    earlier (smaller id, or same document and earlier start), judged on the input. ids are integers.

    * null and empty texts have no bytes; texts under LENGTH bytes lose none; very long ones count whole.
    * rows with one id aren't earlier than each other, whether their texts are equal (equal results)
      or not (each row is judged by itself); a row with a null id neither removes nor loses bytes.
      An empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = narrow.where("doc_id is not null and text is not null")
    plan = packed.layout(known)
    buckets, size, row = plan.buckets, plan.slice_bytes(SLICE), ["doc_id", "mark"]
    narrow, known = (d.select("doc_id", plan.mark().alias("mark"), "text") for d in (narrow, known))
    messages = known.mapInArrow(_region_messages(buckets, size), _SCHEMA)
    classed = packed.dealt(messages, buckets).mapInArrow(_classes(buckets, shard_bytes), places.SCHEMA)
    found = written(places.by_document(classed, buckets), "suffix-classes")
    texts = known.join(found.hint("shuffle_hash"), row).select(*row, "text", "at", "flag")
    shards = packed.dealt(texts.mapInArrow(_region_texts(buckets, size), _REGIONS_SCHEMA), buckets)
    more = written(places.by_document(shards.mapInArrow(_judged(buckets), places.SCHEMA), buckets), "suffix-covers")
    more = more.withColumnsRenamed({"at": "at2", "flag": "flag2"})
    judged = (
        narrow.join(found.hint("shuffle_hash"), row, "left")
        .join(more.hint("shuffle_hash"), row, "left")
        .select("doc_id", "text", "at", "flag", "at2", "flag2")
    )
    return judged.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
