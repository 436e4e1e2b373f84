"""N-gram Jaccard join by prefix trees: documents whose sets of word shingles are similar.

1. Filter. A document that links with another shares most of its shingles, and so most of those whose
   hash is below a bound: at most a fifth of its whole set may be missing there. Documents whose
   sampled shingles aren't repeated often enough have no partner. The bound is exact: no link is lost.
   ``lone`` asks the same of the classes of step 2 and of all their shingles.
2. Documents with one set form a class. Over the classes left, shingles are ordered by their number of
   classes. Of two similar sets each has a common shingle among its rarest n - ceil(0.8 n) + 1.
   Shingles of the same classes are one key. Ids, sizes and places of keys are dealt first, and only
   classes that may link there by their sizes and the key's places go on, with their sets.
3. The classes of a key meet in one task, or, if there are more than BLOCK, in several. There a trie of
   their ordered sets is probed (see prefix_tree.py) for those that may link with any that they aren't
   connected with yet, and the links that connect what all similar pairs connect are kept. It takes three turns, each between classes that aren't connected yet: at
   each class's rarest key, in blocks that don't meet; at all keys with several blocks, dealt anew; and
   at all keys, where the blocks of what is connected most at a key meet the blocks of all else
   there, and these meet each other. By then large groups of near copies are connected, so that few
   of their classes go to more than one block.
4. Connected components of the links (see components.py).

Shingles are 64-bit hashes; a set's identity is 128 bits of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetools as bt
from . import packed
from .common import fresh, written
from .components import components
from .prefix_tree import RUN, PrefixTree, SetRows, runs_of, spanning_links

WORDS, PERCENT = 5, 80
SLICE = 1 << 20
#: Share of the shingles that the filter looks up; at least a fifth more than may be missing.
SAMPLED = 0.4
#: Classes of one key that meet in one task; more are dealt in blocks.
BLOCK = 512
_KINDS = {"bucket": pa.int32(), "kind": pa.int32(), "hash": pa.binary(), "ids": pa.binary(), "count": pa.binary(), "size": pa.binary()}
_SCHEMA = "bucket int, kind int, hash binary, ids binary, count binary, size binary"
KEYED_SCHEMA = "doc_id long, size int, tokens binary, keys binary, at binary, sign binary"
#: Kinds of rows: shingles that ask whether they are repeated; that only tell; sizes and counts by document.
_ASK, _TELL, _COUNT = 0, 1, 2


@dataclass(frozen=True)
class Keying:
    """How classes come to keys.

    ``keyed(heads, buckets)`` gives the classes (doc_id, size, tokens) that may link with others their keys:
    KEYED_SCHEMA, so that two classes that link share a key at least. ``at`` says how many of the set's tokens come
    before those that both classes can share, if the key is the first that they have in common. ``sign`` is what
    ``near(key, signs, labels, size, at)`` needs to tell which classes have a partner of another label at that key; without
    near it is empty. In the turns of ``one_key`` a class goes to one key only. ``sets`` is how the sets that meet are probed."""

    keyed: Callable[[DataFrame, int], DataFrame]
    near: Callable[..., np.ndarray] | None = None
    one_key: tuple[int, ...] = (1,)
    sets: type[PrefixTree] | type[SetRows] = PrefixTree


def shingles(b: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of so many words of some texts, by text and hash."""
    low = bt.lower_ascii(b)
    start, end, text = bt.spans(bt.not_space(low), offsets)
    h = bt.word_hashes(low, start, end)
    per = np.bincount(text, minlength=len(offsets) - 1)
    m = len(text) - words + 1
    at = np.flatnonzero(text[:m] == text[words - 1 :]) if m > 0 else np.zeros(0, np.int64)
    texts, hashes = [text[at]], [bt.window_hashes(h, words)[at]]
    first = np.cumsum(per) - per
    for n in range(1, words):  # texts with fewer words: the whole sequence
        short = np.flatnonzero(per == n)
        if len(short):
            texts.append(short)
            hashes.append(bt.window_hashes(h, n)[first[short]] ^ np.uint64(0x5851F42D4C957F2D * n % (1 << 64)))
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.argsort(h)
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def _add(out: dict[str, list], bucket: int, kind: int, h: np.ndarray | None, ids: np.ndarray, count: np.ndarray, size: np.ndarray | None = None) -> None:
    out["bucket"].append(int(bucket))
    out["kind"].append(kind)
    out["hash"].append(b"" if h is None else packed.planes(h))
    out["ids"].append(packed.planes(ids.astype(np.int64)))
    out["count"].append(packed.planes(count.astype(np.int32)))
    out["size"].append(b"" if size is None else packed.planes(size.astype(np.int32)))


def _asked(ids: np.ndarray, size: np.ndarray, text: np.ndarray, h: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Shingles of some texts (text, hash), dealt to ask whether they are repeated; and, dealt by the first text, of each how
    many of these must be."""
    sample = np.bincount(text, minlength=len(ids))
    order = np.argsort(h)
    same = np.append(False, h[order][1:] == h[order][:-1]) if len(h) else np.zeros(0, bool)
    again = same | np.append(same[1:], False)
    known = np.zeros(len(h), bool)
    known[order[again]] = True  # repeated within these texts
    tell = np.zeros(len(h), bool)
    tell[order[again & ~same]] = True
    count = np.bincount(text[known], minlength=len(ids))
    out: dict[str, list] = {k: [] for k in _KINDS}
    # missing that a partner allows, less those known to be repeated
    needed = sample - (size * (100 - PERCENT)) // 100 - count
    _add(out, packed.bucket_of(bt.mix(ids[:1].view(np.uint64).copy()), buckets)[0], _COUNT, None, ids, needed, size)
    for kind, mask in ((_ASK, ~known), (_TELL, tell)):
        t, g = text[mask], h[mask]
        spread = packed.bucket_of(bt.mix(g.copy()), buckets)
        by, starts = packed.parts(spread, buckets)
        for k in np.flatnonzero(np.diff(starts)):
            own = by[starts[k] : starts[k + 1]]
            used, many = np.unique(t[own], return_counts=True)
            _add(out, k, kind, g[own].astype(np.uint32), ids[used], many)
    return packed.batch(out, _KINDS)


def _sampled(buckets: int, slice_bytes: int, words: int):
    bound = np.uint64(int(SAMPLED * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, b, offsets in bt.text_slices(batch.column(1), slice_bytes):
                text, h = shingles(b, offsets, words)
                size = np.bincount(text, minlength=end - row)
                use = h < bound
                yield _asked(all_ids[row:end], size, text[use], h[use], buckets)

    return run


def _all_asked(buckets: int):
    """The same of rows (doc_id, size, tokens) and all their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            text = np.repeat(np.arange(len(ids)), size)
            first = np.append(0, np.cumsum(size))
            for s, e in runs_of(text, len(ids), RUN):
                row, end = np.searchsorted(first, (s, e))
                h = np.frombuffer(b"".join(batch.column(2).slice(row, end - row).to_pylist()), np.uint64)
                yield _asked(ids[row:end], size[row:end], text[s:e] - row, h, buckets)

    return run


def _by_document(out: dict[str, list], ids: np.ndarray, count: np.ndarray, size: np.ndarray | None, buckets: int) -> None:
    bucket = packed.bucket_of(bt.mix(ids.view(np.uint64).copy()), buckets)
    by, starts = packed.parts(bucket, buckets)
    for k in np.flatnonzero(np.diff(starts)):
        own = by[starts[k] : starts[k + 1]]
        _add(out, k, _COUNT, None, ids[own], count[own], None if size is None else size[own])


def _repeated(buckets: int):
    """A bucket of shingles: how many of each document's are repeated."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in _KINDS}
        hs, ids, asks = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for kind, h, i, c, s in zip(*(cells[k] for k in ("kind", "hash", "ids", "count", "size")), strict=True):
            i, c = packed.from_planes(i, np.int64), packed.from_planes(c, np.int32)
            if kind == _COUNT:
                _by_document(out, i, c, packed.from_planes(s, np.int32), buckets)
                continue
            hs.append(packed.from_planes(h, np.uint32))
            ids.append(np.repeat(i, c))
            asks.append(np.full(len(hs[-1]), kind == _ASK))
        h, ids, ask = np.concatenate(hs), np.concatenate(ids), np.concatenate(asks)
        order = np.argsort(h)
        same = np.append(False, h[order][1:] == h[order][:-1]) if len(h) else np.zeros(0, bool)
        own = order[same | np.append(same[1:], False)]
        own = own[ask[own]]
        found, count = np.unique(ids[own], return_counts=True)
        if len(found):
            _by_document(out, found, count.astype(np.int32), None, buckets)
        yield packed.batch(out, _KINDS)

    return packed.gathered(each, list(_KINDS))


def _decided(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_shingles, spare) of a bucket of documents, a row per row of the input: how many more of the shingles
    that were looked up a partner may lack; none has one that lacks more than it may."""
    rows, counts = [], []
    for i, c, s in zip(cells["ids"], cells["count"], cells["size"], strict=True):
        i, c = packed.from_planes(i, np.int64), packed.from_planes(c, np.int32)
        (rows if s else counts).append((i, c, packed.from_planes(s, np.int32)) if s else (i, c))
    if not rows:
        return
    ids, needed, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    got = np.zeros(len(ids), np.int64)
    if counts:
        i, c = (np.concatenate(x) for x in zip(*counts, strict=True))
        own, number = np.unique(i, return_inverse=True)
        total = np.bincount(number, weights=c).astype(np.int64)
        at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        got = np.where(own[at] == ids, total[at], 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(size.astype(np.int64)), pa.array(got - needed)],
        ["doc_id", "n_shingles", "spare"],
    )


def _spared(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows of _asked -> (doc_id, n_shingles, spare)."""
    counted = packed.dealt(asked, buckets).mapInArrow(_repeated(buckets), _SCHEMA)
    return packed.dealt(counted, buckets).mapInArrow(packed.gathered(_decided, list(_KINDS)), "doc_id long, n_shingles long, spare long")


def lone(heads: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, lone) of the classes (doc_id, size, tokens) that may link with any other: how many of its tokens no other
    class has, but for those that share 32 bits with another's."""
    spared = _spared(heads.where("size > 0").select("doc_id", "size", "tokens").mapInArrow(_all_asked(buckets), _SCHEMA), buckets)
    return spared.where("spare >= 0").selectExpr("doc_id", f"CAST(n_shingles * {100 - PERCENT} DIV 100 - spare AS INT) AS lone")


def _sets(words: int):
    """Rows (doc_id, size, one, other, tokens): sets with 128 bits of identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b, offsets in bt.text_slices(batch.column(1), SLICE):
                text, h = shingles(b, offsets, words)
                at = np.searchsorted(text, np.arange(end - row + 1))
                one, other = np.zeros(end - row, np.uint64), np.zeros(end - row, np.uint64)
                np.add.at(one, text, bt.mix(h + np.uint64(1)))
                np.add.at(other, text, bt.mix(h ^ np.uint64(0x6C62272E07BB0142)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(np.diff(at).astype(np.int32)),
                        pa.array(one.view(np.int64)),
                        pa.array(other.view(np.int64)),
                        pa.array([h[s:e].tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()),
                    ],
                    ["doc_id", "size", "one", "other", "tokens"],
                )

    return run


#: Classes of a pack.
PACK = 256
_PACKS_SCHEMA = "pack long, ids binary, sizes binary, counts binary, tokens binary"
_TOKENS = {"bucket": pa.int32(), "pack": pa.int64(), "hash": pa.binary(), "held": pa.binary(), "mark": pa.binary()}
_TOKENS_SCHEMA = "bucket int, pack long, hash binary, held binary, mark binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, size, tokens), PACK in one."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for s in range(0, batch.num_rows, PACK):
            ids, sizes = (batch.column(k).slice(s, PACK).to_numpy(zero_copy_only=False) for k in range(2))
            cells = batch.column(2).slice(s, PACK).to_pylist()
            counts = np.array([len(c) // 8 for c in cells], np.int32)
            row = (packed.planes(ids.astype(np.int64)), packed.planes(sizes.astype(np.int32)), packed.planes(counts), b"".join(cells))
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c], pa.binary()) for c in row)], ["pack", "ids", "sizes", "counts", "tokens"])
            number += 1


def _by_bucket(bucket: np.ndarray, buckets: int, packs: np.ndarray, h: np.ndarray, held: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """Entries (pack, hash, held, mark), a row for each bucket and pack."""
    out: dict[str, list] = {k: [] for k in _TOKENS}
    order = np.lexsort((packs, bucket))
    bucket, packs, h, held, mark = bucket[order], packs[order], h[order], held[order], mark[order]
    first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (packs[1:] != packs[:-1]))[: len(h)])
    for s, e in zip(first, np.append(first[1:], len(h))[: len(first)], strict=True):
        for k, v in zip(_TOKENS, (int(bucket[s]), int(packs[s]), packed.planes(h[s:e]), packed.planes(held[s:e].astype(np.int64)), packed.planes(mark[s:e])), strict=True):
            out[k].append(v)
    return packed.batch(out, _TOKENS)


def _tokens_out(buckets: int):
    """Rows of packs: each token once, with how many of the pack hold it and the sum of their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, counts, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids, counts = packed.from_planes(ids, np.int64), packed.from_planes(counts, np.int32)
                own = bt.mix(ids.view(np.uint64) ^ np.uint64(0x9FB21C651E98DF25))
                h, number, held = np.unique(np.frombuffer(tokens, np.uint64), return_inverse=True, return_counts=True)
                mark = np.zeros(len(h), np.uint64)
                np.add.at(mark, number, np.repeat(own, counts))
                yield _by_bucket(packed.bucket_of(bt.mix(h.copy()), buckets), buckets, np.full(len(h), pack), h, held, mark)

    return run


def _tokens_of(cells: dict[str, list]) -> tuple[np.ndarray, ...]:
    h, mark = (np.concatenate([packed.from_planes(c, np.uint64) for c in cells[k]]) for k in ("hash", "mark"))
    held = [packed.from_planes(c, np.int64) for c in cells["held"]]
    return np.repeat(np.array(cells["pack"], np.int64), [len(c) for c in held]), h, np.concatenate(held), mark


def _holders(buckets: int):
    """A bucket of tokens: to each pack its tokens that more than one class holds, with how many do and a mark of who they are."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        packs, h, held, mark = _tokens_of(cells)
        order = np.argsort(h)
        packs, h, held, mark = packs[order], h[order], held[order], mark[order]
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        all_held, all_marks = np.zeros(group[-1] + 1, np.int64), np.zeros(group[-1] + 1, np.uint64)
        np.add.at(all_held, group, held)
        np.add.at(all_marks, group, mark)
        more = all_held[group] > 1
        packs, h, group = packs[more], h[more], group[more]
        to = packed.bucket_of(bt.mix(packs.view(np.uint64).copy()), buckets)
        yield _by_bucket(to, buckets, packs, h, all_held[group], all_marks[group])

    return packed.gathered(each, list(_TOKENS))


def _answers(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """A row for each pack: its tokens that others hold too, sorted, with held and mark."""
    packs, h, held, mark = _tokens_of(cells)
    order = np.lexsort((h, packs))
    packs, h, held, mark = packs[order], h[order], held[order], mark[order]
    first = np.flatnonzero(np.append(True, packs[1:] != packs[:-1])[: len(packs)])
    for s, e in zip(first, np.append(first[1:], len(packs))[: len(first)], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(packs[s : s + 1]), *(pa.array([x[s:e].tobytes()], pa.binary()) for x in (h, held, mark))], ["pack", "hash", "held", "mark"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs and the answers to them -> (doc_id, size, tokens, keys, at, sign): of each class the tokens that others hold,
    rare ones first, which is the global order; the marks of those in its prefix, and how many tokens of the set
    come before each one's first."""
    for batch in batches:
        for ids, sizes, counts, tokens, h, held, mark in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            ids, sizes, counts = packed.from_planes(ids, np.int64), packed.from_planes(sizes, np.int32), packed.from_planes(counts, np.int32)
            h, held, mark = np.frombuffer(h, np.uint64), np.frombuffer(held, np.int64), np.frombuffer(mark, np.uint64)
            tokens, owner = np.frombuffer(tokens, np.uint64), np.repeat(np.arange(len(ids)), counts)
            at = np.minimum(np.searchsorted(h, tokens), len(h) - 1)
            shared = h[at] == tokens
            at, owner = at[shared], owner[shared]
            order = np.lexsort((h[at], held[at], owner))
            at, owner = at[order], owner[order]
            ends = np.searchsorted(owner, np.arange(len(ids) + 1))
            out: list[tuple] = []
            for k, (doc, size) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
                own = at[ends[k] : ends[k + 1]]
                alone = size - len(own)  # tokens that no other class has come first
                prefix = size - (size * PERCENT + 99) // 100 + 1 - alone
                if prefix > 0 and len(own):
                    keys, first = np.unique(mark[own[:prefix]], return_index=True)
                    out.append((doc, size, h[own].tobytes(), keys.tobytes(), (first + alone).astype(np.int32).tobytes(), b""))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "size", "tokens", "keys", "at", "sign"])


_KEYS = {"bucket": pa.int32(), "key": pa.binary(), "ids": pa.binary(), "size": pa.binary(), "at": pa.binary(), "label": pa.binary(), "sign": pa.binary()}
_KEYS_SCHEMA = "bucket int, key binary, ids binary, size binary, at binary, label binary, sign binary"


def _keys_out(buckets: int, turn: int, how: Keying):
    """Rows (doc_id, size, keys, at, label, sign): the keys, dealt by key; in some turns one only: the rarest, or where
    that isn't told, another one in each turn that similar classes choose alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, size, at, label, signs = [], [], [], [], [], []
            for doc, n, keys, places, own, sign in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                keys, places = np.frombuffer(keys, np.uint64), np.frombuffer(places, np.int32)
                if turn in how.one_key:
                    first = [np.lexsort((bt.mix(keys ^ np.uint64(turn)), places))[0]]
                    keys, places = keys[first], places[first]
                key.append(keys)
                at.append(places)
                for many, value in ((ids, doc), (size, n), (label, own)):
                    many.append(np.full(len(keys), value))
                signs += [b"" if turn in how.one_key else sign] * len(keys)
            if not key:
                continue
            key, at = np.concatenate(key), np.concatenate(at)
            ids, size, label = (np.concatenate(x).astype(np.int64) for x in (ids, size, label))
            by, starts = packed.parts(packed.bucket_of(bt.mix(key.copy()), buckets), buckets)
            out: dict[str, list] = {k: [] for k in _KEYS}
            for k in np.flatnonzero(np.diff(starts)):
                own = by[starts[k] : starts[k + 1]]
                for name, x in (("key", key), ("ids", ids), ("size", size.astype(np.int32)), ("at", at), ("label", label)):
                    out[name].append(packed.planes(x[own]))
                out["sign"].append(b"".join(signs[x] for x in own))
                out["bucket"].append(int(k))
            yield packed.batch(out, _KEYS)

    return run


def _may_link(size: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of a key's classes, sorted by size, may link with one of another label. If the key is the pair's first
    common one, their overlap is at most what each has from there on; both bounds limit the partner's size."""
    most = (size - at) * (100 + PERCENT) // PERCENT - size  # size of the largest partner
    best, other, holder = np.empty(len(size) + 1, np.int64), np.empty(len(size) + 1, np.int64), np.empty(len(size) + 1, np.int64)
    top, second, who = -1, -1, -1
    best[0], other[0], holder[0] = top, second, who
    for k, (m, own) in enumerate(zip(most.tolist(), label.tolist(), strict=True)):
        if own == who:
            top = max(top, m)
        elif m > top:
            top, second, who = m, top, own
        elif m > second:
            second = m
        best[k + 1], other[k + 1], holder[k + 1] = top, second, who
    reach = np.searchsorted(size, most, side="right")
    return np.where(holder[reach] == label, other[reach], best[reach]) >= size


def _partnered(buckets: int, least: int, block: int, near: Callable | None):
    """A bucket of keys: to each class the keys at which it may link by size, place and what ``near`` tells, named anew by who is left there, with (main, rest,
    side): how many classes there have the most frequent label and how many another, and which it is. Where they
    all meet at once, they count as main. Keys with fewer classes than ``least`` are left out."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": np.uint64, "ids": np.int64, "size": np.int32, "at": np.int32, "label": np.int64}
        key, ids, size, at, label = (np.concatenate([packed.from_planes(c, kind) for c in cells[k]]) for k, kind in kinds.items())
        order = np.lexsort((size, key))
        key, ids, size, at, label = key[order], ids[order], size[order].astype(np.int64), at[order].astype(np.int64), label[order]
        signs = np.frombuffer(b"".join(cells["sign"]), np.uint8)
        signs = signs.reshape(len(order), -1) if len(signs) else None
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(first[1:], len(key))
        use = (ends - first >= least) & (np.minimum.reduceat(label, first) < np.maximum.reduceat(label, first))
        docs, marks, counts, seen = [], [], [], set()
        for s, e in zip(first[use], ends[use], strict=True):
            may = _may_link(size[s:e], at[s:e], label[s:e])
            if near is not None and signs is not None and may.any():
                left = np.flatnonzero(may)
                may[left] = near(int(key[s]), signs[order[s + left]], label[s + left], size[s + left], at[s + left])
            own, labels = ids[s:e][may], label[s:e][may]
            if len(own) < least:
                continue
            mark = np.bitwise_xor.reduce(bt.mix(own.view(np.uint64) + np.uint64(77))) + np.uint64(len(own))
            if mark not in seen:  # the same classes met at another key of this bucket
                seen.add(mark)
                docs.append(own)
                marks.append(np.full(len(own), mark))
                side, main = np.zeros(len(own), np.int32), len(own)
                if len(own) > block:
                    _, number, many = np.unique(labels, return_inverse=True, return_counts=True)
                    side, main = (number != many.argmax()).astype(np.int32), int(many.max())
                counts.append(np.stack([np.full(len(own), main), np.full(len(own), len(own) - main), side], 1).astype(np.int32))
        if not docs:
            return
        ids, mark, many = np.concatenate(docs), np.concatenate(marks), np.concatenate(counts)
        by, starts = packed.parts(packed.bucket_of(bt.mix(ids.view(np.uint64).copy()), buckets), buckets)
        out: dict[str, list] = {k: [] for k in _KEYS}
        for k in np.flatnonzero(np.diff(starts)):
            own = by[starts[k] : starts[k + 1]]
            for name, x in (("key", mark), ("ids", ids), ("size", many[:, 0]), ("at", many[:, 1]), ("label", many[:, 2])):
                out[name].append(packed.planes(x[own]))
            out["sign"].append(b"")
            out["bucket"].append(int(k))
        yield packed.batch(out, _KEYS)

    return packed.gathered(each, list(_KEYS))


def _keys_by_class(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """(doc_id, keys, many) of a bucket of classes; many: main, rest and side of each key, one after another."""
    kinds = {"key": np.uint64, "ids": np.int64, "size": np.int32, "at": np.int32, "label": np.int32}  # main, rest, side
    key, ids, *many = (np.concatenate([packed.from_planes(c, kind) for c in cells[k]]) for k, kind in kinds.items())
    order = np.lexsort((key, ids))
    key, ids, many = key[order], ids[order], np.stack(many, 1)[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ends = np.append(first[1:], len(ids))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids[first]),
            pa.array([key[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary()),
            pa.array([many[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary()),
        ],
        ["doc_id", "keys", "many"],
    )


_MEETING = {"bucket": pa.int32(), "key": pa.int64(), "pair": pa.int64(), "doc_id": pa.int64(), "label": pa.int64(), "tokens": pa.binary()}
_MEETING_SCHEMA = "bucket int, key long, pair long, doc_id long, label long, tokens binary"


def meetings_of(doc: int, main: int, rest: int, side: int, block: int, turn: int) -> Iterator[int]:
    """Numbers of the meetings at a key that a class goes to. In all turns but the last (0) that is one.

    In the last one, all go to meeting 0 if there are few; else the meetings are those of a main and a rest
    block, in which both and the rest block's own classes meet, and those of two rest blocks."""
    draw = int(bt.mix(np.array([doc ^ turn * 0x2545F491], np.int64).view(np.uint64))[0])
    if turn:
        yield draw % -(-(main + rest) // block)
    elif main + rest <= block:
        yield 0
    else:
        mains, rests = (-(-n // (block // 2)) for n in (main, rest))
        if side == 0:
            yield from (draw % mains * rests + k for k in range(rests))
            return
        mine = draw % rests
        yield from (k * rests + mine for k in range(mains))
        yield from (mains * rests + min(mine, k) * rests + max(mine, k) for k in range(rests) if k != mine)


def _meetings(buckets: int, block: int, turn: int):
    """Rows (doc_id, label, size, tokens, keys, many): a row per key and meeting there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _MEETING}
            for row in range(batch.num_rows):
                doc, label, size, tokens, keys, many = (batch.column(k)[row].as_py() for k in range(6))
                cell = np.int32(size).tobytes() + tokens
                names, at = np.unique(np.frombuffer(keys, np.uint64), return_index=True)
                for key, held in zip(names, np.frombuffer(many, np.int32).reshape(-1, 3)[at].tolist(), strict=True):
                    for pair in meetings_of(doc, *held, block, turn):
                        spread = bt.mix(np.array([int(key) ^ pair * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))
                        for k, v in zip(_MEETING, (int(packed.bucket_of(spread, buckets)[0]), int(key.view(np.int64)), pair, doc, label, cell), strict=True):
                            out[k].append(v)
                if len(out["key"]) >= 500:
                    yield packed.batch(out, _MEETING)
                    out = {k: [] for k in _MEETING}
            yield packed.batch(out, _MEETING)

    return run


def _linked(sets: type[PrefixTree] | type[SetRows]):
    """A bucket of meetings: links between classes."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        key, pair, doc, label = (np.array(cells[k], np.int64) for k in ("key", "pair", "doc_id", "label"))
        order = np.lexsort((doc, pair, key))
        new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(pair[order]) != 0))
        first = np.flatnonzero(new)
        seen: set[tuple[int, int]] = set()
        for s, e in zip(first, np.append(first[1:], len(order)), strict=True):
            own = order[s:e]
            if len(own) < 2:
                continue
            sizes = np.array([np.frombuffer(cells["tokens"][k], np.int32, 1)[0] for k in own], np.int64)
            parts = [np.frombuffer(cells["tokens"][k], np.uint64, offset=4) for k in own]
            owner = np.repeat(np.arange(len(own), dtype=np.int32), [len(p) for p in parts])
            tokens = np.concatenate(parts)
            parts.clear()
            for k in own:
                cells["tokens"][k] = None  # a row is in one group only
            seen.update((int(doc[own[x]]), int(doc[own[y]])) for x, y in spanning_links(tokens, owner, sizes, PERCENT, label[own], sets))
        a, b = zip(*sorted(seen), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return packed.gathered(each, list(_MEETING))


def _links(labelled: DataFrame, buckets: int, block: int, turn: int, how: Keying) -> DataFrame:
    """(a, b): links between classes of different labels; in the last turn (0) enough to connect what they connect."""
    keys = labelled.select("doc_id", "size", "keys", "at", "label", "sign").mapInArrow(_keys_out(buckets, turn, how), _KEYS_SCHEMA)
    least = block + 1 if turn == 2 and turn not in how.one_key else 2
    left = packed.dealt(keys, buckets).mapInArrow(_partnered(buckets, least, block, how.near), _KEYS_SCHEMA)
    chosen = packed.dealt(left, buckets).mapInArrow(
        packed.gathered(_keys_by_class, list(_KEYS)), "doc_id long, keys binary, many binary"
    )
    met = labelled.select("doc_id", "label", "size", "tokens").join(chosen.hint("shuffle_hash"), "doc_id")
    meetings = met.select("doc_id", "label", "size", "tokens", "keys", "many").mapInArrow(_meetings(buckets, block, turn), _MEETING_SCHEMA)
    return packed.dealt(meetings, buckets).mapInArrow(_linked(how.sets), "a long, b long")


def _labelled(keyed: DataFrame, links: DataFrame | None) -> DataFrame:
    """With the component that each class is in so far."""
    if links is None:
        return keyed.withColumn("label", F.col("doc_id"))
    labels = components(links).select(F.col("id").alias("_id"), "component")
    found = keyed.join(labels.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    return written(found.select(*keyed.columns, F.coalesce("component", "doc_id").alias("label")), "join-labelled")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable by links).

    Two documents link where the Jaccard similarity of their sets of WORDS-word shingles (lower-cased
    A-Z; a text with fewer words is one shingle) reaches PERCENT, ties included. ids are integers.

    * null and empty texts have no shingle and link with nothing; very long texts count whole.
    * repeated rows (one id, one text) get equal results; rows with one id and different texts are
      documents of their own. A row with a null id links with nothing and has a null component.
      An empty table gives an empty result; other columns are ignored.
    """
    return joined(docs, id_col, text_col, WORDS, Keying(prefix_keyed), block)


def joined(docs: DataFrame, id_col: str, text_col: str, words: int, how: Keying, block: int) -> DataFrame:
    """doc_id, n_shingles, component_id as in ngram_join, of shingles of so many words."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    known = narrow.where("doc_id is not null")
    plan = packed.layout(known)
    if plan.unique:
        out = _joined(known, plan, words, how, block)
    else:  # numbers tell the rows apart; written, so that they stay the same
        numbered = written(known.select("doc_id", "text", F.monotonically_increasing_id().alias("_n")), "join-numbered")
        found = _joined(numbered.select(F.col("_n").alias("doc_id"), "text"), plan, words, how, block)
        found = found.select(F.col("doc_id").alias("_n"), "n_shingles", F.col("component_id").alias("_c"))
        named = written(found.join(numbered.select("doc_id", "_n"), "_n"), "join-named")
        least = named.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
        out = named.join(least, "_c").select("doc_id", "n_shingles", "component_id")
    nameless = narrow.where("doc_id is null").mapInArrow(_counted(words), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(nameless)


def _joined(known: DataFrame, plan: packed.Layout, words: int, how: Keying, block: int) -> DataFrame:
    """joined() of rows (doc_id, text) whose ids stand for one text each."""
    buckets = plan.buckets
    sampled = known.mapInArrow(_sampled(buckets, plan.slice_bytes(SLICE), words), _SCHEMA)
    decided = _spared(sampled, buckets).selectExpr("doc_id", "n_shingles", "n_shingles > 0 AND spare >= 0 AS active")
    decided = written(decided, "join-decided")
    active = decided.where("active").select("doc_id").distinct()
    texts = known.join(active.hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    sets = written(texts.mapInArrow(_sets(words), "doc_id long, size int, one long, other long, tokens binary"), "join-sets")
    classes = written(sets.groupBy("one", "other", "size").agg(F.min("doc_id").alias("rep")), "join-classes")
    member = sets.select("doc_id", "one", "other", "size").distinct().join(classes, ["one", "other", "size"]).select("doc_id", "rep")
    member = written(member, "join-members")
    heads = sets.join(classes.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads = written(heads.select("doc_id", "size", "tokens"), "join-heads")
    found = _connected(written(how.keyed(heads, buckets), "join-keyed"), buckets, block, how)
    named = member.join(found, member["rep"] == found["id"], "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("_component")
    )
    return decided.join(named, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")
    )


def prefix_keyed(heads: DataFrame, buckets: int) -> DataFrame:
    """The marks of the tokens in each class's prefix, in the global order of tokens. Tokens are counted by packs of classes, so
    one that a third of all classes hold is an entry for each pack."""
    packs = written(heads.where("size > 0").select("doc_id", "size", "tokens").mapInArrow(_packs, _PACKS_SCHEMA), "join-packs")
    sent = packed.dealt(packs.select("pack", "ids", "counts", "tokens").mapInArrow(_tokens_out(buckets), _TOKENS_SCHEMA), buckets)
    held = packed.dealt(sent.mapInArrow(_holders(buckets), _TOKENS_SCHEMA), buckets)
    answers = held.mapInArrow(packed.gathered(_answers, list(_TOKENS)), "pack long, hash binary, held binary, mark binary")
    met = packs.join(answers.hint("shuffle_hash"), "pack")
    return met.select("ids", "sizes", "counts", "tokens", "hash", "held", "mark").mapInArrow(_keyed, KEYED_SCHEMA)


def _connected(keyed: DataFrame, buckets: int, block: int, how: Keying) -> DataFrame:
    """(id, component) of the classes that link with any other."""
    labelled = _labelled(keyed, None)
    links = written(_links(labelled, buckets, block, 1, how), "join-links")
    labelled = _labelled(keyed, links)
    more = written(_links(labelled, buckets, block, 2, how), "join-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labelled = _labelled(keyed, links)
    last = written(_links(labelled, buckets, block, 0, how), "join-links")
    return components(links.unionByName(last))


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b, offsets in bt.text_slices(batch.column(1), SLICE):
                n = np.bincount(shingles(b, offsets, words)[0], minlength=end - row)
                ids = batch.column(0).slice(row, end - row)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), ids], ["doc_id", "n_shingles", "component_id"])

    return run


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the least id, nulls last; of rows with one
    id any one, the same each time. Texts without words link with nothing, so all of these rows stay."""
    row, given, n = fresh(docs, "_row", "_given", "_n")
    per_id = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias(n))
    if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte") and per_id.where((F.col(n) > 1) | F.col(id_col).isNull()).isEmpty():
        numbered = docs.withColumn(row, F.col(id_col).cast("long"))
    else:  # numbers tell the rows apart; written, so that they stay the same
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "join-rows")
    found = ngram_join(numbered, row, text_col).select("doc_id", "component_id")
    ids = numbered.select(F.col(row).alias("doc_id"), F.col(id_col).alias(given))
    first = F.min(F.struct(F.col(given).isNull(), given, "doc_id")).alias("_first")
    stay = found.join(ids, "doc_id").groupBy("component_id").agg(first).select(F.col("_first.doc_id").alias("_stays"))
    return numbered.join(stay, F.col(row) == F.col("_stays"), "left_semi").drop(row)
