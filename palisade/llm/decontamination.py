"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK walk reads a string byte by byte; at each step a random function of the step and the byte
tells whether to go on to the next byte or to stay. Two strings at a small edit distance give
walks at a small Hamming distance. Each of REPETITIONS draws its own walk and its own sampled
steps; a window of a document and a window of an item collide where all sampled bytes agree.

Windows start at words and, within runs without a word's end (unspaced scripts), at places that the
bytes around them choose. Each repetition uses half of the starts, chosen by a hash of the
word, so documents and items choose alike; different repetitions choose different halves.
The sampled bytes are compared in the order of the walk, and starts that agree with no item so far
leave it early: the result is that of the full walk. A collision at some start of an item fixes
where the item-sized window of the document lies; there the exact edit distance (least
over the window's substrings, by a bit-parallel recurrence over many windows at once) decides,
unless the window lacks more of the item's trigrams than the allowed edits could change.

Items with fewer than LEAST_TRIALS chances to collide (short ones, say) aren't left to chance. Cut into one piece more
than they may have edits, one piece is left as it is; an automaton of all pieces finds these in the texts, and the same
recurrence goes over what lies around them.

Texts are compared after lower-casing A-Z and collapsing white space, in UTF-8 bytes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bytetools as bt

#: An item leaks where 1 - distance / item length reaches this.
SIMILARITY = 0.8
REPETITIONS = 16
#: Steps of a walk, by the bytes that an item must have for it; an item uses the longest it can.
WALKS = (64, 24, 8)
SAMPLES = 11
#: Starts of an item over all repetitions that make a search by collisions reliable.
LEAST_TRIALS = 12
#: Bytes of a run without a word's end from which on it has starts inside, and how far apart they are at least.
LONG_RUN, APART = 24, 4
#: Items that are searched at once; more are taken block by block.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are searched at once; of a window around pieces; windows at once.
SLICE, LOOK, MANY = 4 << 20, 512, 4096


def normalised(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space runs as one space, none at the ends, and their offsets."""
    space = ~bt.not_space(b)
    low = np.where(space, np.uint8(32), bt.lower_ascii(b))
    first = np.zeros(len(b) + 1, bool)
    first[offsets] = True
    before = np.append(True, space[:-1]) | first[:-1] if len(b) else space
    keep = ~(space & before)
    total = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], total[offsets]


def word_starts(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and hash of each word (a run of letters and digits), and of the places inside long ones whose
    four bytes hash to less than those around them."""
    start, end, text = bt.spans(((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128), offsets)
    h = bt.span_hashes(b, start, end)
    long = np.flatnonzero(end - start >= LONG_RUN)
    if not len(long):
        return start, text, h
    size = end[long] - start[long] - 3
    own = np.repeat(np.arange(len(long)), size)
    p = start[long][own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    four = bt.span_hashes(b, p, p + 4)
    least = np.ones(len(p), bool)
    for k in range(1, APART):  # neighbours in this order are of one run, or count as other bytes would
        least[k:] &= four[k:] < four[:-k]
        least[:-k] &= four[:-k] <= four[k:]
    inside = least & (p > start[long][own])
    p, own, four = p[inside], own[inside], four[inside]
    order = np.argsort(np.concatenate([start, p]), kind="stable")
    return tuple(np.concatenate(x)[order] for x in ((start, p), (text, text[long][own]), (h, four)))


def _letters_of(items: list[bytes], words: int) -> np.ndarray:
    """[item, byte, word] bits of the places where a byte stands in an item. Items end at the last bit; the bits
    before their first stand for any byte."""
    out = np.zeros((len(items), 256, words), np.uint64)
    for k, item in enumerate(items):
        at = np.arange(len(item)) + 64 * words - len(item)
        np.bitwise_or.at(out[k], (np.frombuffer(item, np.uint8), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        out[k] |= ~_from_bit(64 * words - len(item), words)
    return out


def _from_bit(first: int, words: int) -> np.ndarray:
    """Words in which the bits from ``first`` on are set."""
    bits = ((1 << 64 * words) - 1) >> first << first
    return np.frombuffer(bits.to_bytes(8 * words, "little"), np.uint64)


def least_distances(items: list[bytes], which: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window (low, high) of b: the least edit distance of its item to a substring, and where that ends in the
    window (the first of equals); (most + 1, -1) if it is above ``most``. Bit-parallel over an item's bytes in
    words of 64, and over the windows; exact."""
    n = np.array([len(x) for x in items], np.int64)
    best, end = most.astype(np.int64) + 1, np.full(len(which), -1)
    words = 1 << np.ceil(np.log2(np.maximum(-(-n[which] // 64), 1))).astype(np.int64)
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        own = own[np.argsort((high - low)[own], kind="stable")]
        for s in range(0, len(own), MANY):
            part = own[s : s + MANY]
            used, item = np.unique(which[part], return_inverse=True)
            texts = [items[k] for k in used]
            best[part], end[part] = _least(texts, item, w, b, low[part], high[part], best[part])
    return best, end


def _least(items: list[bytes], item: np.ndarray, w: int, b: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """least_distances of windows whose items have at most w words."""
    letters, size = _letters_of(items, w), high - low
    longest = int(size.max())
    at = low[:, None] + np.arange(longest)
    text = np.where(np.arange(longest) < size[:, None], b[np.minimum(at, len(b) - 1)], 255).T.copy()  # 255: in no text
    start = np.stack([_from_bit(64 * w - len(x), w) for x in items])[item]
    up, down = [start[:, k].copy() for k in range(w)], [np.zeros(len(item), np.uint64) for _ in range(w)]
    score = np.array([len(x) for x in items], np.int64)[item]
    least, where, one, last = best, np.full(len(item), -1), np.uint64(1), np.uint64(63)
    for step in range(longest):
        same = letters[item, text[step]].T
        plus_in = minus_in = np.uint64(0)
        for k in range(w):
            v, u = down[k], up[k]
            e = same[k] | minus_in
            across = same[k] | v
            diagonal = (((e & u) + u) ^ u) | e
            plus, minus = v | ~(diagonal | u), u & diagonal
            plus_out, minus_out = plus >> last, minus >> last
            plus, minus = (plus << one) | plus_in, (minus << one) | minus_in
            up[k], down[k] = minus | ~(across | plus), plus & across
            plus_in, minus_in = plus_out, minus_out
        score += plus_in.view(np.int64)
        score -= minus_in.view(np.int64)
        less = score < least
        if less.any():
            least, where = np.where(less, score, least), np.where(less, step + 1, where)
    return least, where


def trigrams(b: np.ndarray) -> np.ndarray:
    """A 16-bit code of the three bytes from each place on."""
    w = b.astype(np.uint16)
    return (w[:-2] << np.uint16(10)) ^ (w[1:-1] << np.uint16(5)) ^ w[2:] if len(b) > 2 else w[:0]


#: The class of a byte, on which a walk's moves depend, so that the classes of four bytes are a 16-bit code.
_CLASS = np.random.default_rng(77).permutation(256).astype(np.uint16) % np.uint16(16)
AT_ONCE = 4


def codes_of(b: np.ndarray) -> np.ndarray:
    """The classes of the four bytes from each place on; b ends with as many zeros as a walk has steps."""
    kind = _CLASS[np.append(b, np.zeros(AT_ONCE, np.uint8))]
    n = len(b)
    return kind[:n] | kind[1 : n + 1] << np.uint16(4) | kind[2 : n + 2] << np.uint16(8) | kind[3 : n + 3] << np.uint16(12)


@dataclass
class Repetition:
    """One walk, its sampled steps, and the items' sampled bytes as sorted keys. The walk's steps are taken AT_ONCE at
    a time, by tables of how far the first of them go from each code on."""

    tables: dict[tuple[int, int], np.ndarray]
    samples: np.ndarray
    salt: int
    keys: np.ndarray = field(default=None)
    item: np.ndarray = field(default=None)
    offset: np.ndarray = field(default=None)
    early: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def drawn(steps: int, seed: int) -> Repetition:
        r = np.random.default_rng(seed)
        many = min(SAMPLES, max(4, steps // 2))
        # four of them at once, so that most walks end there, then most of the rest in the first half
        head, half = max(many * 5 // 8 - 4, 0), max(steps // 2, 4)
        soon = [r.choice(part, min(2, many // 2), replace=False) for part in (np.arange(4), np.arange(4, max(10, 4)))]
        samples = np.unique(np.concatenate([*soon, r.choice(np.arange(10, max(half, 11 + head)), head, replace=False), r.choice(np.arange(half, steps), many - 4 - head, replace=False)])) if steps > 24 else np.sort(r.choice(steps, many, replace=False))
        moves, code = r.integers(0, 2, (steps, 16)).astype(np.uint8), np.arange(1 << 16, dtype=np.uint16)
        wanted, tables = {(t // AT_ONCE, t % AT_ONCE) for t in samples.tolist()}, {}
        for g in range(-(-steps // AT_ONCE)):
            gone = np.zeros(1 << 16, np.uint8)
            for j in range(min(AT_ONCE, steps - g * AT_ONCE)):
                if j and (g, j) in wanted:
                    tables[g, j] = gone.copy()
                gone += moves[g * AT_ONCE + j][(code >> (gone.astype(np.uint16) * np.uint16(4))) & np.uint16(15)]
            tables[g, AT_ONCE] = gone
        return Repetition(tables, np.sort(samples), int(seed))

    def chosen(self, word_hash: np.ndarray) -> np.ndarray:
        return (word_hash >> bt.U64(self.salt % 32)) & bt.U64(1) == 0

    def walk(self, b: np.ndarray, codes: np.ndarray, start: np.ndarray, known: bool) -> tuple[np.ndarray, np.ndarray | list]:
        """b ends with as many zeros as there are steps. For documents (known): which starts agree with
        an item, and their keys; for items: all keys, and the keys so far after each sample."""
        at, index, h = start.astype(np.int64), np.arange(len(start)), np.zeros(len(start), np.uint32)
        so_far, group, code = [], 0, codes.take(at)
        for k, sample in enumerate(self.samples.tolist(), 1):
            while group < sample // AT_ONCE:
                at += self.tables[group, AT_ONCE].take(code)
                code = codes.take(at)
                group += 1
            part = sample % AT_ONCE
            c = b.take(at + self.tables[group, part].take(code) if part else at)
            h = (h ^ c) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
            h ^= h >> np.uint32(13)
            if not known:
                so_far.append(h.copy())
            elif k in self.early:
                on = np.flatnonzero(self.early[k].take(h & np.uint32(0xFFFF)))
                at, index, h, code = at.take(on), index.take(on), h.take(on), code.take(on)
                if not len(at):
                    break
        return (index, h) if known else (h, so_far)

    def learn(self, b: np.ndarray, codes: np.ndarray, start: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        h, so_far = self.walk(b, codes, start, known=False)
        order = np.argsort(h, kind="stable")
        self.keys, self.item, self.offset = h[order], item[order], offset[order]
        for k in range(min(2, len(so_far)), len(so_far) + 1):
            seen = np.zeros(1 << 16, bool)
            seen[so_far[k - 1] & np.uint32(0xFFFF)] = True
            if k > 3 or k == len(so_far):  # the first few tell little
                self.early[k] = seen


class ItemIndex:
    """What a task needs to find a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], similarity: float, repetitions: int):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        b, offsets = normalised(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids = [k for k, _ in items]
        self.texts = [b[s:e].tobytes().rstrip(b" ") for s, e in zip(offsets, offsets[1:], strict=False)]
        self.most = [math.floor((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.grams = [trigrams(np.frombuffer(t, np.uint8)) for t in self.texts]
        start, item, h = word_starts(b, offsets)
        size = np.array([len(t) for t in self.texts], np.int64)
        left = offsets[item] + size[item] - start if len(start) else start
        padded = np.append(b, np.zeros(WALKS[0], np.uint8))
        codes = codes_of(padded)
        self.repetitions = []
        trials = np.zeros(len(items), np.int64)
        for w, steps in enumerate(WALKS):
            fits = (size >= steps) & ((size < WALKS[w - 1]) if w else True)
            for k in range(repetitions if fits.any() else 0):
                r = Repetition.drawn(steps, 1000 * w + k)
                use = fits[item] & (left >= steps // 2 + 1) & r.chosen(h) if len(start) else np.zeros(0, bool)
                if use.any():
                    r.learn(padded, codes, start[use], item[use], (start - offsets[item])[use])
                    self.repetitions.append(r)
                    trials += np.bincount(item[use], minlength=len(items))
        self.pieces = self._pieces(np.flatnonzero((trials < LEAST_TRIALS) & (size > 0)))

    def _pieces(self, items: np.ndarray):
        """An automaton of the pieces of the items that have too few starts. Cut into one piece more than it may have
        edits, an item leaves one of them as it is wherever it is found."""
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for i in items.tolist():
            cuts = np.linspace(0, len(self.texts[i]), self.most[i] + 2).astype(int).tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                places.setdefault(self.texts[i][s:e].decode("latin-1"), []).append((i, s))
        if not places:
            return None
        automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            automaton.add_word(piece, (len(piece), where))
        automaton.make_automaton()
        return automaton

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of the items found in some texts, the best of each pair."""
        b, offsets = normalised(raw, offsets)
        start, text, h = word_starts(b, offsets)
        padded = np.append(b, np.zeros(WALKS[0], np.uint8))
        codes = codes_of(padded)
        spots: dict[tuple[int, int], set[int]] = {}
        for r in self.repetitions:
            use = np.flatnonzero(r.chosen(h))
            index, keys = r.walk(padded, codes, start[use], known=True)
            low = np.searchsorted(r.keys, keys, "left")
            many = np.searchsorted(r.keys, keys, "right") - low
            if not many.any():
                continue
            entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            word = np.repeat(use[index], many)
            begin = start[word] - r.offset[entry]
            for t, i, s in set(zip(text[word].tolist(), r.item[entry].tolist(), (begin // 16).tolist(), strict=True)):
                spots.setdefault((t, i), set()).add(s * 16)
        windows, three = [], trigrams(b) if spots else None  # (text, item, low, high)
        for (t, i), begins in spots.items():
            size, most, grams = len(self.texts[i]), self.most[i], self.grams[i]
            done = -1
            for s in sorted(begins):
                low = max(int(offsets[t]), s - most - 16)
                high = min(int(offsets[t + 1]), s + size + most + 32)
                if high <= done:  # this window was searched with the last
                    continue
                done = high - most
                here = np.zeros(1 << 16, bool)
                here[three[low : max(high - 2, low)]] = True
                if np.count_nonzero(~here[grams]) <= 3 * most:  # an edit changes three trigrams at most
                    windows.append((t, i, low, high))
        windows += self._piece_windows(b, offsets)
        if not windows:
            return []
        t, i, low, high = np.array(windows, np.int64).T
        best, end = least_distances(self.texts, i, b, low, high, np.array(self.most, np.int64)[i])
        hit = np.flatnonzero(end >= 0)
        t, i, best, end = t[hit], i[hit], best[hit], end[hit] + low[hit] - offsets[t[hit]]
        order = np.lexsort((end, best, i, t))  # of each pair the nearest match, the first of equals
        t, i, best, end = t[order], i[order], best[order], end[order]
        first = np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]))[: len(t)]
        return list(zip(*(x[first].tolist() for x in (t, i, best, end)), strict=True))

    def _piece_windows(self, b: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows around the pieces that stand in the texts; near ones are one."""
        if self.pieces is None:
            return []
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        ends = offsets.tolist()
        for last, (size, where) in self.pieces.iter(b.tobytes().decode("latin-1")):
            begin = last + 1 - size
            t = bisect_right(ends, begin) - 1
            if last >= ends[t + 1]:
                continue  # across two texts
            for i, at in where:
                low, high = begin - at - self.most[i], begin - at + len(self.texts[i]) + self.most[i]
                own, window = found.setdefault((t, i), []), (max(low, ends[t]), min(high, ends[t + 1]))
                over = len(self.texts[i]) + self.most[i]
                if own and own[-1][0] <= window[0] and window[1] - own[-1][0] <= max(LOOK, 4 * over):
                    own[-1] = (own[-1][0], max(own[-1][1], window[1]))
                else:
                    own.append(window)
        return [(t, i, low, high) for (t, i), own in found.items() for low, high in own]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """A row per document and item that leaks into it: doc_id, item_id, edit_distance, similarity,
    end_byte (where the best match ends in the normalised text; ties: the first).

    * null and empty documents hold nothing; null and blank items are never found; windows that
      overlap a document's end are cut there; whole texts are searched.
    * a repeated document row gives its rows again; repeated item rows give a row each; null
      ids pass through; empty tables give an empty result; other columns are ignored.

    Items go to the tasks in blocks of at most BLOCK_BYTES, each searched over all documents. The driver
    holds one block at a time; a worker makes the index of a block once.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [narrow.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edit_distance int, similarity double, end_byte int"
    out = None
    for index in _indexes(items, item_id_col, item_text_col, similarity, repetitions):
        part = _searched(narrow, index, to_arrow_type(items.schema[item_id_col].dataType), schema)
        out = part if out is None else out.unionByName(part)
    return out


_made: dict[object, ItemIndex] = {}


def _indexes(items: DataFrame, id_col: str, text_col: str, similarity: float, repetitions: int) -> Iterator[Callable[[], ItemIndex]]:
    """For each block of items a function that gives its index in a worker."""
    context = items.sparkSession.sparkContext
    known = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        of_block = known.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in of_block.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        sent = context.broadcast(rows)  # a block of items
        yield _index_of(sent, (context.applicationId, sent._jbroadcast.id()), similarity, repetitions)


def _index_of(sent, key: object, similarity: float, repetitions: int) -> Callable[[], ItemIndex]:
    def index() -> ItemIndex:
        if key not in _made:
            _made.clear()
            _made[key] = ItemIndex(sent.value, similarity, repetitions)
        return _made[key]

    return index


def _searched(narrow: DataFrame, index: Callable[[], ItemIndex], item_kind: pa.DataType, schema: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        for batch in batches:
            for row, _, b, offsets in bt.text_slices(batch.column(1), SLICE):
                found = own.find(b, offsets)
                if not found:
                    continue
                t, i, d, e = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row + k for k in t], pa.int64())),
                        pa.array([own.ids[k] for k in i], item_kind),
                        pa.array(d, pa.int32()),
                        pa.array([1 - x / len(own.texts[k]) for x, k in zip(d, i, strict=True)], pa.float64()),
                        pa.array(e, pa.int32()),
                    ],
                    ["doc_id", "item_id", "edit_distance", "similarity", "end_byte"],
                )

    return narrow.mapInArrow(search, schema)


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns, without a shuffle. Each row is judged by its own text,
    so null and repeated ids change nothing; null and empty texts stay."""
    at, out = docs.columns.index(text_col), docs
    for index in _indexes(items, "item_id", "text", SIMILARITY, REPETITIONS):
        out = out.mapInArrow(_without(index, at), docs.schema)
    return out


def _without(index: Callable[[], ItemIndex], at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        for batch in batches:
            for row, end, b, offsets in bt.text_slices(batch.column(at), SLICE):
                stays = np.ones(end - row, bool)
                stays[[t for t, *_ in own.find(b, offsets)]] = False
                yield batch.slice(row, end - row).filter(pa.array(stays))

    return keep
