"""Phrase collocation mining by hierarchical pair naming.

Texts are cut into pieces and words once, into slices: packed rows that hold the places of words and a slice's
own dictionary. Then, for phrases of 1, 2, ... LONGEST words:

1. each slice sends its distinct items, with how often they occur in it, to the items' buckets. For one word
   an item is the word with its language; for more, a pair of names of phrases that are one word shorter and
   start one word apart (the phrase's first and last part, which overlap but for a word each);
2. a bucket adds up the counts. Items with LEAST occurrences get a name, which is a number, and the
   slices are told the names of their items. A frequent phrase has frequent parts only, so nothing else is needed;
3. each slice replaces its items by names and keeps the places that have one.

A name's pair points to its parents: down the first ones are the beginnings of a phrase, down the last ones its
ends, so cuts need no other lookup; and a phrase lies within a longer one of the same frequency just if it is a
parent of one. Words are compared as bytes and pairs as numbers; there are no hashes but for dealing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetools as bt
from . import packed
from .common import shuffle_partitions, text_of, written

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN_LANG = "und"
#: Bytes of text of a slice, candidates that are ranked together at first.
SLICE, RANKED = 1 << 20, 100_000
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_SLICES = "slice long, at binary, item binary, keys binary, lengths binary, langs array<string>, totals array<long>"
_ITEMS = {"bucket": pa.int32(), "slice": pa.int64(), "item": pa.binary(), "n": pa.binary(), "left": pa.binary(), "right": pa.binary()}
_ITEMS_SCHEMA = "bucket int, slice long, item binary, n binary, left binary, right binary"
#: Rows of a bucket: names with their items and counts (no slice), and answers to a slice.
_NAMED = {"slice": pa.int64(), "item": pa.binary(), "name": pa.binary(), "n": pa.binary(), "left": pa.binary(), "right": pa.binary()}
_NAMED_SCHEMA = "slice long, item binary, name binary, n binary, left binary, right binary"
_SEQUENCES = {"slice": pa.int64(), "at": pa.binary(), "name": pa.binary()}
_SEQUENCES_SCHEMA = "slice long, at binary, name binary"


def words_of(b: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, text, place) of all words of some texts, lower-cased; places of one piece follow each other, and
    between pieces one is left out."""
    low = bt.lower_ascii(b)
    mask = ~(_SEPARATORS[low] | _BLANK[low])
    start, end, text = bt.spans(mask, offsets)
    cuts = np.append(0, np.cumsum(_SEPARATORS[low]))
    apart = np.append(False, (text[1:] != text[:-1]) | (cuts[start[1:]] != cuts[end[:-1]])) if len(text) else np.zeros(0, bool)
    lengths = np.append(0, np.cumsum(end - start))
    words = _strings(low[mask].tobytes(), lengths)
    return words, text, np.arange(len(text)) + np.cumsum(apart)


def _strings(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def _bytes_of(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes, and the lengths."""
    strings = pa.concat_arrays([strings])  # no offset
    ends = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    data = strings.buffers()[2]
    return (data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""), np.diff(ends).astype(np.int32)


def _steps(at: np.ndarray) -> bytes:
    """Growing places in a slice, as steps."""
    return packed.narrow(np.diff(at, prepend=0).astype(np.int32))


def _from_steps(cell: bytes) -> np.ndarray:
    return np.cumsum(packed.from_narrow(cell, np.int32), dtype=np.int64)


def _sliced(slice_bytes: int):
    """Rows (lang, text) -> slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code, langs = lang.indices.to_numpy(), lang.dictionary.cast(pa.large_binary())
            for row, _, b, offsets in bt.text_slices(batch.column(1), slice_bytes):
                words, text, at = words_of(b, offsets)
                if not len(words):
                    continue
                word = words.dictionary_encode()
                many = len(word.dictionary)
                own, item = np.unique(code[row + text].astype(np.int64) * many + word.indices.to_numpy(), return_inverse=True)
                keys = pc.binary_join_element_wise(langs.take(pa.array(own // many)), word.dictionary.take(pa.array(own % many)), pa.scalar(b" ", pa.large_binary()))
                data, lengths = _bytes_of(keys)
                total = np.bincount(code[row + text], minlength=len(langs))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([_steps(at)], pa.binary()),
                        pa.array([packed.narrow(item.astype(np.int32))], pa.binary()),
                        pa.array([data], pa.binary()),
                        pa.array([packed.narrow(lengths)], pa.binary()),
                        pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())),
                        pa.array([total.tolist()], pa.list_(pa.int64())),
                    ],
                    ["slice", "at", "item", "keys", "lengths", "langs", "totals"],
                )
                number += 1

    return run


def _pairs(at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of names at places: (place, item) of all pairs one word apart, and (left, right, n) of the distinct items."""
    next_to = np.flatnonzero(np.diff(at) == 1)
    names, code = np.unique(name, return_inverse=True)
    key, first, item, n = np.unique(code[next_to] * len(names) + code[next_to + 1], return_index=True, return_inverse=True, return_counts=True)
    return at[next_to], item, name[next_to[first]], name[next_to[first] + 1], n


def _asked_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, item, keys, lengths in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ends = np.append(0, np.cumsum(packed.from_narrow(lengths, np.int32), dtype=np.int64))
                n = np.bincount(packed.from_narrow(item, np.int32), minlength=len(ends) - 1)
                h = bt.word_hashes(np.frombuffer(keys, np.uint8), ends[:-1], ends[1:])
                words, out = _strings(keys, ends), {k: [] for k in _ITEMS}
                by, starts = packed.parts(packed.bucket_of(h, buckets), buckets)
                for k in np.flatnonzero(np.diff(starts)):
                    own = by[starts[k] : starts[k + 1]]
                    data, size = _bytes_of(words.take(pa.array(own)))
                    _add(out, k, number, own, n[own], data, packed.narrow(size))
                yield packed.batch(out, _ITEMS)

    return run


def _asked_pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, at, name in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                _, _, left, right, n = _pairs(_from_steps(at), packed.from_narrow(name, np.int64))
                h = bt.mix(bt.mix(left.astype(np.uint64)) ^ right.astype(np.uint64))
                out: dict[str, list] = {k: [] for k in _ITEMS}
                by, starts = packed.parts(packed.bucket_of(h, buckets), buckets)
                for k in np.flatnonzero(np.diff(starts)):
                    own = by[starts[k] : starts[k + 1]]
                    _add(out, k, number, own, n[own], packed.narrow(left[own]), packed.narrow(right[own]))
                yield packed.batch(out, _ITEMS)

    return run


def _add(out: dict[str, list], bucket: int, number: int, item: np.ndarray, n: np.ndarray, left: bytes, right: bytes) -> None:
    cells = (int(bucket), number, packed.narrow(item.astype(np.int32)), packed.narrow(n.astype(np.int64)), left, right)
    for k, v in zip(_ITEMS, cells, strict=True):
        out[k].append(v)


def _grouped_words(cells: dict[str, list]) -> tuple[np.ndarray, int, Callable]:
    """The group of each word of a bucket, how many there are, and what gives some groups' cells in a fixed order."""
    lengths = np.concatenate([packed.from_narrow(c, np.int32) for c in cells["right"]])
    found = _strings(b"".join(cells["left"]), np.append(0, np.cumsum(lengths, dtype=np.int64))).dictionary_encode()

    def chosen(groups: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
        words = found.dictionary.take(pa.array(groups))
        order = pc.sort_indices(words)
        data, size = _bytes_of(words.take(order))
        return groups[order.to_numpy()], data, packed.narrow(size)

    return found.indices.to_numpy(), len(found.dictionary), chosen


def _grouped_pairs(cells: dict[str, list]) -> tuple[np.ndarray, int, Callable]:
    left, right = (np.concatenate([packed.from_narrow(c, np.int64) for c in cells[k]]) for k in ("left", "right"))
    order = np.lexsort((right, left))
    new = np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]

    def chosen(groups: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
        return groups, packed.narrow(left[first[groups]]), packed.narrow(right[first[groups]])

    return group, len(first), chosen


def _named(buckets: int, grouped: Callable, least: int):
    """A bucket of items: names of the frequent ones, and answers to the slices that have them."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        group, many, chosen = grouped(cells)
        counts = [packed.from_narrow(c, np.int64) for c in cells["n"]]
        total = np.zeros(many, np.int64)
        np.add.at(total, group, np.concatenate(counts))
        frequent, left, right = chosen(np.flatnonzero(total >= least))
        name = np.full(many, -1, np.int64)
        name[frequent] = np.arange(len(frequent)) * buckets + cells["bucket"][0]
        out: dict[str, list] = {k: [] for k in _NAMED}

        def add(*row) -> None:
            for k, v in zip(_NAMED, row, strict=True):
                out[k].append(v)

        if len(frequent):
            add(None, b"", packed.narrow(name[frequent]), packed.narrow(total[frequent]), left, right)
        ends = np.cumsum([len(c) for c in counts])
        for number, item, s, e in zip(cells["slice"], cells["item"], ends - [len(c) for c in counts], ends, strict=True):
            own = name[group[s:e]]
            has = own >= 0
            if has.any():
                add(number, packed.narrow(packed.from_narrow(item, np.int32)[has]), packed.narrow(own[has]), b"", b"", b"")
            if len(out["slice"]) >= 500:
                yield packed.batch(out, _NAMED)
                for v in out.values():
                    v.clear()
        yield packed.batch(out, _NAMED)

    return packed.gathered(each, list(_ITEMS))


_MEETING = {"to": pa.int32(), "slice": pa.int64(), "at": pa.binary(), "item": pa.binary(), "name": pa.binary()}
_MEETING_SCHEMA = "to int, slice long, at binary, item binary, name binary"


def _renamed(paired: bool):
    """Slices and the answers to them: what is named, by its new names."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list] = {}
        for number, at, item, name in zip(cells["slice"], cells["at"], cells["item"], cells["name"], strict=True):
            if at is None:
                answers.setdefault(number, []).append((packed.from_narrow(item, np.int32), packed.from_narrow(name, np.int64)))
        for number, at, item, name in zip(cells["slice"], cells["at"], cells["item"], cells["name"], strict=True):
            if at is None or number not in answers:
                continue
            places = _from_steps(at)
            if paired:
                places, items, *_ = _pairs(places, packed.from_narrow(name, np.int64))
            else:
                items = packed.from_narrow(item, np.int32)
            of = np.full(int(items.max(initial=-1)) + 1, -1, np.int64)
            for asked, got in answers.pop(number):
                of[asked] = got
            new = of[items]
            has = new >= 0
            yield packed.batch({"slice": [number], "at": [_steps(places[has])], "name": [packed.narrow(new[has])]}, _SEQUENCES)

    return packed.gathered(each, list(_MEETING))


def _told(named: DataFrame, word: bool) -> DataFrame:
    """The names of a level as rows: name, n, and the word's key or left and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, left, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                columns = [pa.array(packed.from_narrow(name, np.int64)), pa.array(packed.from_narrow(n, np.int64))]
                if word:
                    ends = np.append(0, np.cumsum(packed.from_narrow(right, np.int32), dtype=np.int64))
                    columns.append(_strings(left, ends).cast(pa.binary()))
                else:
                    columns += [pa.array(packed.from_narrow(c, np.int64)) for c in (left, right)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "f", "key"] if word else ["name", "f", "left", "right"])

    rows = named.where("slice is null").select("name", "n", "left", "right")
    return rows.mapInArrow(run, "name long, f long, key binary" if word else "name long, f long, left long, right long")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A phrase occurs a >= least times within pieces (texts are cut at ``. , ; : ! ?`` and line ends). Cut into
    two parts that occur l and r times among n words, it scores floor(1000 a n / (l r)), where the cut with the
    lowest score counts. Phrases that lie inside a longer one with as many occurrences are left out.

    * null texts count as empty, a null language as ``und``; very long texts count whole.
    * rows are occurrences: repeated rows, whatever their ids, count again each. An empty table, or one without
      a phrase that is frequent enough, gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spread = packed.Layout(max(shuffle_partitions(docs.sparkSession), -(-size // packed.BUCKET_BYTES)), True)
    buckets = spread.buckets
    slices = written(rows.mapInArrow(_sliced(spread.slice_bytes(SLICE)), _SLICES), "phrases-slices")
    sequences, grams, levels = slices, None, []
    for words in range(1, longest + 1):
        if words == 1:
            asked = slices.select("slice", "item", "keys", "lengths").mapInArrow(_asked_words(buckets), _ITEMS_SCHEMA)
            grouped = _grouped_words
        else:
            asked = sequences.select("slice", "at", "name").mapInArrow(_asked_pairs(buckets), _ITEMS_SCHEMA)
            grouped = _grouped_pairs
        named = written(packed.dealt(asked, buckets).mapInArrow(_named(buckets, grouped, least), _NAMED_SCHEMA), "phrases-named")
        told = _told(named, words == 1)
        grams = _phrases(told, grams)
        levels.append((told, grams))
        if words == longest or named.isEmpty():
            break
        to = F.pmod(F.xxhash64("slice"), F.lit(buckets)).cast("int")
        none = F.lit(None).cast("binary")
        own = sequences.select(to.alias("to"), "slice", "at", (F.col("item") if words == 1 else none).alias("item"), (none if words == 1 else F.col("name")).alias("name"))
        answers = named.where("slice is not null").select(to.alias("to"), "slice", none.alias("at"), "item", "name")
        sequences = written(packed.dealt(own.unionByName(answers), buckets, "to").mapInArrow(_renamed(words > 1), _SEQUENCES_SCHEMA), "phrases-sequences")
    totals = slices.select(F.explode(F.arrays_zip("langs", "totals")).alias("z")).groupBy(F.col("z.langs").alias("lang")).agg(F.sum("z.totals").alias("n"))
    return _ranked(written(_scored(levels), "phrases-scored"), written(totals, "phrases-totals"), top)


def _phrases(told: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """name, lang, phrase, last word, f, and the counts of its beginnings and ends by length, up to itself."""
    if shorter is None:
        key = F.col("key").cast("string")
        word = F.substring_index(key, " ", -1)
        lang = F.substring(key, F.lit(1), F.length(key) - F.length(word) - 1)
        out = told.select("name", lang.alias("lang"), word.alias("phrase"), word.alias("last"), "f", F.array("f").alias("begins"), F.array("f").alias("ends"))
    else:
        one = shorter.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("first"), "begins")
        other = shorter.select(F.col("name").alias("right"), "last", "ends")
        out = told.join(one, "left").join(other, "right").select(
            "name", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "last", "f",
            F.array_append("begins", F.col("f")).alias("begins"), F.array_append("ends", F.col("f")).alias("ends"),
        )
    return written(out, "phrases-grams")


def _scored(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, phrase, a, begins, ends of the phrases that stay."""
    out = None
    for k in range(1, len(levels)):
        phrases = levels[k][1]
        if k + 1 < len(levels):
            longer = levels[k + 1][0]
            parents = longer.select(F.col("left").alias("name"), "f").unionByName(longer.select(F.col("right").alias("name"), "f"))
            most = parents.groupBy("name").agg(F.max("f").alias("most"))
            phrases = phrases.join(most, "name", "left").where("most is null or most < f")
        own = phrases.select("lang", "phrase", F.col("f").alias("a"), "begins", "ends")
        out = own if out is None else out.unionByName(own)
    if out is None:
        spark = levels[0][0].sparkSession
        return spark.createDataFrame([], "lang string, phrase string, a long, begins array<long>, ends array<long>")
    return out


def _ranked(phrases: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Products are taken in 38 digits. Ranks by parts of the candidates first, so that no task sorts a whole language."""
    exact = "cast(1000 as decimal(38, 0)) * a * n div (cast(begins[j - 1] as decimal(38, 0)) * ends[size(ends) - 1 - j])"
    cuts = f"transform(sequence(1, size(begins) - 1), j -> struct(cast({exact} as bigint) AS score, j AS j, begins[j - 1] AS l, ends[size(ends) - 1 - j] AS r))"
    scored = phrases.join(totals, "lang").withColumn("cut", F.array_min(F.expr(cuts)))
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = -(-phrases.count() // RANKED)
    if parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
