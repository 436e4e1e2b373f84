"""Bounded decode-and-rescan, level by level: find and decode, normalise, search, look into what came out.

Arrow functions find, decode, normalise (functions/copies.py) and search, all texts of a batch at once; they get the copies alone,
or null where nothing asks for a look. All else are column expressions over arrays of what was found, so rows stay where they are:
no shuffle, no join.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions import copies as cp
from ..functions import matches
from ..functions import regexlib as rx
from . import decode, rules

_FOUND = pa.list_(pa.struct([("decoded", pa.string()), ("blob", pa.string())]))
_FOUND_TYPE = ArrayType(StructType().add("decoded", StringType()).add("blob", StringType()))
#: Texts with fewer different characters have less entropy than the gates ask for.
LEAST_SYMBOLS = 28


def _candidates(text: str) -> list[dict]:
    return [{"decoded": d if d.isascii() else unicodedata.normalize("NFKC", _paired(d)), "blob": b} for d, b in decode.candidates(text)]


def _paired(decoded: str) -> str:
    """Escapes may stand for halves of a character: two make one, and one alone is replaced, as Arrow takes none."""
    return decoded.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _needed():
    """An automaton of the literals that rules need, made once per worker: each with the (rule, group) places it fills."""
    if not _made:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for r, rule in enumerate(rx.RULES):
            for g, group in enumerate(rule.needs):
                for literal in group:
                    places.setdefault(literal, []).append(2 * r + g)
        automaton = ahocorasick.Automaton()
        for literal, own in places.items():
            automaton.add_word(literal, sum(1 << k for k in own))
        automaton.make_automaton()
        _made.append((automaton, [sum(1 << (2 * r + g) for g in range(len(rule.needs))) for r, rule in enumerate(rx.RULES)]))
    return _made[0]


_made: list[tuple] = []


def may_match(matching: str) -> int:
    """A bit for each rule whose needs a text meets."""
    automaton, whole = _needed()
    held = 0
    for _, bits in automaton.iter(matching):
        held |= bits
    return sum(1 << r for r, bits in enumerate(whole) if held & bits == bits)


_SEARCHED = pa.struct([("n", pa.int32()), ("codes", pa.list_(pa.string()))])
_LOOKED_TYPE = StructType().add("found", _FOUND_TYPE).add("turned", rules.SEARCHED)


def _looked(copies: pa.Array, gate: np.ndarray) -> pa.StructArray:
    """What decode copies hold, and the markers in their ROT13: both null where neither ``gate`` nor the copy asks for a look."""
    found, turned = [], []
    for at, piece in matches.slices(copies):
        asked = gate[at : at + len(piece)].copy()
        rows = np.flatnonzero(asked)
        asked[rows] = decode.ask_for_a_look(piece.take(pa.array(rows)))
        held = piece.filter(pa.array(asked))
        own = np.full(len(piece), -1)
        own[asked] = np.arange(len(held))
        where = pa.array(own, mask=~asked)
        found.append(pa.array([_candidates(t) for t in held.to_pylist()], _FOUND).take(where))
        turned.append(rules.search(cp.lower(cp.rot13(held))).take(where))
    whole = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
    return pa.StructArray.from_arrays([whole(found, _FOUND), whole(turned, _SEARCHED)], ["found", "turned"])


@F.arrow_udf(StructType().add("entropy", DoubleType()).add("looked", _LOOKED_TYPE))
def look(matching: pa.Array, copy: pa.Array, gate: pa.Array) -> pa.Array:
    """Bits of entropy of the matching copy, and what the decode copy holds, null where
    neither ``gate`` nor its entropy asks."""
    entropy = [decode.bits(m) if m is not None and len(m) >= LEAST_SYMBOLS else None for m in matching.to_pylist()]
    asked = pc.fill_null(gate, False).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(~asked & pc.is_valid(gate).to_numpy(zero_copy_only=False)):
        c = copy[int(k)].as_py()
        asked[k] = c is not None and len(c) >= LEAST_SYMBOLS and decode.bits(c) > decode.GATE_BITS
    asked &= pc.is_valid(copy).to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(entropy, pa.float64()), _looked(copy, asked)], ["entropy", "looked"])


@F.arrow_udf(_LOOKED_TYPE)
def look_at(copy: pa.Array) -> pa.Array:
    """The same of a decode copy, whatever it looks like at first sight; null for a null."""
    some = pc.is_valid(copy)
    out = _looked(copy, some.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays(out.flatten(), out.type.names, mask=pc.invert(some))


@F.arrow_udf(StringType())
def collapsed_space(text: pa.Array) -> pa.Array:
    """text.collapse_space() by RE2."""
    return cp.collapse_space(text)


_AGAIN = pa.list_(pa.struct([("top", pa.int32()), ("decoded", pa.string())]))
_LEVEL_TYPE = StructType().add("hits", ArrayType(rules.SEARCHED)).add("found", ArrayType(StructType().add("top", IntegerType()).add("decoded", StringType())))


def _level(tops: pa.Array, texts: pa.Array, more: bool) -> pa.Array:
    """The markers in each of a row's texts and, for ``more``, what the texts hold, each with the number that its text has in ``tops``."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    numbers, hits, found = tops.flatten().to_pylist(), [], []
    for at, piece in matches.slices(texts.flatten()):
        matching, copies = cp.copies_of(piece)
        hits.append(rules.search(matching))
        if more:
            found += [[{"top": n, "decoded": c["decoded"]} for c in _candidates(t)] for n, t in zip(numbers[at:], copies.to_pylist(), strict=False)]
    none = texts.is_null()
    hits = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(hits) if hits else pa.array([], _SEARCHED), mask=none)
    rows = [[x for own in found[i:j] for x in own] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return pa.StructArray.from_arrays([hits, pa.array(rows, _AGAIN, mask=none.to_numpy(zero_copy_only=False))], ["hits", "found"])


@F.arrow_udf(_LEVEL_TYPE)
def look_again(tops: pa.Array, texts: pa.Array) -> pa.Array:
    return _level(tops, texts, True)


@F.arrow_udf(_LEVEL_TYPE)
def look_last(tops: pa.Array, texts: pa.Array) -> pa.Array:
    return _level(tops, texts, False)


def with_rescan(df: DataFrame, looked: str, depth: int, into: str) -> DataFrame:
    """Adds struct(n, codes, blobs): markers in what a look found, to ``depth`` levels, and in the copy's ROT13; their codes;
    and the blobs of the copy under which there are any. Null where nothing was looked for."""
    names = [f"_rescan_{k}" for k in range(depth)]
    found = F.col(f"{looked}.found")
    rows = F.transform(found, lambda x, i: F.struct(i.alias("top"), x["decoded"].alias("decoded")))
    for k, name in enumerate(names):
        df = df.withColumn(f"{name}_rows", rows)
        seen = look_again if k + 1 < depth else look_last
        df = df.withColumn(f"{name}_seen", seen(F.transform(f"{name}_rows", lambda x: x["top"]), F.transform(f"{name}_rows", lambda x: x["decoded"])))
        df = df.withColumn(name, F.zip_with(f"{name}_rows", f"{name}_seen.hits", lambda x, s: F.struct(x["top"].alias("top"), s.alias("s"))))
        rows = F.col(f"{name}_seen.found")
    df = df.withColumn("_rescan_all", F.concat(*[F.col(name) for name in names]))
    turned = F.col(f"{looked}.turned")
    n = F.aggregate("_rescan_all", turned["n"], lambda a, x: a + x["s"]["n"])
    codes = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("_rescan_all", lambda x: x["s"]["codes"])), turned["codes"])))
    hit = lambda i: F.exists("_rescan_all", lambda x: (x["top"] == i) & (x["s"]["n"] > 0))
    blobs = F.transform(F.filter(found, lambda x, i: (x["blob"] != "") & hit(i)), lambda x: x["blob"])
    out = F.when(found.isNotNull(), F.struct(n.cast("int").alias("n"), codes.alias("codes"), blobs.alias("blobs")))
    return df.withColumn(into, out).drop(*names, *[f"{x}{y}" for x in names for y in ("_rows", "_seen")], "_rescan_all")


def decode_rescan(df: DataFrame, copy: str, depth: int, into: str = "decoded") -> DataFrame:
    """with_rescan() of a column of decode copies, whatever they look like at first sight."""
    out = with_rescan(df.withColumn("_looked", look_at(F.col(copy))), "_looked", depth, into)
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("codes"), F.array().cast("array<string>").alias("blobs"))
    return out.withColumn(into, F.when(F.col("_looked").isNotNull(), F.coalesce(into, none))).drop("_looked")
