"""Patterns over Arrow arrays of texts, by RE2: one pass whatever the alternatives, where Java tries each of them at each place.

A match is looked for with what goes before it in sight, so that borders right behind another match are seen for what they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that one call takes, and that are Python's own strings at once.
SLICE_BYTES, PYTHON_BYTES = 16 << 20, 2 << 20


def re2(pattern: str) -> str:
    """The pattern as regexlib spells it, in RE2's dialect: white space with \\x0B, as Java has it, and no numbered groups."""
    out, inside = [], False
    for token in re.findall(r"\\.|\(\?|.", pattern, re.DOTALL):
        if token == r"\s":
            token = r"\s\x0B" if inside else r"[\s\x0B]"
        elif token == "(" and not inside:
            token = "(?:"
        elif token in ("[", "]"):
            inside = token == "[" or inside and out[-1] in ("[", "[^")
        elif token == "^" and inside and out[-1] == "[":
            out[-1], token = "[^", ""
        if token:
            out.append(token)
    return "".join(out)


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """The array in pieces of some SLICE_BYTES, or ``most``, each with its place."""
    most = most or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield at, texts.slice(at, upto - at)
        at = upto


def _held(texts: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    some = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    return np.flatnonzero(some.to_numpy(zero_copy_only=False)), texts.filter(some)


def _counted(held: pa.Array, pattern: str) -> np.ndarray:
    more = pc.replace_substring_regex(held, pattern, r"\0.")
    return pc.subtract(pc.binary_length(more), pc.binary_length(held)).to_numpy(zero_copy_only=False)


def counts(texts: pa.Array, pattern: str) -> np.ndarray:
    """Matches in each text, 0 in a null."""
    out, pattern = np.zeros(len(texts), np.int32), re2(pattern)
    for at, piece in slices(texts):
        rows, held = _held(piece, pattern)
        out[at + rows] = _counted(held, pattern)
    return out


def _starts(held: pa.Array, pattern: str) -> np.ndarray:
    """Where the first match starts, in UTF-16 units as Spark counts them."""
    spans = pc.extract_regex_span(held, f"(?P<at>{pattern})").field("at").flatten()
    out = spans.to_numpy(zero_copy_only=False)[::2].astype(np.int64)
    wide = pc.not_equal(pc.binary_length(held), pc.utf8_length(held)).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(wide):
        out[k] = len(held[int(k)].as_buffer().to_pybytes()[: out[k]].decode("utf-8", "replace").encode("utf-16-le")) // 2
    return out


def bank_hits(texts: pa.Array, patterns: list[str], combined: str, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the matches of ``combined``; of each of the patterns (columns); and, if asked for, where these start first."""
    whole = np.zeros(len(texts), np.int32)
    each, starts = np.zeros((len(texts), len(patterns)), np.int32), np.full((len(texts), len(patterns)), -1, np.int32)
    combined, patterns = re2(combined), [re2(p) for p in patterns]
    for at, piece in slices(texts):
        any_rows, any_held = _held(piece, combined)
        if not len(any_rows):
            continue
        whole[at + any_rows] = _counted(any_held, combined)
        for k, pattern in enumerate(patterns):
            rows, held = _held(any_held, pattern)
            if len(rows):
                each[at + any_rows[rows], k] = _counted(held, pattern)
                if places:
                    starts[at + any_rows[rows], k] = _starts(held, pattern)
    return whole, each, starts
