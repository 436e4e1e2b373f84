"""Vectorised helpers over the bytes of many texts, used inside Arrow tasks.

Hashes are polynomials modulo 2**64 over mixed values, taken from prefix sums, so that the hash
of any span costs a subtraction and a multiplication.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
#: Longest word that is hashed in lanes; masks of a lane's first bytes.
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        made = np.full(max(n, 1 << 16), base, U64)
        made[0] = 1
        got = _powers[base] = np.multiply.accumulate(made)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer
    text has a run of its own. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    ends = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, raw[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << np.uint8(5))


def not_space(b: np.ndarray) -> np.ndarray:
    return (b != 32) & ((b < 9) | (b > 13))


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of ``mask``; runs end at text borders."""
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # the border before a position
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    start = np.flatnonzero(mask & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    n = len(b)
    base = powers(_BASE, n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * base[:n], out=total[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)
    h = (total[end] - total[start]) * inverse[start]
    h ^= (end - start).astype(U64) * U64(0xA24BAED4963EE407)
    return mix(h)


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, by eight bytes at a time and without the structure of span_hashes, in which some
    long words of few letters collide; words beyond LONG bytes by blake2b. Other seeds give other hashes."""
    lanes = np.ndarray(len(b) + 1, "<u8", np.append(b, np.zeros(8, np.uint8)), strides=(1,))
    size = (end - start).astype(U64)
    h = mix(size * U64(_BASE) ^ U64(seed))
    own = np.flatnonzero(size <= U64(LONG))
    for at in range(0, LONG, 8):
        own = own[size[own] > U64(at)]
        if not len(own):
            break
        lane, left = lanes[start[own] + at], np.minimum(size[own] - U64(at), U64(8))
        h[own] = mix((h[own] ^ (lane & _LOW[left])) + U64(_WORD_BASE))
    for k in np.flatnonzero(size > U64(LONG)):
        digest = hashlib.blake2b(b[start[k] : end[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        h[k] = U64(int.from_bytes(digest.digest(), "little"))
    return h


def window_hashes(word_hash: np.ndarray, width: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes, whatever text they are in."""
    m = len(word_hash) - width + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(word_hash) + 1, U64)
    np.cumsum(word_hash * powers(base, len(word_hash)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), m)
    return mix((total[width:] - total[:-width]) * inverse)
