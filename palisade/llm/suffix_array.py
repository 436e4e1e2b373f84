"""Suffix arrays by induced sorting, and common prefixes in text order, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost smaller ones
are sorted by their substrings, which are named and sorted recursively where names repeat; all
others are induced from them in two linear passes. Over a small alphabet each pass handles a
bucket as a few arrays; the reduced strings of the recursion, whose buckets are tiny, go entry
by entry.
"""

from __future__ import annotations

import numpy as np

#: A reduced string is sorted bucket by bucket if its buckets hold so many entries on average.
BUCKET_ENTRIES = 400


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their right neighbours, and where the leftmost smaller ones of
    each run start. The last symbol is the least and occurs once."""
    n = len(s)
    small = np.ones(n, bool)
    if n > 1:
        differ = s[1:] != s[:-1]
        rise = s[:-1] < s[1:]
        # an equal neighbour passes on what comes after it
        after = np.where(differ, np.arange(n - 1), n)
        after = np.minimum.accumulate(after[::-1])[::-1]
        small[:-1] = rise[np.minimum(after, n - 2)]
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, left


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order; s ends with 0, which occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small, left = classify(s)
    if not len(left):  # symbols never rise, so each suffix is larger than those after it
        return np.arange(n - 1, -1, -1)
    size = np.bincount(s, minlength=symbols)
    induce = _induced if n >= BUCKET_ENTRIES * symbols or symbols <= 300 else _induced_singly
    sa = induce(s, small, left, size)
    rank_of = np.full(n, -1)
    rank_of[left] = np.arange(len(left))
    order = rank_of[sa]
    order = order[order >= 0]
    names, many = _named(s, left, order)
    if many < len(left):
        order = suffix_array(names, many)
    return induce(s, small, left[order], size)


def _named(s: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name per leftmost smaller substring, in text order; equal substrings share one."""
    start = left[order]
    length = np.append(np.diff(left), 0)[order]  # up to the next one, which counts too
    same = np.append(False, length[1:] == length[:-1])
    pair = np.flatnonzero(same)
    a, b, rest = start[pair], start[pair - 1], length[pair]
    k = 0
    while len(pair):
        on = s[a + k] == s[b + k]
        same[pair[~on]] = False
        k += 1
        on &= rest >= k
        pair, a, b, rest = pair[on], a[on], b[on], rest[on]
    name = np.cumsum(~same) - 1
    names = np.empty(len(left), np.int64)
    names[order] = name
    return names, int(name[-1]) + 1


def _append(sa: np.ndarray, at: np.ndarray, step: int, symbol: np.ndarray, entries: np.ndarray) -> None:
    """Puts entries, in their order, at the open ends of their symbols' buckets."""
    order = np.argsort(symbol, kind="stable")
    sym = symbol[order]
    first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
    count = np.diff(np.append(first, len(sym)))
    place = at[sym] + step * (np.arange(len(sym)) - np.repeat(first, count))
    sa[place] = entries[order]
    at[sym[first]] += step * count


def _induced(s: np.ndarray, small: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost smaller ones in the given order, bucket by bucket."""
    n, end = len(s), np.cumsum(size)
    kind = np.uint16 if len(size) <= 1 << 16 else np.int64
    sym = s.astype(kind)
    head, used = end - size, np.flatnonzero(size)
    sa = np.full(n, -1)
    start = head.copy()
    by = np.argsort(sym[left], kind="stable")
    seeds = left[by]
    bound = np.searchsorted(sym[seeds], np.arange(len(size) + 1))
    for c in used:  # larger suffixes, from small symbols on
        done = start[c]
        while done < head[c]:
            got = sa[done : head[c]]
            done = head[c]
            p = got[got > 0] - 1
            p = p[~small[p]]
            if len(p):
                _append(sa, head, 1, sym[p], p)
        p = seeds[bound[c] : bound[c + 1]] - 1
        p = p[p >= 0]
        if len(p):
            _append(sa, head, 1, sym[p], p)
    tail = end - 1
    for c in used[::-1]:  # smaller ones, from large symbols on
        done = end[c] - 1
        while done > tail[c]:
            got = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            p = got[got > 0] - 1
            p = p[small[p]]
            if len(p):
                _append(sa, tail, -1, sym[p], p)
        got = sa[start[c] : head[c]][::-1]
        p = got[got > 0] - 1
        p = p[small[p]]
        if len(p):
            _append(sa, tail, -1, sym[p], p)
    sa[0] = n - 1
    return sa


def _induced_singly(s: np.ndarray, small: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same, entry by entry."""
    n = len(s)
    end = np.cumsum(size)
    sym, is_small, sa = s.tolist(), small.tolist(), [-1] * n
    tail = (end - 1).tolist()
    for i in reversed(left.tolist()):
        c = sym[i]
        sa[tail[c]] = i
        tail[c] -= 1
    head = (end - size).tolist()
    for j in range(n):
        i = sa[j] - 1
        if i >= 0 and not is_small[i]:
            c = sym[i]
            sa[head[c]] = i
            head[c] += 1
    tail = (end - 1).tolist()
    for j in range(n - 1, -1, -1):
        i = sa[j] - 1
        if i >= 0 and is_small[i]:
            c = sym[i]
            sa[tail[c]] = i
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, at: np.ndarray, most: int, every: int = 16) -> np.ndarray:
    """For the suffixes at the (ascending) positions ``at``: the length of the common prefix with the
    suffix before it in the array, up to ``most``.

    In text order that length falls by at most one a step, so each ``every``-th position bounds those
    after it and only what the bound leaves open is compared, 8 bytes at once."""
    if not len(at):
        return np.zeros(0, np.int64)
    before = np.full(len(sa), -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(most + every + 16, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,)))
    # the suffixes of one block are bounded by the block's first position in ``at``
    block = at // every
    lead = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    out = np.zeros(len(at), np.int64)
    out[lead] = _compared(eight, at[lead], before[at[lead]], np.zeros(len(lead), np.int64), most + every)
    owner = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(at))))
    bound = np.maximum(out[lead][owner] - (at - at[lead][owner]), 0)
    more = np.flatnonzero((bound < most) & (np.arange(len(at)) != lead[owner]))
    out = np.maximum(out, bound)
    out[more] = _compared(eight, at[more], before[at[more]], bound[more], most)
    return np.minimum(out, most)


def _compared(eight: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    out = known.copy()
    on = np.flatnonzero(b >= 0)
    limit = len(eight) - 1
    while len(on):
        x = eight[np.minimum(a[on] + out[on], limit)] ^ eight[np.minimum(b[on] + out[on], limit)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[on] += same
        on = on[(x == 0) & (out[on] < most)]
    return out
