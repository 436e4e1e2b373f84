"""A trie of globally ordered sets that are probed for similar ones.

Tokens that stand in the same members share one weighted node symbol; symbols are ordered by how many
members hold them, so that paths share their beginnings. A probe goes down level by level, carrying
overlaps along shared paths, and leaves a subtree whose lengths can't reach the overlap it needs.
"""

from __future__ import annotations

import numpy as np


#: Tokens that are looked at together.
RUN = 1 << 20
#: Probes that go down a tree together at most, and numbers that these may hold for its symbols.
MOST_PROBES, PROBED = 32, 1 << 20


def runs_of(owner: np.ndarray, members: int, run: int) -> list[tuple[int, int]]:
    """(start, end) of runs of whole sets with about so many tokens; a larger set has a run of its own."""
    ends, runs, s = np.searchsorted(owner, np.arange(members), side="right"), [], 0
    while s < len(owner):
        at = max(int(np.searchsorted(ends, s + run, side="right")) - 1, int(owner[s]))
        runs.append((s, int(ends[at])))
        s = int(ends[at])
    return runs


class PrefixTree:
    """tokens: those of each set (distinct numbers), by owner; sizes: the sets' full sizes, which may count
    tokens that no other set has. Tokens are taken a run of sets at a time, so that a tree needs little
    more memory than they do."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int):
        m, self.sizes, self.percent = len(sizes), sizes, percent
        runs = runs_of(owner, m, RUN)
        own = np.zeros(0, tokens.dtype)
        for s, e in runs:
            own = np.union1d(own, tokens[s:e])
        token = np.empty(len(tokens), np.int32)
        r = np.random.default_rng(5).integers(0, 1 << 63, m, dtype=np.uint64)
        mark, held = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
        for s, e in runs:
            token[s:e] = np.searchsorted(own, tokens[s:e])
            np.add.at(mark, token[s:e], r[owner[s:e]])
            np.add.at(held, token[s:e], 1)
        # symbols: tokens with the same holders, the most held first
        sort = np.lexsort((mark, -held))
        new = np.append(True, mark[sort][1:] != mark[sort][:-1]) if len(own) else np.zeros(0, bool)
        symbol_of = np.empty(len(own), np.int64)
        symbol_of[sort] = np.cumsum(new) - 1
        many = int(new.sum())
        self.weight = np.bincount(symbol_of, minlength=many).astype(np.int64)
        pairs = [np.unique(owner[s:e].astype(np.int64) * max(many, 1) + symbol_of[token[s:e]]) for s, e in runs]
        pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        del pairs, token
        self.begin = np.searchsorted(pair, np.arange(m + 1) * max(many, 1))
        self.symbol = (pair % max(many, 1)).astype(np.int32)
        del pair
        self._build(m, many)

    def _build(self, m: int, many: int) -> None:
        """Levels of nodes: symbol, parent, weights and sizes below, and the members that end there."""
        length = np.diff(self.begin)
        total = np.array([self.weight[self.symbol[s:e]].sum() for s, e in zip(self.begin, self.begin[1:], strict=False)], np.int64)
        self.levels = []
        node, alive, used = np.zeros(m, np.int64), np.flatnonzero(length > 0), np.zeros(m, np.int64)
        self.empty = np.flatnonzero(length == 0)
        depth = 0
        while len(alive):
            symbol = self.symbol[self.begin[alive] + depth]
            key, number = np.unique(node[alive] * many + symbol, return_inverse=True)
            used[alive] += self.weight[symbol]
            rest = np.zeros(len(key), np.int64)
            np.maximum.at(rest, number, total[alive] - used[alive])
            least = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(least, number, self.sizes[alive])
            node[alive] = number
            ends = alive[length[alive] == depth + 1]
            by = np.argsort(node[ends], kind="stable")
            self.levels.append((*(x.astype(np.int32) for x in (key % many, key // many, rest, least)), ends[by], node[ends][by]))
            alive = alive[length[alive] > depth + 1]
            depth += 1

    def similar(self, x: int) -> np.ndarray:
        """Members (x too) whose Jaccard similarity with x reaches the percentage."""
        return self.similar_to(np.array([x]))[0]

    def at_once(self) -> int:
        """Probes that go down together: what a level costs besides its nodes is shared."""
        return min(max(PROBED // (len(self.weight) + 1), 1), MOST_PROBES)

    def similar_to(self, probes: np.ndarray) -> list[np.ndarray]:
        """The same for each of several members."""
        p, size = self.percent, self.sizes[probes].astype(np.int64)
        has = np.zeros((len(self.weight), len(probes)), np.int64)
        for k, x in enumerate(probes):
            own = self.symbol[self.begin[x] : self.begin[x + 1]]
            has[own, k] = self.weight[own]
        beyond = np.zeros((len(has) + 1, len(probes)), np.int64)  # weight of a probe from a symbol on
        beyond[:-1] = np.cumsum(has[::-1], axis=0)[::-1]
        number, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        overlap_above = np.zeros((1, len(probes)), np.int64)
        on_above = np.ones((1, len(probes)), bool)
        for symbol, parent, rest, least, ends, at in self.levels:
            on = on_above[parent]
            if not on.any():
                break
            overlap = overlap_above[parent] + has[symbol]
            reach = overlap + np.minimum(rest[:, None], beyond[symbol + 1])
            # 100 o >= p (size + n - o) for some n of at least ``least``
            on &= (100 + p) * reach >= p * (size + least[:, None])
            if len(ends):
                o = overlap[at]
                end, probe = np.nonzero(on[at] & (100 * o >= p * (size + self.sizes[ends][:, None] - o)))
                number.append(probe)
                found.append(ends[end])
            overlap_above, on_above = overlap, on
        one, other = np.concatenate(number), np.concatenate(found)
        return np.split(other[np.argsort(one, kind="stable")], np.cumsum(np.bincount(one, minlength=len(probes)))[:-1])


class SetRows:
    """The same sets one after another, of which a probe reads those it is to be compared with."""

    #: Sets that a probe is compared with at first, and how many times more each time after.
    FEW, MORE = 16, 4

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int):
        self.tokens, self.sizes, self.percent = tokens, sizes, percent
        self.begin = np.searchsorted(owner, np.arange(len(sizes) + 1))
        self.has = np.zeros(int(tokens.max(initial=-1)) + 1, bool)

    def among(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of some members with tokens whose Jaccard similarity with x reaches the percentage."""
        own = self.tokens[self.begin[x] : self.begin[x + 1]]
        self.has[own] = True
        rows = [self.tokens[self.begin[y] : self.begin[y + 1]] for y in others]
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
        overlap = np.add.reduceat(self.has[np.concatenate(rows)], starts, dtype=np.int64)
        self.has[own] = False
        return others[100 * overlap >= self.percent * (self.sizes[x] + self.sizes[others] - overlap)]


def shared(tokens: np.ndarray, owner: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that more than one member holds, as numbers, and their owners; a run of sets at a time."""
    runs, own = runs_of(owner, members, RUN), np.zeros(0, tokens.dtype)
    if len(runs) == 1:
        order = np.argsort(tokens, kind="stable")
        group = np.cumsum(np.append(True, tokens[order][1:] != tokens[order][:-1])) - 1
        number = np.empty(len(tokens), np.int32)
        number[order] = group
        more = np.bincount(group)[number] > 1
        return number[more], owner[more]
    for s, e in runs:
        own = np.union1d(own, tokens[s:e])
    number, held = np.empty(len(tokens), np.int32), np.zeros(len(own), np.int32)
    for s, e in runs:
        number[s:e] = np.searchsorted(own, tokens[s:e])
        np.add.at(held, number[s:e], 1)
    more = held[number] > 1
    return number[more], owner[more]


def spanning_links(
    tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int, labels: np.ndarray, sets: type[PrefixTree] | type[SetRows] = PrefixTree
) -> list[tuple[int, int]]:
    """Links (between members' numbers) that connect just what all similar pairs connect, where members of one
    label are connected already. Each link between labels has an end outside the most frequent label, so
    only members there are probed, until all is connected, and only for members that they aren't connected with and may
    link with: what two sets have in common is at most what each has in common with all the others."""
    tokens, owner = shared(tokens, owner, len(sizes))
    reach = np.bincount(owner, minlength=len(sizes))
    fits = lambda x, y: (100 + percent) * np.minimum(reach[x], reach[y]) >= percent * (sizes[x] + sizes[y])
    _, root, many = np.unique(labels, return_inverse=True, return_counts=True)
    links, parts, every = [], len(many), np.argsort(reach - sizes, kind="stable")[::-1]
    to_do, made = np.flatnonzero(root != many.argmax()).tolist()[::-1], None

    def left(x: int, others: np.ndarray) -> np.ndarray:
        return others[fits(x, others) & (root[others] != root[x])]

    def joined(x: int, found: np.ndarray) -> int:
        before = len(links)
        for y in found:
            if root[y] != root[x]:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root[root == old] = new
                links.append((int(x), int(y)))
        return len(links) - before

    while to_do and parts > 1:
        x = to_do.pop()
        if not len(others := left(x, every)):
            continue
        made = made or sets(tokens, owner, sizes, percent)
        if isinstance(made, PrefixTree):
            probes = [x]
            while to_do and len(probes) < made.at_once():
                if len(left(y := to_do.pop(), every)):
                    probes.append(y)
            for y, found in zip(probes, made.similar_to(np.array(probes)), strict=True):
                parts -= joined(y, found)
            continue
        few = made.FEW
        while len(others):
            parts -= joined(x, made.among(x, others[:few]))
            others, few = left(x, others[few:]), few * made.MORE
    return links
