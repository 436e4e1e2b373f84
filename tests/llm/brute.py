"""Plain versions of the contracts, for small inputs: rows are (doc_id, text)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    groups = defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    return {d: (min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}


def bytes_removed(rows, length=100):
    texts, first = {d: (t or "").encode() for d, t in rows}, {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - length + 1):
            first.setdefault(texts[d][i : i + length], (d, i))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def words_removed(rows, window=13):
    words, first = {d: WORD.findall(t or "") for d, t in rows}, {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def similar(rows, n=5):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    where, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for k in s:
            where[k].append(d)
    for d, s in sets.items():
        for e, o in Counter(e for k in s for e in where[k] if e < d).items():
            if 100 * o >= 80 * (len(s) + len(sets[e]) - o):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edit_distance_within(item, text):
    """Least edit distance of item to a substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    return rest[:cut].translate(LOW), re.split("[?#]", rest[cut:], maxsplit=1)[0]


def bytes_removed_by_row(rows, length=100):
    """(n_bytes, n_removed) of each row, where ids may repeat: a place is earlier in a smaller id or in the same row."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for k, (d, _) in enumerate(rows):
        b, gone, seen = texts[k], bytearray(len(texts[k])), set()
        before = {u[i : i + length] for (e, _), u in zip(rows, texts, strict=True) if None not in (d, e) and e < d for i in range(len(u) - length + 1)}
        for i in range(len(b) - length + 1 if d is not None else 0):
            piece = b[i : i + length]
            if piece in before or piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        out.append((len(b), sum(gone)))
    return out


def words_removed_by_row(rows, window=13):
    """(n_words, n_removed) of each row, where ids may repeat."""
    words, out = [WORD.findall(t or "") for _, t in rows], []
    for k, (d, _) in enumerate(rows):
        gone = [False] * len(words[k])
        before = {tuple(w[i : i + window]) for (e, _), w in zip(rows, words, strict=True) if None not in (d, e) and e < d for i in range(len(w) - window + 1)}
        for i in range(len(gone) - window + 1):
            if tuple(words[k][i : i + window]) in before:
                gone[i : i + window] = [True] * window
        out.append((len(gone), sum(gone)))
    return out


def phrases(rows, least, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(
                len(q) > len(p) and b >= least and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()
            )
            if not inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def mined(rows, every=50):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, vector, label)."""
    fine = [
        (i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, c in fine:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), j, d) for j, u, d in fine if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:5]:
            hard = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(hard, 1)]
    return sorted(out)
