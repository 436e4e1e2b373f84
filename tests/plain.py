"""Plain versions of the text-risk half, a text at a time."""

import re
import unicodedata

from palisade.functions import regexlib as rx
from palisade.functions import text as tx
from palisade.operators.decode import _WS, asks_for_a_look, candidates


def _compiled(pattern: str) -> re.Pattern:
    """A pattern of the shared bank for Python: ASCII borders, white space as in regexlib."""
    for inside in ("[^", "[^)"):
        pattern = pattern.replace(inside + r"\s", inside + _WS)
    return re.compile(pattern.replace(r"\s", f"[{_WS}]"), re.ASCII)


MARKERS = _compiled("|".join(f"(?P<{r.name}>{r.pattern})" for r in rx.RULES))
CODES = {r.name: r.code for r in rx.RULES}

_STRIP = {k: re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)) for k, p in tx.CLASSES.items()}
_FOLD = str.maketrans(tx.CONFUSABLE, tx.FOLDED)
_NATIVE = re.compile(f"(?![{tx.CONFUSABLE}])[\u0370-\u04ff]")


def _fold(token: re.Match) -> str:
    t = token[0]
    latin = len(re.findall("[A-Za-z]", t))
    return t.translate(_FOLD) if latin >= 1 and latin >= len(_NATIVE.findall(t)) else t


def _morse(s: str) -> str | None:
    t = s.strip()
    if len(t) < 4 or not re.fullmatch(r"[.\-\s/]+", t):
        return None
    words = [w for w in re.split(r"\s{2,}|/", t) if w.strip()]
    letters = [[tx.MORSE.get(x) for x in w.split()] for w in words]
    if not words or any(x is None for w in letters for x in w):
        return None
    return " ".join("".join(w) for w in letters)


def normalised(s: str) -> tuple[str, str]:
    """(matching copy, decode copy)"""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    for p in _STRIP.values():
        s = p.sub("", s)
    if not s.isascii():
        s = re.sub(r"[^ \t\n\r\f\x0b\xa0\u2000-\u200a\u202f\u205f\u3000]+", _fold, s)
    s = _morse(s) or s
    spaces = lambda t: re.sub(f"[{_WS.replace(chr(10), '')}]+", " ", re.sub(r"\r\n?", "\n", t))
    joined = s
    for _ in range(3):
        joined = re.sub(r"([A-Za-z]{2,})[.\-\u2010-\u2015\n]([a-z]{2,})", r"\1\2", joined)
    single = "(?<![A-Za-z])[A-Za-z]"
    joined = re.sub(
        rf"{single}(?:[ \t\n\r.\-][A-Za-z](?![A-Za-z])){{2,}}",
        lambda m: m[0] if re.match("[A-Za-z]{2}", m[0]) else re.sub(r"[ \t\n\r.\-]", "", m[0]),
        joined,
    )
    return spaces(joined).lower(), spaces(s)


def markers(matching: str) -> tuple[int, set[str]]:
    n, codes = 0, set()
    for m in MARKERS.finditer(matching):
        n += 1
        codes.add(CODES[m.lastgroup if m.lastgroup in CODES else next(k for k in CODES if m[k] is not None)])
        if n > 50:
            break
    return n, codes


def rescan(text: str, depth: int) -> tuple[int, set[str]]:
    matching, again = normalised(text)
    n, codes = markers(matching)
    if depth > 1:
        for decoded, _ in candidates(again):
            k, more = rescan(decoded, depth - 1)
            n, codes = n + k, codes | more
    return n, codes



_TURN = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM")


def looked_into(text: str, depth: int) -> tuple[int, list[str], list[str]]:
    """(n, codes, blobs): markers in a decode copy's decoded candidates and in ROT13, and the blobs that hold some."""
    if not asks_for_a_look(text):
        return 0, [], []
    n, codes, blobs = 0, set(), []
    for decoded, blob in candidates(text):
        k, more = rescan(decoded, depth)
        n, codes = n + k, codes | more
        if k and blob:
            blobs.append(blob)
    k, more = markers(text.translate(_TURN).lower())
    return n + k, sorted(codes | more), blobs
