"""A text's copies as in text.py, over Arrow arrays by RE2: a step that few texts need is done for those alone."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

from . import text as tx
from .regexlib import SPACE


def python(pattern: str) -> str:
    """A class of characters as text.py spells it, for Python."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


_OTHER = SPACE.replace(r"\n", "").replace(" ", "")
_SPACES = rf"[{_OTHER}][{_OTHER} ]*| [{_OTHER} ]+"
_NEAR = r"[\x{250}-\x{52f}]"
_NEAR_TOKEN = re.compile(python(f"[^{tx._TOKEN_SPACE}]*{_NEAR}[^{tx._TOKEN_SPACE}]*"))
_LATIN, _TABLE = re.compile("[A-Za-z]"), re.compile(f"[{tx.CONFUSABLE}]")
_NATIVE = re.compile(f"(?![{tx.CONFUSABLE}])[\u0370-\u04ff]")
_FOLD = str.maketrans(tx.CONFUSABLE, tx.FOLDED)
_WS = python(SPACE)
_SEPARATED = r"([A-Za-z]{2,})[.\-\x{2010}-\x{2015}\n]([a-z]{2,})"
_SEP, _LETTER = r"[ \t\n\r.\-]", "(?<![A-Za-z])[A-Za-z](?![A-Za-z])"
#: Three single letters, which is all that join_spaced_letters() changes.
_SPACED = f"(?:^|[^A-Za-z])[A-Za-z]{_SEP}[A-Za-z]{_SEP}[A-Za-z](?:[^A-Za-z]|$)"
_BETWEEN = re.compile(f"{_SEP}(?<={_LETTER}{_SEP})(?={_LETTER}{_SEP}{_LETTER})|{_SEP}(?<={_LETTER}{_SEP}{_LETTER}{_SEP})(?={_LETTER})")
_ROT13 = bytes.maketrans(*(x.encode() for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")))


def changed(texts: pa.Array, some: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The texts with change() of those that ``some`` tells."""
    some = pc.fill_null(some, False)
    held = texts.filter(some)
    return pc.replace_with_mask(texts, some, change(held).cast(texts.type)) if len(held) else texts


def _by_python(texts: pa.Array, pattern: str, one: Callable[[str], str]) -> pa.Array:
    return changed(texts, pc.match_substring_regex(texts, pattern), lambda held: pa.array([one(t) for t in held.to_pylist()], pa.string()))


def collapse_space(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, "\r\n?", "\n"), _SPACES, " ")


def strip_invisible(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, tx.INVISIBLE, "")


def _folded(token: re.Match) -> str:
    t = token[0]
    latin = len(_LATIN.findall(t))
    return t.translate(_FOLD) if latin and latin >= len(_NATIVE.findall(t)) else t


def fold_confusables(texts: pa.Array) -> pa.Array:
    return _by_python(texts, _NEAR, lambda t: _NEAR_TOKEN.sub(_folded, t))


def _morse(text: str) -> str:
    trimmed = re.sub(f"^[{_WS}]+|[{_WS}]+\\Z", "", text)
    if len(trimmed) < 4 or not re.fullmatch(rf"[.\-{_WS}/]+", trimmed):
        return text
    words = [[tx.MORSE.get(x) for x in re.split(f"[{_WS}]+", w) if x] for w in re.split(f"[{_WS}]{{2,}}|/", trimmed)]
    words = [w for w in words if w]
    return text if not words or any(x is None for w in words for x in w) else " ".join("".join(w) for w in words)


def morse(texts: pa.Array) -> pa.Array:
    """Texts that are Morse code, decoded; all others as they are."""
    return _by_python(texts, rf"\A[{SPACE}]*[.\-/][.\-{SPACE}/]*\z", _morse)


def join_split_words(texts: pa.Array) -> pa.Array:
    for _ in range(3):
        texts = changed(texts, pc.match_substring_regex(texts, _SEPARATED), lambda held: pc.replace_substring_regex(held, _SEPARATED, r"\1\2"))
    return texts


def join_spaced_letters(texts: pa.Array) -> pa.Array:
    return _by_python(texts, _SPACED, lambda t: _BETWEEN.sub("", t))


def lower(texts: pa.Array) -> pa.Array:
    wide = pc.invert(pc.string_is_ascii(texts))
    return changed(pc.ascii_lower(texts), wide, lambda _: pa.array([t.lower() for t in texts.filter(pc.fill_null(wide, False)).to_pylist()], pa.string()))


def rot13(texts: pa.Array) -> pa.Array:
    """All bytes at once, as those of other characters than ASCII are no letters."""
    valid, ends, data = texts.buffers()
    turned = pa.py_buffer(data.to_pybytes().translate(_ROT13)) if data is not None else None
    return pa.Array.from_buffers(texts.type, len(texts), [valid, ends, turned], offset=texts.offset)


def copies_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Matching and decode copies of texts that are normalised by NFKC, as with_copies() makes them."""
    texts = morse(fold_confusables(strip_invisible(texts)))
    return lower(collapse_space(join_spaced_letters(join_split_words(texts)))), collapse_space(texts)
