"""Outbound filter: disallowed links, secrets, personal data. Raw text, no normalisation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as tx
from ..functions.matches import PYTHON_BYTES, slices
from ..functions.regexlib import java
from ..functions.scoring import bound, reason

# Shapes of links, keys and personal data.
URL = r"""!\[[^\]\[]*\]\(\s*[^)\s(]+(?:\s+"[^"]*")?\)|(?:https?|ftp)://[^\s)<>"']+"""
SECRETS = {
    "openai": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b",
    "github": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "slack": r"\bxox[bpoa]-[A-Za-z0-9-]{10,}\b",
    "google": r"\bAIza[0-9A-Za-z_-]{35}\b",
}
#: Literals of which a key of each shape holds one.
KEY_SIGNS = {"openai": ("sk-",), "github": ("gh",), "aws": ("AKIA",), "jwt": ("eyJ",), "slack": ("xox",), "google": ("AIza",)}
# Fixed values, as above.
LONG_RUN = r"\b[A-Za-z0-9+/=_-]{40,}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d[\d\s().-]{6,}\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){13,16}\b"


#: Shorter patterns that a text with a match holds, found faster.
SIGNS = {LONG_RUN: "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{40}", EMAIL: "@[A-Za-z0-9.-]+[.]", SSN: r"[0-9]-[0-9]{2}-[0-9]", CARD: "[0-9](?:[ -]?[0-9]){12}"}


def all_matches(c: Column, pattern: str) -> Column:
    found = lambda x: F.regexp_extract_all(x, F.lit(java(pattern)), 0)
    if pattern not in SIGNS:
        return found(c)
    return bound(c, lambda x: F.when(x.rlike(SIGNS[pattern]), found(x)).otherwise(F.array().cast("array<string>")))


def _allowed(token: Column, allow: Sequence[str]) -> Column:
    """By prefix; entries written /.../ are regular expressions."""
    out = F.lit(False)
    for entry in allow:
        fits = token.rlike(java(entry[1:-1])) if len(entry) > 1 and entry[0] == entry[-1] == "/" else token.startswith(entry)
        out = out | fits
    return out


def link_of(match: Column) -> Column:
    """The address in a match of URL."""
    inner = F.regexp_extract(match, r"^!\[[^\]\[]*\]\(\s*([^)\s(]+)", 1)
    return F.when(match.startswith("!["), inner).otherwise(match)


def disallowed_links(c: Column, allow: Sequence[str] = ()) -> Column:
    """The matches (whole, in order) whose address isn't allowed."""
    return F.filter(all_matches(c, URL), lambda m: ~_allowed(link_of(m), allow))


def strip_disallowed(c: Column, allow: Sequence[str] = ()) -> Column:
    """The text without its disallowed matches: pieces between matches, and the matches that are allowed."""
    if not allow:
        return F.regexp_replace(c, F.lit(java(URL)), F.lit(""))
    pieces, found = F.split(c, java(URL), -1), all_matches(c, URL)
    kept = F.transform(found, lambda m: F.when(_allowed(link_of(m), allow), m).otherwise(""))
    joined = F.transform(F.arrays_zip(pieces.alias("p"), F.concat(kept, F.array(F.lit(""))).alias("m")), lambda x: F.concat(x["p"], x["m"]))
    return F.array_join(joined, "")


def secrets(c: Column, allow: Sequence[str] = ()) -> Column:
    """Distinct key-shaped tokens, by the order of the shapes."""
    none = F.array().cast("array<string>")
    tokens = lambda k, p: F.when(reduce(or_, [c.contains(x) for x in KEY_SIGNS[k]]), all_matches(c, p)).otherwise(none)
    found = F.array_distinct(F.flatten(F.array(*[tokens(k, p) for k, p in SECRETS.items()])))
    return F.filter(found, lambda t: ~_allowed(t, allow))


def high_entropy_runs(c: Column, allow: Sequence[str] = ()) -> Column:
    known = secrets(c, allow)
    runs = F.array_except(F.array_distinct(all_matches(c, LONG_RUN)), known)
    return F.filter(runs, lambda r: (tx.entropy(r) >= 4.5) & ~_allowed(r, allow))


def cards(c: Column) -> Column:
    """Card-shaped numbers that pass the Luhn test."""
    return F.filter(
        all_matches(c, CARD),
        lambda t: F.length(F.regexp_replace(t, r"\D", "")).between(13, 16) & F.call_function("luhn_check", F.regexp_replace(t, r"\D", "")),
    )


_CARD, _PHONE = re.compile(CARD, re.ASCII), re.compile(PHONE.replace(r"\s", "\\s\ufeff"))


def _phones(text: str | None) -> list[str]:
    if not text:
        return []
    found = [m for m in _PHONE.finditer(text) if 10 <= sum(ch in "0123456789" for ch in m[0]) <= 15]
    taken = [m.span() for m in _CARD.finditer(text)] if found else []
    return [m[0] for m in found if not any(m.start() < e and m.end() > b for b, e in taken)]


@F.arrow_udf(ArrayType(StringType()))
def phones(texts: pa.Array) -> pa.Array:
    """Phone numbers that don't overlap a card-shaped number; needs the places of all matches. Few texts are Python's at once."""
    found = [_phones(t) for _, piece in slices(texts, PYTHON_BYTES) for t in piece.to_pylist()]
    return pa.array(found, pa.list_(pa.string()))


def repeated(reason_column: Column, n: Column) -> Column:
    """n equal reasons."""
    return F.array_repeat(reason_column, n)


def egress_reasons(
    c: Column,
    allow: Sequence[str] = (),
    scan_secrets: bool = False,
    secret_allow: Sequence[str] = (),
    scan_pii: bool | Sequence[str] = False,
    phone_matches: Column | None = None,
) -> Column:
    parts = [repeated(reason("exfil_markdown_image", "exfil", F.lit(1.0), True), F.size(disallowed_links(c, allow)))]
    if scan_secrets:
        parts.append(repeated(reason("secret_egress", "exfil", F.lit(0.8)), F.size(secrets(c, secret_allow))))
        parts.append(repeated(reason("secret_egress", "exfil", F.lit(0.6)), F.size(high_entropy_runs(c, secret_allow))))
    if scan_pii is True:
        sizes = [(0.5, F.size(all_matches(c, EMAIL))), (0.7, F.size(all_matches(c, SSN))), (0.8, F.size(cards(c)))]
        sizes.append((0.4, F.size(phone_matches if phone_matches is not None else phones(c))))
        parts += [repeated(reason("pii_egress", "exfil", F.lit(w)), n) for w, n in sizes]
    elif scan_pii:
        parts += [repeated(reason("pii_egress", "exfil", F.lit(0.6)), F.size(all_matches(c, p))) for p in scan_pii]
    return F.concat(*parts)


def egress_verdict(reasons: Column) -> Column:
    return (
        F.when(F.size(reasons) == 0, "allow").when(F.exists(reasons, lambda r: r["hard"]), "block").otherwise("flag")
    )
