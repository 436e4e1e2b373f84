"""Text normalisation as column expressions: invisible characters, confusables, splits, Morse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .regexlib import SPACE
from .scoring import bound

#: Character classes that are counted and stripped, in order of precedence.
CLASSES = {
    "tag": r"[\x{E0000}-\x{E007F}]",
    "zero_width": r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{2060}\x{ad}]",
    "variation": r"[\x{fe00}-\x{fe0f}\x{E0100}-\x{E01EF}]",
    "control": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]",
    "bidi_embed": r"[\x{202a}-\x{202c}]",
    "bidi_override": r"[\x{202d}\x{202e}]",
    "bidi_isolate": r"[\x{2066}-\x{2069}]",
}
#: Look-alikes of ASCII letters that compatibility normalisation keeps, and what they fold to.
CONFUSABLE = "аеіиопрсухгјѕһАВГЕІЈКМНОПРСЅТХӀαεηιμνορτΑΒΕΙΜΝΟΡΤɩ"
FOLDED = "aeiuonpcyxrjshABREIJKMHONPCSTXIaeniuvoptABEIMNOPTi"
#: The extended table adds these.
CONFUSABLE_MORE = "ԁӏɡʋ‘’“”∕∖∣│∼ˈʹˮ"
FOLDED_MORE = "dlgv''\"\"/\\||~''\""
#: International Morse code.
MORSE = {
    ".-": "a", "-...": "b", "-.-.": "c", "-..": "d", ".": "e", "..-.": "f", "--.": "g", "....": "h",
    "..": "i", ".---": "j", "-.-": "k", ".-..": "l", "--": "m", "-.": "n", "---": "o", ".--.": "p",
    "--.-": "q", ".-.": "r", "...": "s", "-": "t", "..-": "u", "...-": "v", ".--": "w", "-..-": "x",
    "-.--": "y", "--..": "z", "-----": "0", ".----": "1", "..---": "2", "...--": "3", "....-": "4",
    ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9",
}
_TOKEN_SPACE = r" \t\n\r\f\x0b\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"


def replace_all(c: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


#: All of these in one class; most texts hold none.
INVISIBLE = "[" + "".join(p[1:-1] for p in CLASSES.values()) + "]"


#: Those of the classes that are ASCII.
ASCII_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: What any text that is Morse code begins with.
MAY_BE_MORSE = rf"\A[{SPACE}]*[.\-/]"


def is_ascii(c: Column) -> Column:
    """Every character takes one byte."""
    return F.octet_length(c) == F.length(c)


def invisible_counts(c: Column | str) -> dict[str, Column]:
    """The counts of a text that holds none are known from one pass."""
    c = F.col(c) if isinstance(c, str) else c
    some = c.rlike(INVISIBLE)
    return {k: F.when(some, F.regexp_count(c, F.lit(p))).otherwise(0) for k, p in CLASSES.items()}


def strip_invisible(c: Column | str, bidi: str = "strip") -> Column:
    """bidi: strip all controls, isolate (keep isolates) or off (keep all)."""
    kept = [k for k in CLASSES if k == "bidi_isolate" and bidi != "strip" or k.startswith("bidi") and bidi == "off"]
    return replace_all(F.col(c) if isinstance(c, str) else c, "[" + "".join(p[1:-1] for k, p in CLASSES.items() if k not in kept) + "]", "")


def locale_base(locale: Column) -> Column:
    return F.lower(F.regexp_extract(locale, r"^([^-_]*)", 1))


def fold_confusables(c: Column, full: bool = False) -> Column:
    """struct(text, n): letters that look like ASCII ones are folded in tokens that are mainly Latin."""
    table, to = (CONFUSABLE + CONFUSABLE_MORE, FOLDED + FOLDED_MORE) if full else (CONFUSABLE, FOLDED)
    # a wide range of two ends is searched far faster than the table itself
    near = r"[\x{250}-\x{52f}\x{2018}-\x{2502}]" if full else r"[\x{250}-\x{52f}]"
    lost = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    native_table = "".join(x for x in table if 0x370 <= ord(x) <= 0x4FF)
    tokens = F.regexp_extract_all(c, F.lit(f"[{_TOKEN_SPACE}]+|[^{_TOKEN_SPACE}]+"), 0)

    def judged(token: Column) -> Column:
        latin = F.regexp_count(token, F.lit("[A-Za-z]"))
        native = F.regexp_count(token, F.lit(r"[\x{370}-\x{4ff}]")) - lost(token, native_table)
        n = lost(token, table)
        on = token.rlike(near) & (latin >= 1) & (n > 0) & (latin >= native)
        return F.when(on, F.struct(F.translate(token, table, to).alias("t"), n.alias("n"))).otherwise(F.struct(token.alias("t"), F.lit(0).alias("n")))

    def joined(parts: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"),
            F.aggregate(parts, F.lit(0), lambda a, p: a + p["n"]).alias("n"),
        )

    folded = bound(F.transform(tokens, judged), joined)
    return F.when(c.rlike(near), folded).otherwise(F.struct(c.alias("text"), F.lit(0).alias("n")))


def morse(c: Column) -> Column:
    """The decoded text if all of it is Morse code, else null."""
    trimmed = replace_all(c, f"^[{SPACE}]+|[{SPACE}]+$", "")
    words = F.filter(
        F.split(trimmed, f"[{SPACE}]{{2,}}|/"), lambda w: replace_all(w, f"[{SPACE}]+", "") != ""
    )
    table = F.create_map(*[F.lit(x) for pair in MORSE.items() for x in pair])
    decoded = F.transform(
        words,
        lambda w: F.transform(
            F.filter(F.split(w, f"[{SPACE}]+"), lambda s: s != ""), lambda s: F.try_element_at(table, s)
        ),
    )
    fits = (F.length(trimmed) >= 4) & trimmed.rlike(f"^[.\\-{SPACE}/]+$")
    valid = (F.size(words) > 0) & ~F.exists(decoded, lambda w: F.exists(w, lambda x: x.isNull()))
    return F.when(fits, F.when(valid, F.array_join(F.transform(decoded, lambda w: F.array_join(w, "")), " ")))


def collapse_space(c: Column) -> Column:
    """Line ends become LF; other white space runs become one space."""
    other = SPACE.replace(r"\n", "").replace(" ", "")
    # all runs but single spaces, which stay as they are
    return replace_all(replace_all(c, r"\r\n?", "\n"), f"[{other}][{other} ]*| [{other} ]+", " ")


def join_split_words(c: Column) -> Column:
    """'pre.vious' -> 'previous': one separator between letters, before a lower-case part."""
    separator = r"[.\-\x{2010}-\x{2015}\n]"
    pattern, sign = rf"([A-Za-z]{{2,}}){separator}([a-z]{{2,}})", rf"{separator}(?<=[A-Za-z]{{2}}{separator})[a-z]{{2}}"
    for _ in range(3):  # the sign of a match is found faster, as it begins with a separator
        c = bound(c, lambda x: F.when(x.rlike(sign), replace_all(x, pattern, "$1$2")).otherwise(x))
    return c


def join_spaced_letters(c: Column) -> Column:
    """'i g n o r e' -> 'ignore': separators in runs of three or more isolated letters go."""
    sep, letter = r"[ \t\n\r.\-]", "(?<![A-Za-z])[A-Za-z](?![A-Za-z])"
    # separators first: few characters are one
    between = f"{sep}(?<={letter}{sep})(?={letter}{sep}{letter})|{sep}(?<={letter}{sep}{letter}{sep})(?={letter})"
    return replace_all(c, between, "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation; apply only to rows with other than ASCII (gated_apply)."""
    return s.str.normalize("NFKC")


def rot13(c: Column) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    turned = low[13:] + low[:13]
    return F.translate(c, low + low.upper(), turned + turned.upper())


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most)
    # a character that the cut halves becomes replacement characters at the end
    whole = replace_all(F.make_valid_utf8(cut.cast("string")), r"\x{fffd}+$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(whole)


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character among those over 200."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)(.)\1{200,}"), 0)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters' low bytes (characters beyond the BMP count once)."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).bitwiseAND(255))
    counts = F.transform(
        F.array_distinct(codes), lambda k: F.size(F.filter(codes, lambda x: x == k)).cast("double")
    )
    n = F.size(codes)
    return F.when(F.length(c) == 0, 0.0).otherwise(
        F.aggregate(counts, F.lit(0.0), lambda h, k: h - (k / n) * F.log2(k / n))
    )
