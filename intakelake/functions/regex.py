"""Small column helpers over Spark's regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_BLANKS = r" \t\n\f\r"
_FOLDED = {"s": "ſ", "k": "\u212a"}


def java(pattern: str) -> str:
    """Pin word boundaries to ASCII, as older JVMs count accented letters as word characters, and white space to RE2's, which has no vertical tab.

    A boundary before a word character is a look-behind, one after a word character a look-ahead;
    only where a dot may stand before it is the full test needed.
    """
    pattern = re.sub(r"\\b(?=[A-Za-z0-9(]|\\d|\[\\p|\[Mm)", lambda _: f"(?<!{_WORD})", pattern)
    dotted = r"\.|" in pattern or r"\.)" in pattern
    return _pin_blanks(pattern.replace(r"\b", _BOUNDARY if dotted else f"(?!{_WORD})"))


def _pin_blanks(pattern: str) -> str:
    def pin(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\(.)", lambda e: _BLANKS if e[1] == "s" else e[0], m[0])
        return {r"\s": f"[{_BLANKS}]", r"\S": f"[^{_BLANKS}]"}.get(m[0], m[0])

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", pin, pattern)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(java(pattern))


def matches_folding(col: Column, pattern: str) -> Column:
    """As RE2 matches ``(?i)``: long s and the Kelvin sign stand for s and k too. Not for patterns with s or k in a class.

    Neither sign is a word character, so boundaries are tested in full; texts without them take the plain pattern.
    """
    folded = re.sub(r"\\.|[sk]", lambda m: f"[{m[0]}{_FOLDED[m[0]]}]" if m[0] in _FOLDED else m[0], pattern).replace(r"\b", _BOUNDARY)
    odd = F.contains(col, F.lit(_FOLDED["s"])) | F.contains(col, F.lit(_FOLDED["k"]))
    return F.when(odd, matches(col, folded)).otherwise(matches(col, pattern))


def group(col: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(col, java(pattern), n), F.lit(""))


def every(col: Column, pattern: str) -> Column:
    """All non-overlapping matches, in order."""
    return F.regexp_extract_all(col, F.lit(java(pattern)), F.lit(0))


def sub(col: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(col, java(pattern), to)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def any_match(col: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(col, p)
    return out
