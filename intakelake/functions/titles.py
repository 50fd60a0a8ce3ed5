"""Job-title columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V
from .regex import java, matches, squeeze, sub


def role_key(title: Column) -> Column:
    """Case-, separator- and punctuation-free key of a title; ``+`` and ``#`` matter."""
    s = F.regexp_replace(F.lower(title), r"[._/\\|,]+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}+#\s-]", " ")
    return squeeze(F.regexp_replace(s, r"\s*-\s*", " "))


def role_tokens(title: Column) -> Column:
    stop = F.array(*map(F.lit, V.ROLE_STOP_TOKENS))
    return F.filter(F.split(role_key(title), " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def seniority_pattern(prefixes: list[str]) -> str:
    esc = "".maketrans({c: "\\" + c for c in ".*+?^${}()|[]\\"})
    longest = sorted(prefixes, key=len, reverse=True)
    return r"(?i)^(" + "|".join(p.translate(esc) for p in longest) + r")\b[\s.-]*"


def seniority_of(title: Column, prefixes: list[str]) -> Column:
    """The leading seniority word as the taxonomy spells it (final dot dropped), else null."""
    spelled = F.create_map(*[F.lit(x) for p in prefixes for x in (p.lower(), p.removesuffix("."))])
    found = F.lower(F.regexp_extract(F.trim(title), java(seniority_pattern(prefixes)), 1))
    return F.try_element_at(spelled, found)


def without_seniority(title: Column, prefixes: list[str]) -> Column:
    return F.trim(sub(F.trim(title), seniority_pattern(prefixes), ""))


def clean_title(raw: Column) -> Column:
    """The words of a captured phrase that form the role, or null when it is no title."""
    s = squeeze(F.regexp_replace(raw, r"[•·*|]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"^[-–—:\s]+", ""), r"[.,;:]+$", "")
    for p in (V.TITLE_QUALIFIER, V.TITLE_RELATIVE, V.TITLE_HEAD_NOUN, V.TITLE_ARTICLE):
        s = sub(s, p, "")
    return F.trim(s)


def is_title(s: Column) -> Column:
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(s, r"\s", ""))
    return F.length(s).between(3, 60) & (F.regexp_count(s, F.lit("[^ ]+")) <= 6) & ~s.rlike(r"(?i)@|https?:|\d{4,}") & (letters * 4 >= solid * 3)


def title_shaped(s: Column) -> Column:
    return matches(s, V.TITLE_NOUN)


def title_case(s: Column) -> Column:
    """Capitalise words; short all-capital words stay as written."""

    def word(w: Column) -> Column:
        keep = (F.length(w) <= 4) & w.rlike(r"^[A-Z./]+$")
        return F.when(keep, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))

    return F.array_join(F.transform(F.split(s, " "), word), " ")


def present_role(canonical: Column, seniority: Column) -> Column:
    """Canonical title with the stated seniority in front, never doubled."""
    n = F.length(seniority)
    doubled = (F.lower(F.substring(canonical, F.lit(1), n)) == F.lower(seniority)) & ~F.substring(canonical, n + 1, F.lit(1)).rlike(r"[A-Za-z0-9_]")
    return F.when(seniority.isNull() | doubled, canonical).otherwise(F.concat(title_case(seniority), F.lit(" "), canonical))
