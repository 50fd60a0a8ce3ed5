"""Person-name and file-name columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from .regex import matches, sub
from .stage import once


#: A name holds letters, joiners and quotes only.
NAME_CHARS = r"^[\p{L}'’.,|•·–—\s-]++$"
#: The same with something between two words in it.
NAME_SHAPE = r"^(?=[^\s,|•·–—]*+[\s,|•·–—])" + NAME_CHARS[1:]
_TOKEN = V.NAME_TOKEN.replace("^", "").replace("$", "")
#: Every word of a text of single blanks is a name's word; and every word is cased as it stays.
NAME_WORDS = f"^(?:{_TOKEN})(?: (?:{_TOKEN}))*$"
CASED_WORDS = r"^\p{Lu}\p{Ll}[^ ]*+(?: \p{Lu}\p{Ll}[^ ]*+)*$"


# What every e-mail, digit run, URL or double blank holds: a line without it has nothing to strip.
CONTACT_MARK = r"@|[0-9][0-9\s().-]{7}|[hH][tT][tT][pP]|[wW][wW][wW]\.|\s\s"


def strip_contact(line: Column) -> Column:
    """Drop e-mails, digit runs and URLs from a contact line."""
    s = sub(line, V.EMAIL, " ")
    s = sub(s, V.CONTACT_DIGITS, " ")
    s = sub(s, V.CONTACT_URL, " ")
    return F.trim(F.when(line.rlike(CONTACT_MARK), F.regexp_replace(s, r"\s{2,}", " ")).otherwise(line))


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def title_case_name(word: Column) -> Column:
    """Keep mixed-case words; otherwise capitalise each part between hyphens and apostrophes."""
    parts = F.transform(F.split(word, "-"), lambda p: F.array_join(F.transform(F.split(p, "'"), capitalise), "'"))
    return F.when(word.rlike(r"^\p{Lu}\p{Ll}"), word).otherwise(F.array_join(parts, "-"))


def clean_names(df: DataFrame, raw: str, out: str = "name") -> DataFrame:
    """Keep the rows whose ``raw`` text is name-shaped and add the cleaned name."""
    # joiners are blanks, and what stands before and after a name goes at once: each change of a text costs as much as a test
    s = F.trim(F.regexp_replace(F.col(raw), V.NAME_JOINERS.replace("]", r"\s]"), " "))
    s = F.trim(sub(s, f"{V.NAME_HONORIFIC}|{V.NAME_SUFFIX}", ""))
    # most texts stop at this one cheap test
    df = once(df.filter(F.col(raw).rlike(NAME_CHARS)), _s=s).filter(F.length("_s").between(3, 60))
    blanks = F.length("_s") - F.length(F.replace("_s", F.lit(" "), F.lit("")))
    df = df.filter(blanks < 5).filter(~matches(F.col("_s"), V.NOT_A_NAME))
    recased = F.array_join(F.transform(F.split("_s", " "), title_case_name), " ")
    df = once(df, **{out: F.when(F.col("_s").rlike(CASED_WORDS), F.col("_s")).otherwise(recased)})
    return df.filter(F.col(out).rlike(NAME_WORDS)).drop("_s")


def email_tokens(email: Column) -> Column:
    local = F.substring_index(email, "@", 1)
    return F.filter(F.split(F.lower(local), V.EMAIL_TOKEN_SPLIT), lambda t: F.length(t) >= 3)


def file_tokens(name: Column) -> Column:
    base = F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")
    stop = F.array(*map(F.lit, V.FILE_TOKEN_STOP))
    return F.filter(F.split(F.lower(base), V.FILE_TOKEN_SPLIT), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def correct_spelling(value: Column, tokens: Column) -> Column:
    """Replace a word by the one file-name token at edit distance 1, when exactly one is that near."""

    def fix(word: Column) -> Column:
        low = F.lower(word)
        near = F.filter(tokens, lambda t: (F.length(t) >= 4) & (F.levenshtein(low, t) == 1))
        usable = (F.length(low) >= 4) & ~F.array_contains(tokens, low) & (F.size(near) == 1)
        one = F.get(near, F.lit(0))
        return F.when(usable, F.concat(F.upper(F.substring(one, 1, 1)), F.substring(one, F.lit(2), F.length(one)))).otherwise(word)

    return F.array_join(F.transform(F.split(value, " "), fix), " ")
