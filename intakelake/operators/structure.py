"""Document structure: one row per line, annotated with section and label.

Texts are hash-partitioned by ``doc_id`` once, before lines are exploded. Every
later window, aggregate and join on ``doc_id`` keeps that partitioning, so the
lines themselves are never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .. import values as V
from ..functions.regex import every, group, matches, sub
from ..functions.stage import once

# Every section pattern starts with one of these; most lines stop at this one cheap test.
_STARTS = (
    r"(?:c(?:areer|andidate|ore|ompetenc|ertification|ourse)|o(?:bjective|verview)|p(?:rofessional|rofile|ersonal|roject)|job|s(?:ummary|ynopsis|kill)"
    r"|a(?:bout|cademic|chievement|ward|ccomplishment)|e(?:xecutive|xperience|mployment|ducation|xpertise)|re(?:sume|fer)|headline|bio|work|職務"
    r"|i(?:nternship|t\s|\s)|qualification|tech|key|major|training|declaration)"
)
HEADING_START = "(?i)^" + _STARTS
#: The same before anything is stripped: no line without it is a heading.
MAYBE_HEADING = r"(?i)^[\s\d.)*#|>~=_·•▪◦\-–—]*+" + _STARTS


def by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("idx")


def whole_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def by_doc(df: DataFrame) -> DataFrame:
    """Hash-partition by document. The count is explicit: pattern work is bound by CPU, so
    small shuffles must not be merged into a few tasks by their size in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def doc_lines(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text) -> one row per line, 0-based ``idx``, with the document's line count.

    Columns to keep stay on the document's first line, null on the others.
    """
    keep = keep or []
    parts = by_doc(texts.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", *keep, F.split("text", "\n").alias("parts"))
    rows = parts.select("doc_id", *keep, F.size("parts").alias("n_lines"), F.posexplode_outer("parts").alias("idx", "text"))
    return rows.withColumns({c: F.when(F.col("idx") == 0, F.col(c)) for c in keep}) if keep else rows


# Of a line's first and last character: one that neither begins with a mark, digit or blank nor ends with a mark or blank has nothing to strip.
EDGE = r"^[\s\d*#|>~=_·•▪◦\-–—\u0085\u2028\u2029]|[\s*#|<~=_·•▪◦\-–—:\u0085\u2028\u2029]$"


def strip_decoration(line: Column) -> Column:
    bare = F.trim(sub(sub(sub(line, V.LEAD_MARKS, ""), V.TRAIL_MARKS, ""), V.LIST_NUMBER, ""))
    return F.when(F.concat(F.left(line, F.lit(1)), F.right(line, F.lit(1))).rlike(EDGE), bare).otherwise(line)


def detect_section(bare: Column) -> Column:
    """Section named by an undecorated heading line, else null. The first listed section wins."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(V.SECTIONS):
        kind = F.when(matches(bare, pattern), name).otherwise(kind)
    return F.when(F.length(bare).between(1, V.HEADING_CHARS) & bare.rlike(HEADING_START), kind)


def with_headings(lines: DataFrame, bare: Column | None = None) -> DataFrame:
    """``bare`` where it is not the undecorated line itself: null where the line is no heading in any case."""
    df = once(lines, bare=strip_decoration(F.col("text")) if bare is None else bare)
    return once(df, kind=detect_section(F.col("bare"))).withColumn("is_heading", F.col("kind").isNotNull())


def _section() -> Column:
    running = by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last("kind", ignorenulls=True).over(running), F.lit("header"))


def section_fill(lines: DataFrame) -> DataFrame:
    """Every line takes the kind of the last heading at or above it."""
    return lines.withColumn("section", _section())


def header_bounds(lines: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("is_heading"), F.col("idx"))).over(whole_doc())
    return _bounded(lines.withColumn("first_heading", first))


def _bounded(lines: DataFrame) -> DataFrame:
    return (
        lines
        .withColumn("has_headings", F.col("first_heading").isNotNull())
        .withColumn("header_end", F.least(F.coalesce("first_heading", "n_lines"), F.lit(V.HEADER_LINES)))
        .drop("first_heading")
    )


#: A line with a label that names the candidate, the role applied for or the present one starts like this.
FIELD_LABEL = r"(?i)^\s*+(?:candidate|full|name|appl|po(?:sition|st)|job|role|desired|pre(?:ferred|sent)|designation|current|title)"


def label_value(lines: DataFrame, where: Column | None = None) -> DataFrame:
    """``Label: value``, else a known label followed by its value with no separator; only of lines ``where`` holds, if it is given."""
    # no separator, no label; and what a pattern captures second is looked for only where it captured something first
    body = F.when(~F.col("is_heading") if where is None else ~F.col("is_heading") & where, F.col("text"))
    marked = once(lines, _l=group(F.when(body.rlike("[:\\-–—]"), body), V.LABEL_LINE, 1))
    bare = F.when(F.col("_l").isNull(), body)
    marked = once(marked, _b=group(bare, V.BARE_LABEL_LINE, 1))
    value = F.when(F.col("_l").isNotNull(), group(F.col("text"), V.LABEL_LINE, 2)).when(F.col("_b").isNotNull(), group(F.col("text"), V.BARE_LABEL_LINE, 2))
    return once(marked, separated=F.col("_l").isNotNull(), label=F.trim(F.coalesce("_l", "_b")), value=F.trim(value)).drop("_l", "_b")


def line_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), every(text, V.EMAIL)).otherwise(F.array().cast("array<string>"))


def line_urls(text: Column) -> Column:
    return every(text, V.URL)


def find_emails(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "idx", F.posexplode(line_emails(F.col("text"))).alias("pos", "email"))


def find_urls(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "idx", F.posexplode(line_urls(F.col("text"))).alias("pos", "url"))


def annotate_lines(texts: DataFrame, keep: list[str] | None = None, labelled: Column | None = None) -> DataFrame:
    """The structural model of every document: the input of all field extractors.

    What a line says of itself comes first, what it has from its neighbours after: so one sort serves all windows.
    Labels are looked for in the lines for which ``labelled`` holds, or in all.
    """
    text, doc = F.col("text"), by_line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in one pass with the windows by line
    headed = with_headings(doc_lines(texts, keep), F.when(text.rlike(MAYBE_HEADING), strip_decoration(text)))
    lines = once(label_value(headed, labelled), emails=line_emails(text)).withColumn("has_email", F.size("emails") > 0)
    first_entry = F.min(F.when((F.col("section") == "experience") & ~F.col("is_heading") & (F.trim("text") != ""), F.col("idx"))).over(doc)
    # stated together, so one window serves them all
    around = lines.withColumns({
        "section": _section(), "prev_text": F.lag("text").over(by_line()),
        "next_text": F.when(~F.lead("is_heading").over(by_line()), F.lead("text").over(by_line())),
        "beside_email": F.coalesce(F.lag("has_email").over(by_line()), F.lit(False)) | F.coalesce(F.lead("has_email").over(by_line()), F.lit(False)),
        "first_heading": F.min(F.when(F.col("is_heading"), F.col("idx"))).over(doc),
    })
    return _bounded(around).withColumn("first_entry", first_entry).drop("bare", "kind", "n_lines", "separated")


def section_lines(lines: DataFrame, kind: str) -> DataFrame:
    return lines.filter((F.col("section") == kind) & ~F.col("is_heading")).select("doc_id", "idx", "text")


def section_starts(lines: DataFrame, kind: str) -> DataFrame:
    first = F.min(F.when(F.col("section") == kind, F.col("idx")))
    return lines.groupBy("doc_id").agg(F.coalesce(first, F.lit(-1)).alias("start"))


def line_windows(lines: DataFrame) -> DataFrame:
    """Each body line alone, then joined with the next body line of the same section."""
    both = F.array(
        F.struct(F.lit(False).alias("joined"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("joined"), F.concat_ws(" ", "text", F.col("next_text")).alias("text")),
    )
    return (
        lines.filter(~F.col("is_heading"))
        .select("doc_id", "idx", "section", "next_text", F.explode(both).alias("w"))
        .filter(~F.col("w.joined") | F.col("next_text").isNotNull())
        .select("doc_id", "idx", "section", "w.joined", "w.text")
    )


def section_profile(lines: DataFrame) -> DataFrame:
    return lines.groupBy("section").agg(
        F.count("*").alias("n_lines"), F.count_if("is_heading").alias("n_headings"), F.count_if(F.col("label").isNotNull()).alias("n_labels")
    )
