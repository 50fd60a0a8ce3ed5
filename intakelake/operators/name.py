"""The candidate's name: hits from five kinds of places, merged, corroborated, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions.names import NAME_SHAPE, clean_names, correct_spelling, email_tokens, file_tokens, strip_contact
from ..functions.regex import matches
from ..functions.stage import once
from .phone import rank_candidates, top_and_rest
from .structure import line_emails

P = V.NAME_POINTS
FALLBACK = 5


def doc_tokens(docs: DataFrame) -> DataFrame:
    """Per document: words of its e-mail addresses and of its file name, as sets.

    An address holds no blanks, so only the blank-free pieces with an @ are searched.
    """
    return docs.select("doc_id", *[c.alias(n) for n, c in token_columns().items()])


def token_columns() -> dict[str, Column]:
    """The columns of :func:`doc_tokens`, from a document's own row."""
    pieces = F.filter(F.split("text", r"\s+"), lambda p: F.contains(p, F.lit("@")))
    words = F.flatten(F.transform(F.flatten(F.transform(pieces, line_emails)), email_tokens))
    return {"file_tokens": F.array_distinct(file_tokens(F.coalesce("file_name", F.lit("")))), "ocr_used": F.col("ocr_confidence").isNotNull(),
            "email_tokens": F.array_distinct(words)}


def name_hits(lines: DataFrame) -> DataFrame:
    """Every name-shaped string with the signal that found it; one pass over the lines."""
    text, idx, label = F.col("text"), F.col("idx"), F.coalesce("label", F.lit(""))
    body, trimmed = ~F.col("is_heading"), F.trim(F.col("text"))
    named = F.coalesce(matches(F.col("label"), V.NAME_LABEL), F.lit(False))
    header_limit = F.when(F.col("has_headings"), F.col("header_end")).otherwise(6)

    df = once(lines, _named=named, _plain=F.when(body & ((idx < header_limit) | F.col("beside_email")), strip_contact(text)))
    named, plain = F.col("_named"), F.col("_plain")
    # of the fallback, what holds no name's characters, or but one word, cannot count in the end, nor what another step takes as it stands
    shaped = ~F.coalesce(plain == trimmed, F.lit(False)) & F.length(trimmed).between(1, 40) & trimmed.rlike(NAME_SHAPE)
    steps = [named, body & (idx < header_limit), body & (F.col("section") == "personal_details"), body & F.col("beside_email"),
             body & (F.col("section") != "references") & shaped]
    # only the kind of place is exploded, and nulls leave next: what it says is worked out for the rows that stay
    found = df.select("doc_id", "idx", "text", "label", "value", "_named", "_plain", F.explode(F.array(*[F.when(c, n) for n, c in enumerate(steps, 1)])).alias("step"))
    step, idx_s = F.col("step"), idx.cast("string")
    raw = F.when(step.isin(2, 4), plain).when((step == 1) | ((step == 3) & named), F.col("value")).when(step == 3, text).otherwise(trimmed)
    rows = clean_names(found.filter("step is not null").withColumn("raw", raw), "raw")
    return rows.select(
        "doc_id", "idx", "step",
        F.when(step == 1, P["label"]).when(step == 2, F.greatest(P["header_top"] - P["header_step"] * idx, F.lit(P["header_min"]))).when(step == 3, P["details"])
        .when(step == 4, P["adjacent"]).otherwise(P["fallback"]).cast("int").alias("points"),
        F.when(step == 1, "explicit_label").when(step == 2, "header_detection").when(step == FALLBACK, "heuristic").otherwise("contact_section").alias("signal"),
        F.when(step == 1, F.concat(F.lit('explicit "'), label, F.lit('" label'))).when(step == 2, F.concat(F.lit("name-shaped line "), idx_s, F.lit(" of the header")))
        .when(step == 3, "in the personal details section").when(step == 4, "adjacent to the contact line")
        .otherwise(F.concat(F.lit("isolated name-shaped line "), idx_s, F.lit(", corroborated (header window found nothing)"))).alias("why"),
        "name", (step.cast("long") * 10**9 + idx).alias("ord"),
    )


def name_merge(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """One candidate per spelling. The fallback counts only where nothing else was found, and only when corroborated.

    Words and word count depend on the merged spelling alone, so hits are merged before the tokens are joined.
    """
    doc = Window.partitionBy("doc_id")
    live = hits.withColumn("_placed", F.min("step").over(doc) < FALLBACK).filter((F.col("step") < FALLBACK) | ~F.col("_placed"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "signal", "why", "name")))
    merged = (
        live.groupBy("doc_id", F.lower("name").alias("name_key"))
        .agg(F.max("points").alias("points"), F.min("step").alias("step"), ordered.alias("_h"))
        .withColumn("ord", F.col("_h")[0]["ord"]).withColumn("name", F.col("_h")[0]["name"])
        .withColumn("signals", F.array_distinct("_h.signal"))
        .withColumn("why", F.array_join("_h.why", "; "))
        .drop("_h")
    )
    words = F.split("name_key", " ")
    known = F.arrays_overlap(words, "email_tokens") | F.arrays_overlap(words, "file_tokens")
    return merged.join(tokens, "doc_id").filter((F.col("step") < FALLBACK) | (F.size(words).between(2, 4) & known)).drop("step")


def name_corroborate(cands: DataFrame) -> DataFrame:
    """Raise or lower each candidate by what the e-mail address and the file name say."""
    words = F.split("name_key", " ")

    def shared(tokens):
        known = F.filter(words, lambda w: (F.length(w) >= 3) & F.array_contains(tokens, w))
        return F.when(F.arrays_overlap(words, tokens), F.size(known)).otherwise(0)

    df = (
        cands.withColumn("_n", F.size(words)).withColumn("_on", F.col("name_key").rlike("[^ ]{3}"))
        .withColumn("_e", shared("email_tokens")).withColumn("_f", shared("file_tokens"))
    )
    e, f, n = F.col("_e"), F.col("_f"), F.col("_n")
    lone = (n == 1) & (e == 0) & (f == 0) & ~F.array_contains("signals", "explicit_label")
    change = (
        F.when(e >= 2, 30).when(e == 1, 18).otherwise(0) + F.when(f >= 2, 24).when(f == 1, 14).otherwise(0)
        - F.when(lone, 25).otherwise(0) + F.when(n.isin(2, 3), 8).otherwise(0)
    )
    return (
        df.withColumn("points", F.col("points") + F.when(F.col("_on"), change).otherwise(0))
        .withColumn("why", F.concat_ws("", "why",
            F.when(e > 0, F.concat(F.lit("; "), e.cast("string"), F.lit(" token(s) match the email address"))),
            F.when(f > 0, F.concat(F.lit("; "), f.cast("string"), F.lit(" token(s) match the file name"))),
            F.when(F.col("_on") & lone, "; single word with no corroboration")))
        .withColumn("signals", F.concat("signals", F.array_compact(F.array(F.when(e > 0, "email_local_part"), F.when(f > 0, "filename")))))
        .drop("_e", "_f", "_n", "_on")
    )


def name_candidates(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    return name_corroborate(name_merge(name_hits(lines), tokens))


def name_best(docs: DataFrame, cands: DataFrame) -> DataFrame:
    live = rank_candidates(cands, "name")
    top = top_and_rest(live, "name", ["signals", "why", "ocr_used", "file_tokens"])
    fixed = F.when(F.col("ocr_used") & (F.size("file_tokens") > 0), correct_spelling(F.col("name"), F.col("file_tokens"))).otherwise(F.col("name"))
    conf = F.least("points", F.lit(V.TOP_CONFIDENCE), F.when(F.col("points") - F.col("next_points") < 10, 70).otherwise(V.TOP_CONFIDENCE))
    has = lambda s: F.array_contains("signals", s)
    j = docs.select("doc_id").join(top.withColumn("_fixed", fixed), "doc_id", "left")
    ok = F.coalesce(F.col("points") > 0, F.lit(False))
    changed = F.col("_fixed") != F.col("name")
    return j.select(
        "doc_id",
        F.when(ok, F.col("_fixed")).otherwise(V.NOT_FOUND).alias("name"),
        F.when(ok, conf / 100).otherwise(0.0).alias("name_confidence"),
        F.when(~ok, "none").when(has("explicit_label"), "explicit_label").when(has("email_local_part"), "email_local_part")
        .otherwise(F.element_at("signals", 1)).alias("name_method"),
        F.when(~ok & F.col("points").isNotNull(), "all name candidates were rejected during scoring").when(changed, F.concat("why", F.lit("; spelling corrected from the file name (OCR glyph confusion)")))
        .otherwise(F.coalesce("why", F.lit("no line in the document matched a person-name shape"))).alias("name_why"),
        F.coalesce(ok & changed, F.lit(False)).alias("name_corrected"),
        F.when(ok, F.col("alternatives")).alias("name_alternatives"),
    )
