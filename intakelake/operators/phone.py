"""The candidate's own phone number: runs -> scored -> best per document.

Points are whole hundredths, so sums and comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions.phones import digits_of, impossible, with_phone
from ..functions.regex import every, matches, matches_folding
from ..functions.stage import once

P = V.PHONE_POINTS
#: Counted from the start once: a text of fewer digits is not searched again from each of its characters.
EIGHT_DIGITS = r"^(?:[^0-9]*+[0-9]){8}"


def phone_runs(lines: DataFrame) -> DataFrame:
    """Digit runs, also those of too few digits; each holds seven characters at least that are digits or stand between them."""
    return lines.filter(F.col("text").rlike(r"[0-9][0-9\s.-]{5}")).select("*", F.posexplode(every(F.col("text"), V.PHONE_RUN)).alias("pos", "raw"))


def _around(n_before: int, n_after: int) -> tuple[Column, Column]:
    at = F.instr("text", F.col("raw"))
    start = F.greatest(at - n_before, F.lit(1))
    before = F.substring(F.col("text"), start, at - start)
    after = F.substring(F.col("text"), at + F.length("raw"), F.lit(n_after))
    return before, after


def context_veto(digits: Column) -> Column:
    """The run belongs to an identifier, an amount or a date."""
    before, after = _around(40, 20)
    text, context = F.col("text"), V.NON_PHONE_CONTEXT
    return (matches_folding(text, context) & (matches_folding(before, context) | matches_folding(after, context))) | (
        (F.length(digits) <= 8) & matches_folding(text, V.DATE_LIKE)
    )


def plausible_runs(lines: DataFrame) -> DataFrame:
    # a line with fewer than eight digits cannot hold a number
    runs = once(phone_runs(lines.filter(F.col("text").rlike(EIGHT_DIGITS))), digits=digits_of(F.col("raw"))).filter(~impossible(F.col("digits")))
    return with_phone(runs, "raw").filter("phone_valid").filter(~context_veto(F.col("digits")))


def phone_score(runs: DataFrame) -> DataFrame:
    """Add ``points``, ``signals`` and ``why`` to plausible runs."""
    text, label, section = F.col("text"), F.coalesce("label", F.lit("")), F.col("section")
    before, _ = _around(45, 0)
    with_prev = F.when(F.coalesce("prev_text", F.lit("")) == "", text).otherwise(F.concat("prev_text", F.lit(" "), text))
    df = once(
        once(runs, _before=before),
        foreign_label=matches(F.col("_before"), V.FOREIGN_PHONE_LABEL) | matches(label, V.FOREIGN_PHONE_LABEL),
        _own=matches(F.col("_before"), V.OWN_PHONE_LABEL) | matches(label, V.OWN_PHONE_LABEL),
        third_party=matches(with_prev, V.THIRD_PARTY_LINE),  # what matches in the line alone does so after a blank
        indian=F.col("phone_country") == "IN",
        mobile=(F.col("phone_country") == "IN") & F.col("phone").rlike(r"^\+91[6-9]\d{9}$"),
    ).withColumn("own_label", F.col("_own") & ~F.col("foreign_label"))
    in_header = F.col("idx") < F.col("header_end")
    rules = [  # (when, points, reason)
        (F.col("own_label"), P["own_label"], "labelled as the candidate's mobile/contact"),
        (F.col("foreign_label"), P["foreign_label"], "labelled as an alternate/third-party number"),
        (in_header, P["header"], "in the header contact block"),
        (~in_header & (F.col("idx") < F.col("header_end") + 6), P["below_header"], None),
        (section == "personal_details", P["personal_details"], "in the personal details section"),
        (section == "references", P["references"], "inside the references section"),
        (F.col("third_party"), P["third_party"], "attributed to a named third party"),
        (section.isin("experience", "education"), P["employer"], "inside an employer/institute section"),
        (F.col("mobile"), P["indian_mobile"], "valid Indian mobile format"),
        (F.col("indian") & ~F.col("mobile"), P["landline"], "Indian landline format"),
        (F.col("has_email"), P["email_line"], "on the same line as an email address"),
    ]
    points, reasons = F.lit(P["base"]), []
    for cond, n, reason in rules:
        points = points + F.when(cond, n).otherwise(0)
        if reason:
            reasons.append(F.when(cond, reason))
    return (
        df.withColumn("points", F.greatest(points, F.lit(0)))
        .withColumn(
            "signals",
            F.when(F.col("own_label"), F.array(F.lit("explicit_label"), F.lit("regex")))
            .when(in_header | (section == "personal_details"), F.array(F.lit("contact_section"), F.lit("regex"))).otherwise(F.array(F.lit("regex"))),
        )
        .withColumn("why", F.concat_ws("; ", *reasons))
        .withColumn("why", F.when(F.col("why") == "", "matched a phone pattern").otherwise(F.col("why")))
    )


def phone_candidates(lines: DataFrame) -> DataFrame:
    """One row per document and number: its best-scoring place, first-seen order kept for ties."""
    by_number = Window.partitionBy("doc_id", "phone")
    scored = phone_score(plausible_runs(lines)).filter("points > 0").withColumn("ord", F.struct("idx", "pos"))
    return (
        scored.withColumn("_n", F.row_number().over(by_number.orderBy(F.desc("points"), "ord")))
        .withColumn("first_ord", F.min("ord").over(by_number))
        .filter("_n = 1")
        .select("doc_id", "phone", "points", "signals", "why", "idx", F.col("first_ord").alias("ord"))
    )


def rank_candidates(cands: DataFrame, value: str) -> DataFrame:
    """Rank per document; carry the runner-up's points."""
    ranked = Window.partitionBy("doc_id").orderBy(F.desc("points"), "ord")
    return cands.withColumn("rank", F.row_number().over(ranked)).withColumn("_next", F.lead("points").over(ranked)).withColumn(
        "next_points", F.when(F.col("_next") > 0, F.col("_next"))).drop("_next")


def top_and_rest(ranked: DataFrame, value: str, extra: list[str]) -> DataFrame:
    """Collapse ranks 1-4 to one row: the best candidate and up to three alternatives."""
    cap = F.least("points", F.lit(V.TOP_CONFIDENCE)) / 100
    best = {c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in [value, "points", "next_points", *extra]}
    rest = F.when((F.col("rank") > 1) & (F.col("points") > 0), F.struct("rank", F.col(value).alias("value"), cap.alias("confidence")))
    return (
        ranked.filter("rank <= 4")
        .groupBy("doc_id")
        .agg(*best.values(), F.sort_array(F.collect_list(rest)).alias("_rest"))
        .withColumn("alternatives", F.transform("_rest", lambda r: F.struct(r["value"].alias("value"), r["confidence"].alias("confidence"))))
        .drop("_rest")
    )


def phone_best(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Best number, confidence, method and evidence for every document (``Not Found`` included)."""
    top = top_and_rest(rank_candidates(cands, "phone"), "phone", ["signals", "why", "idx"])
    margin = F.col("points") - F.col("next_points")
    conf = F.least(
        F.col("points"), F.lit(V.TOP_CONFIDENCE), F.when(margin < 15, 72).when(margin < 30, 85).otherwise(V.TOP_CONFIDENCE)
    )
    j = docs.select("doc_id").join(top, "doc_id", "left")
    ok = F.coalesce(F.col("points") >= V.PHONE_FLOOR, F.lit(False))
    none = F.when(F.col("points").isNull(), "no digit run in the document passed phone validation").otherwise(
        F.concat(F.lit("the only numbers found are attributed to someone else (best: "), "why", F.lit(")"))
    )
    return j.select(
        "doc_id",
        F.when(ok, F.col("phone")).otherwise(V.NOT_FOUND).alias("phone"),
        F.when(ok, conf / 100).otherwise(0.0).alias("phone_confidence"),
        F.when(ok, F.element_at("signals", 1)).otherwise("none").alias("phone_method"),
        F.when(ok, F.col("why")).otherwise(none).alias("phone_why"),
        F.when(ok, F.col("idx")).alias("phone_line"),
        F.when(ok, F.col("alternatives")).alias("phone_alternatives"),
    )


def phone_reuse(candidates: DataFrame) -> DataFrame:
    """Numbers held by more than one CV of a tenant."""
    return (
        candidates.filter(F.col("phone_number") != V.NOT_FOUND)
        .groupBy("workspace_id", "phone_number").agg(F.count("*").alias("n_cvs")).filter("n_cvs > 1")
    )
