"""Only lines in which a field can stand are written, with labels where a field's can stand; all windows by line go in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakelake.operators.name import name_hits
from intakelake.operators.structure import FIELD_LABEL, annotate_lines, doc_lines, with_headings
from intakelake.plans.extraction import document_model

TEXT = "Asha Verghese\n** 1. Career Objective: **\nto work as a Nurse\nCity: Pune\nApplied For: Clerk\nFax: 022 2765 4321\nExperience 98765 43210\nNurse, Quill Press"


def texts(spark):
    return spark.createDataFrame([(1, TEXT, "a.pdf", None)], "doc_id long, text string, file_name string, ocr_confidence double")


def test_lines_that_are_written(spark):
    model = document_model(texts(spark))
    rows = {r.idx: r for r in model.lines.collect()}
    every = {r.idx: r for r in annotate_lines(texts(spark).select("doc_id", "text")).collect()}
    assert "emails" not in model.lines.columns
    assert set(rows) == {i for i, r in every.items() if i == 0 or not r.is_heading or i == 6} and 1 not in rows
    assert [(i, rows[i].label) for i in sorted(rows) if rows[i].label] == [(4, "Applied For"), (5, "Fax")]
    for i, r in rows.items():
        assert (r.section, r.next_text, r.first_entry, r.header_end) == (every[i].section, every[i].next_text, every[i].first_entry, every[i].header_end)
        assert r.prev_text in (None, every[i].prev_text)
    assert rows[5].prev_text == "Applied For: Clerk"


def test_decorated_headings_are_found(spark):
    lines = [f"{a}{h}{b}" for h in ("Objective", "CAREER OBJECTIVE", "Work Experience", "Skills", "I am", "職務経歴", "Referees") for a in ("", "** ", "1. ", "# 2) ", "> - ") for b in ("", ":", " **")]
    t = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    want = {r.idx for r in with_headings(doc_lines(t)).filter("is_heading").collect()}
    assert want and {r.idx for r in annotate_lines(t).filter("is_heading").collect()} == want


def test_windows_of_names_in_one_pass(spark):
    t = texts(spark)
    hits = name_hits(annotate_lines(t.select("doc_id", "text"), labelled=F.col("text").rlike(FIELD_LABEL)))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
