"""Evidence is worked out in generated code, and only for lines that have some; lines are sorted once."""

from __future__ import annotations

import re

import pytest

from intakelake.operators.name import name_hits
from intakelake.operators.phone import EIGHT_DIGITS
from intakelake.operators.role import INTENT_WORD, role_evidence
from intakelake.operators.structure import annotate_lines

WORDS = ["seeking", "Searching", "looking", "to  work", "wish ", "want ", "Aspire", "apply", "position of", "role\tof", "POST of", "as a ", "as an "]


@pytest.fixture(scope="module")
def lines(spark):
    return annotate_lines(spark.createDataFrame([(1, "Asha Verghese\nSeeking a position of Data Analyst")], "doc_id long, text string"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_once(lines):
    assert len(re.findall(r"\bSort \[", plan(lines))) == 1


@pytest.mark.parametrize("step", [name_hits, role_evidence])
def test_only_kinds_are_exploded(lines, step):
    exploded = [x for x in plan(step(lines)).splitlines() if "Generate explode" in x]
    assert exploded and not any("named_struct" in x or "lambdafunction" in x for x in exploded)


def test_evidence_of_each_kind_stays(spark):
    text = "Full Name: Asha Verghese\nApplied For: Clerk\nObjective\nto work as a Web Developer\nin a growing firm\nExperience\nPresent Position: Nurse"
    rows = role_evidence(annotate_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    got = {(r.idx, r.tier, r.points, r.raw, r.scan) for r in rows}
    assert {(1, 1, 72, "Clerk", None), (3, 3, 50, None, "to work as a Web Developer"), (3, 3, 48, None, "to work as a Web Developer in a growing firm"),
            (3, 2, 66, "Web Developer", None), (3, 2, 64, "Web Developer in a growing firm", None), (6, 5, 30, "Nurse", None),
            (6, 5, 26, None, "Present Position: Nurse")} <= got


def test_cheap_tests_find_the_same(spark):
    words = spark.createDataFrame([(f"x {w}y",) for w in WORDS], "t string")
    assert words.filter(words.t.rlike(INTENT_WORD)).count() == len(WORDS)
    digits = spark.createDataFrame([("1 2 3 4 5 6 7 8",), ("a\n12345678",), ("1234567",), ("",)], "t string")
    assert digits.filter(digits.t.rlike(EIGHT_DIGITS)).count() == 2
