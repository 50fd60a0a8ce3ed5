"""Cheap tests before costly patterns change no result; what is read twice is worked out once."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from intakelake import values as V
from intakelake.catalog import queries
from intakelake.functions.names import strip_contact
from intakelake.functions.regex import sub
from intakelake.operators.structure import strip_decoration

ENDS = ["", " ", "-", "*", "7", "12.", "3) ", ":", "<", ">", "\r", "\u0085", " ", "a", "é"]
MIDDLES = ["", "x", "Asha Rao", "a@b.example", "98123 45670", "1 (22) 33-4", "HTTPS://x.y", "see WWW.x.y now", "two  blanks"]


def test_cheap_tests_change_nothing(spark):
    df = spark.createDataFrame([(a + m + b,) for a, m, b in product(ENDS, MIDDLES, ENDS)] + [(None,)], "t string")
    t = F.col("t")
    bare = F.trim(sub(sub(sub(t, V.LEAD_MARKS, ""), V.TRAIL_MARKS, ""), V.LIST_NUMBER, ""))
    plain = F.trim(F.regexp_replace(sub(sub(sub(t, V.EMAIL, " "), V.CONTACT_DIGITS, " "), V.CONTACT_URL, " "), r"\s{2,}", " "))
    bad = df.filter(~strip_decoration(t).eqNullSafe(bare) | ~strip_contact(t).eqNullSafe(plain)).collect()
    assert not bad, bad[:3]


def test_fallback_reads_the_files_once_for_hits_and_once_for_tokens(spark):
    plan = queries()["name_fallback_hits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") == 1  # the hits are read as written, the tokens made from the texts
