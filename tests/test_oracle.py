"""Registered queries against independent SQL on the smallest scale."""

from __future__ import annotations

import pytest

from intakelake.catalog import oracle_sql, queries

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
# the long pipeline is compared at its end; these cut it at earlier points
REPEATS = {"ocr_penalty", "assemble", "low_ocr_review", "final_status", "stream_extract", "role_tier1", "role_tier2", "role_tier3", "role_tier4",
           "name_alternatives", "role_alternatives", "phone_alternatives", "name_ocr_fix", "name_corroborate", "name_merge", "prf", "rescore"}
#: Lists the files of a folder, which SQL over the tables cannot.
NO_SQL = {"list_files"}
KEYS = [k for k in queries() if k not in REPEATS | NO_SQL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    out = compare(spark, con, SF, queries()[key], oracle_sql().get(key))
    assert out.startswith("ok"), out


def test_every_oracle_has_a_query():
    assert set(queries()) - set(oracle_sql()) == NO_SQL and set(oracle_sql()) <= set(queries())
