"""Digit runs of fewer than eight digits, which no number has, are runs all the same: as in SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from intakelake.catalog import oracle_sql, queries
from intakelake.sources.views import RAW

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
KEYS = ["normalize_phone", "phone_context_veto", "phone_impossible", "phone_runs"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("runs"))
    for t in RAW:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{at}/{t}.parquet")
    text = "key AKIA6753567FF\nfrom 1 2 3 4 5 6 on\nin 2 - - - 7\nmarks 12.34.56 and 98123 45670\nnone 12345"
    duckdb.sql(f"COPY (SELECT * REPLACE ('{text}' AS text) FROM '{SF}/documents.parquet' LIMIT 1) TO '{at}/documents.parquet'")
    return at


@pytest.mark.parametrize("key", KEYS)
def test_runs_of_few_digits_stay(spark, tables, key):
    out = compare(spark, connect(tables), tables, queries()[key], oracle_sql()[key])
    assert out.startswith("ok"), out
    assert queries()[key](spark, tables).filter("doc_id < 0").count() == 5
