"""Characters that Java and RE2 class differently, in texts with digit runs: as in SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from intakelake.catalog import oracle_sql, queries
from intakelake.sources.views import RAW

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
# a vertical tab ends a run; the last line has a run that only its first part makes impossible
TABS = "tel 98123\x0b45670 and 1990673501\x0b5039666\nor 9812345670 \x0b 022-27654321\n0000000000\x0b1"
# the Kelvin sign and long s stand for k and s, but are no word characters
LETTERS = "marKs 9812345670\nſalary 9812345670\naſalary 9812345671\npaſſport 9812345672\nmarkſ 9812345673\nmarkſa 9812345674\n2019 to preſent 12345678\npin\x0bcode 9812345675"
CASES = [("phone_context_veto", LETTERS, 8), ("phone_impossible", TABS, 5), ("phone_runs", TABS, 5)]


@pytest.mark.parametrize(("key", "text", "n"), CASES)
def test_same_as_sql(spark, tmp_path, key, text, n):
    at = str(tmp_path)
    for t in RAW:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{at}/{t}.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (cast($text AS varchar) AS text) FROM '{SF}/documents.parquet' LIMIT 1) TO '{at}/documents.parquet'", {"text": text})
    out = compare(spark, connect(at), at, queries()[key], oracle_sql()[key])
    assert out.startswith("ok"), out
    assert queries()[key](spark, at).filter("doc_id < 0").count() == n
