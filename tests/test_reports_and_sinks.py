"""Isolation, plans, files and snapshots."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from intakelake import values
from intakelake.functions.text import normalize_chars, strip_blank
from intakelake.operators import evaluation, intake, reports as r, textprep
from intakelake.sources import files, sinks
from intakelake.sources.views import view

SF = "/root/testdata/sf0.001"


def test_scope(spark):
    f = view(spark, SF, "cv_file")
    twin = f.unionByName(f.withColumn("workspace_id", F.col("workspace_id") + 100))
    for report in (lambda x: r.dashboard_stats(x, "2001-08-02 00:00:00"), lambda x: r.activity_by_day(x, "1995-01-01", "2001-12-31", "Asia/Kolkata"), lambda x: r.recent_files(x)):
        mine = lambda rows: report(r.scope_filter(rows, r.Session("ADMIN", 4))).collect()
        assert mine(twin) == mine(f)
    assert r.scope_filter(twin, r.Session("OWNER")).count() == 2 * f.count()
    with pytest.raises(PermissionError):
        r.scope_filter(f, r.Session("RECRUITER"))


def test_days_belong_to_the_viewer(spark):
    rows = [(1, "MANUAL", "2026-03-01 18:45:00"), (1, "MANUAL", "2026-03-01 10:00:00"), (1, "GOOGLE_DRIVE", "2026-03-01 12:30:00"), (1, "MANUAL", "2026-03-02 05:00:00")]
    f = spark.createDataFrame(rows, "workspace_id int, source_type string, t string").withColumn("created_at", F.to_timestamp("t"))
    days = lambda z: [(x.day, x.total) for x in r.activity_by_day(f, "2026-03-01", "2026-03-02", z).collect()]
    assert days("Asia/Kolkata") == [("2026-03-02", 2), ("2026-03-01", 2)]
    assert days("UTC") == [("2026-03-02", 1), ("2026-03-01", 3)] == days("Nowhere/Land")


def test_bounds_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sinks.write_candidates(view(spark, SF, "cv_file"), path)
    f = r.scope_filter(spark.read.parquet(path), r.Session("ADMIN", 4))
    plan = r.activity_by_day(f, "1998-01-01", "1998-12-31", "Asia/Kolkata")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "workspace_id" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "file_hash" not in plan


def test_snapshot_overwrites_touched_tenants_only(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sinks.write_candidates(spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "workspace_id int, cv_file_id int, v string"), path)
    sinks.write_candidates(spark.createDataFrame([(2, 2, "c")], "workspace_id int, cv_file_id int, v string"), path)
    assert {(x.workspace_id, x.v) for x in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_upsert_reads_and_writes_touched_tenants_only(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    kind = "cv_file_id int, v string, workspace_id int"
    sinks.write_candidates(spark.createDataFrame([(i, f"old {i}", i % 5) for i in range(40)], kind), path)
    files = lambda: {w: {(f, os.path.getmtime(f)) for f in glob.glob(f"{path}/workspace_id={w}/*.parquet")} for w in range(5)}
    before = files()
    new = spark.createDataFrame([(3, "new 3", 3), (8, "new 8", 3), (101, "new 101", 1)], kind)
    plan = sinks.touched_tenants(spark.read.schema(kind).parquet(path), new)._jdf.queryExecution().executedPlan().toString()
    assert "workspace_id" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    sinks.write_candidates(new, path)
    after = files()
    assert all((after[w] == before[w]) == (w not in (1, 3)) for w in range(5))
    want = {i: f"old {i}" for i in range(40)} | {3: "new 3", 8: "new 8", 101: "new 101"}
    assert {r.cv_file_id: r.v for r in spark.read.parquet(path).collect()} == want and spark.read.parquet(path).count() == len(want)


def test_manifest_reads_what_changed(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    old, now = 1_700_000_000, 1_700_001_000

    def put(name, content, at):
        os.makedirs(os.path.dirname(f"{folder}/in/{name}"), exist_ok=True)
        with open(f"{folder}/in/{name}", "wb") as f:
            f.write(content)
        os.utime(f"{folder}/in/{name}", (at, at))

    def held(k):
        return {r.path.split("/in/")[1]: (r.size, r.sha256, r.kind) for r in spark.read.parquet(f"{folder}/m{k}").collect()}

    said = lambda content, kind=None: (len(content), hashlib.sha256(content).hexdigest(), kind)
    put("a.pdf", b"%PDF-1.7 a", old)
    put("x/b.docx", b"PK\x03\x04 b", old)
    put("c.txt", b"c", now)
    put("empty.txt", b"", now)
    put("gone.txt", b"gone", old)
    files.refresh_manifest(spark, folder + "/in", folder + "/m0")
    assert held(0) == {"a.pdf": said(b"%PDF-1.7 a", "application/pdf"), "x/b.docx": said(b"PK\x03\x04 b", values.EXTENSION_MIME[".docx"]), "c.txt": said(b"c"), "gone.txt": said(b"gone")}
    put("a.pdf", b"%PDF-1.7 z", old)  # neither size nor time tell, so it is not read
    put("c.txt", b"more", now + 5)
    put("late.txt", b"copied with its old time", old - 50)
    put("same.txt", b"of the newest time known", now)
    os.remove(f"{folder}/in/gone.txt")
    files.refresh_manifest(spark, folder + "/in", folder + "/m1", folder + "/m0")
    want = held(0) | {"c.txt": said(b"more"), "late.txt": said(b"copied with its old time"), "same.txt": said(b"of the newest time known")}
    assert held(1) == {k: v for k, v in want.items() if k != "gone.txt"}
    files.refresh_manifest(spark, folder + "/in", folder + "/m2", folder + "/m1")
    assert held(2) == held(1) and spark.read.parquet(folder + "/m2").count() == 5


def test_sketches_merge_within_their_bound(spark):
    rng = random.Random(2)
    rows = [("a", d, int(rng.lognormvariate(5, 1.5))) for d in range(40) for _ in range(rng.randrange(900))] + [("b", 0, 7)] * 500 + [("c", d, d) for d in range(3)]
    given = spark.createDataFrame(rows, "engine string, day int, total_ms long")
    sketches = evaluation.latency_sketches(given, ["engine", "day"])
    got = {r.engine: r for r in evaluation.merged_percentiles(sketches).collect()}
    assert got["b"][2:] == (7, 7, 7) and got["a"].n == sum(r[0] == "a" for r in rows)
    for r in evaluation.rank_errors(given, evaluation.merged_percentiles(sketches)).collect():
        assert max(r.p50_off, r.p95_off, r.p99_off) <= evaluation.RANK_ERROR
    values_ = sorted(x for e, _, x in rows if e == "a")
    for p in (50, 95, 99):
        rank = sum(x <= got["a"][f"p{p}"] for x in values_) / len(values_)
        assert abs(rank - p / 100) <= evaluation.RANK_ERROR + values_.count(got["a"][f"p{p}"]) / len(values_)


def test_texts_without_repeats_are_cleaned_alike(spark):
    rng = random.Random(9)
    bits = ["", " ", "\n", "\r\n", "\n\n", "\n \n", "\t", "\x0b", "\u00a0", "\u2003\n", "\r", "a", "word", "long line that may well stand here twice, or not", "long line of another kind, which is also over the limit", "é"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(700)] + [(700, None), (701, ""), (702, " \n \n"), (703, "x" + " " * 50_000 + "y\n" * 3)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in textprep.normalize_text(given, compose=False).collect()}
    lines = textprep._clean_lines(given.select("doc_id", normalize_chars(F.col("text"), compose=False).alias("text")))
    want = {r.doc_id: r.t for r in lines.select("doc_id", strip_blank(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("t")).collect()}
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("sort,order", [(s, o) for s in r.SORTS for o in ("asc", "desc")])
def test_pages_follow_each_other(spark, sort, order):
    rows = [(i, 7, datetime(2024, 1, 1) + timedelta(days=i % 4)) for i in range(23)]
    cands = [(i, None if i % 5 == 0 else f"n{i % 3}", None if i % 4 == 1 else i % 3 / 4, None if i % 6 == 2 else datetime(2024, 2, 1 + i % 5)) for i in range(23) if i % 7]
    given = spark.createDataFrame(rows, "cv_file_id long, workspace_id int, created_at timestamp").coalesce(1)
    candidates = spark.createDataFrame(cands, "cv_file_id long, candidate_name string, overall_confidence double, processed_at timestamp").coalesce(1)
    f = r.CandidateFilters(sort=sort, order=order, page=1, page_size=5)
    whole = [x.cv_file_id for x in r.with_candidates(given, candidates).orderBy(*r.ordering(f)).collect()]
    seen, page = [], r.candidate_page(given, candidates, f).collect()
    while page:
        seen += [x.cv_file_id for x in page]
        last = page[-1][r.SORTS[sort]]
        page = r.candidate_page_after(given, candidates, f, str(last) if isinstance(last, datetime) else last, page[-1].cv_file_id).collect()
    assert seen == whole


def test_csv_file(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(2, '=1+1'), (1, 'say "hi", twice'), (3, "+91 98123-45670"), (4, None)], "k int, Name string")
    sinks.csv_export(df.coalesce(1), ["Name"], path, "k")
    text = b"".join(open(x, "rb").read() for x in sorted(__import__("glob").glob(path + "/part-*"))).decode()
    assert text == '﻿Name\r\n"say ""hi"", twice"\r\n\'=1+1\r\n+91 98123-45670\r\n\r\n'


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("hot")).repartition(7)
    got = [(x.hot, x.id) for x in sinks.numbered(df, "hot", "id").orderBy("row_no").collect()]
    assert got == sorted(got)
    assert sinks.numbered(df, "hot", "id").agg(F.max("row_no"), F.countDistinct("row_no")).first()[:] == (1000, 1000)


def test_ground_truth_keeps_nulls(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/truth.json"
    with open(path, "w") as f:
        json.dump({"count": 1, "entries": [{"file": "a.pdf", "layout": "plain", "expected": {"name": "Asha", "phone": None, "role": None}, "traits": ["no_phone"]}]}, f, indent=1)
    row = files.scan_ground_truth(spark, path).first()
    assert (row.name, row.phone, row.traits) == ("Asha", None, ["no_phone"])


def test_normal_text(spark):
    raw = "ﬁrst line “quoted”\r\n\r\n\n\nA repeated footer line of some length\n\nA repeated footer line of some length\n\nＡsha\u0007"
    t = textprep.normalize_text(spark.createDataFrame([(1, raw), (2, "")], "doc_id int, text string"))
    got = {x.doc_id: x.text for x in t.collect()}
    assert got[1] == 'first line "quoted"\n\nA repeated footer line of some length\n\n\nAsha'
    assert got[2] == ""


def test_uploads_in_one_batch_see_each_other(spark):
    b = spark.createDataFrame([(1, 1, 9, "h", None), (2, 2, 9, "h", None), (3, 3, 8, "h", None), (4, 4, 9, "k", None), (5, 5, 9, "z", "File is empty: z")],
                              "upload_id int, seq int, workspace_id int, file_hash string, error string")
    old = spark.createDataFrame([(70, 9, "k", "PROCESSED", "2020-01-02"), (71, 9, "k", "FAILED", "2020-01-01")],
                                "cv_file_id int, workspace_id int, file_hash string, status string, created_at string")
    got = {x.upload_id: (x.outcome, x.duplicate_of) for x in intake.upload_outcome(b, old).collect()}
    assert got == {1: ("queued", None), 2: ("duplicate", 1), 3: ("queued", None), 4: ("duplicate", 71), 5: ("rejected", None)}


def test_pages_cut_files_before_the_join(spark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("cv_file", "candidate"):
        view(spark, SF, name).write.parquet(f"{at}/{name}")
    f, c = spark.read.parquet(f"{at}/cv_file"), spark.read.parquet(f"{at}/candidate")
    plan = r.recent_files(f, c)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 8" in plan and plan.index("Join") < plan.index("GlobalLimit")
    assert "Join" not in r.page_totals(f, c, r.CandidateFilters(status="PROCESSED"))._jdf.queryExecution().optimizedPlan().toString()
    page = r.candidate_page(f, c, r.CandidateFilters(page=2)).collect()
    after = r.candidate_page(f, c, r.CandidateFilters(page=1)).collect()[-1]
    assert page == r.candidate_page_after(f, c, r.CandidateFilters(), str(after.created_at), after.cv_file_id).collect()


def test_characters_of_the_tables_are_stable(spark):
    import unicodedata

    for name in ("documents", "conversations"):
        for row in spark.read.parquet(f"{SF}/{name}.parquet").select("text").collect():
            assert unicodedata.normalize("NFKC", row.text) == unicodedata.normalize("NFC", row.text)


def test_long_texts_stay_whole(spark):
    long = "filler words of a long resume page\n" * 5 + "".join(f"line {i} of the body\n" for i in range(3000)) + "Mobile: 9812345670\n" + "".join(f"more {i} of the body\n" for i in range(3000))
    t = textprep.normalize_text(spark.createDataFrame([(1, long)], "doc_id int, text string")).first().text
    assert len(t) > 100_000 and "Mobile: 9812345670" in t and "truncated" not in t
