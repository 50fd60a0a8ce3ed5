"""Registered queries: sources, exports and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..operators import reports as rp
from ..sources import files as sfiles, settings as sset, sinks as sk
from ..sources.views import raw, view
from . import sql as S
from .out import place, plain

QUERIES, ORACLE = {}, {}


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


@query("list_files")
def _(spark, sf):
    return sfiles.scan_files(spark, sf, "*.parquet").select("key", "size")


_JS = lambda n: f"json_extract_string(value, '$.{n}')"
_OKS = f"""(coalesce(cast({_JS('confidenceThreshold')} AS double) BETWEEN 0 AND 1, true) AND coalesce(cast({_JS('maxRetries')} AS int) BETWEEN 0 AND 10, true) AND coalesce(cast({_JS('ocrMaxPages')} AS int) BETWEEN 1 AND 50, true))"""


@query("scan_settings", f"""SELECT setting_id, ok AS valid, CASE WHEN ok THEN coalesce(cast({_JS('confidenceThreshold')} AS double), 0.75) ELSE 0.75 END AS "confidenceThreshold",
   CASE WHEN ok THEN coalesce(cast({_JS('maxRetries')} AS bigint), 3) ELSE 3 END AS "maxRetries", CASE WHEN ok THEN coalesce(cast({_JS('ocrMaxPages')} AS bigint), 5) ELSE 5 END AS "ocrMaxPages",
   CASE WHEN ok THEN coalesce({_JS('extractionEngine')}, 'local') ELSE 'local' END AS "extractionEngine", CASE WHEN ok THEN {_JS('driveFolderId')} END AS "driveFolderId", 20000 AS "maxCvTextChars"
  FROM (SELECT *, {_OKS} AS ok FROM setting) s""")
def _(spark, sf):
    return sset.scan_settings(view(spark, sf, "setting"), "setting_id").select(
        "setting_id", "valid", "confidenceThreshold", "maxRetries", "ocrMaxPages", "extractionEngine", "driveFolderId", "maxCvTextChars")


@query("scan_ground_truth", "SELECT file_name AS file, truth_name AS name, truth_phone AS phone, truth_role AS role, array_to_string(traits, ' | ') AS traits FROM cv_text")
def _(spark, sf):
    t = view(spark, sf, "cv_text")
    entry = F.to_json(F.struct(F.col("file_name").alias("file"), F.struct(F.col("truth_name").alias("name"), F.col("truth_phone").alias("phone"), F.col("truth_role").alias("role")).alias("expected"), "traits"))
    return sfiles.truth_rows(t.select(F.from_json(entry, sfiles.TRUTH_SCHEMA).alias("x")), F.col("x")).drop("layout")


CELL = lambda c: f"""(SELECT CASE WHEN regexp_matches(s, '[",\\r\\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END FROM (SELECT CASE WHEN regexp_matches({c}, '^[=+@\\t\\r-]') AND NOT regexp_matches({c}, '^[+-][0-9\\s().-]+$') THEN '''' || {c} ELSE coalesce({c}, '') END AS s) z)"""
_CASES = ["=cmd()", "+91 98765-43210", "@x, y", 'say "hi"', "-5 apples", None]
_CELLS = "SELECT doc_id, text AS v FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {S.q(c) if c else 'NULL'})" for i, c in enumerate(_CASES)) + ") AS x(doc_id, v)"


@query("csv_safe_cells", f"SELECT doc_id, {CELL('v')} AS cell FROM cells", cells=_CELLS)
def _(spark, sf):
    cases = spark.createDataFrame([(-1 - i, c) for i, c in enumerate(_CASES)], "doc_id long, text string")
    return raw(spark, sf, "documents").select("doc_id", "text").unionByName(cases).select("doc_id", sk.csv_cell(F.col("text")).alias("cell"))


def export(spark, sf):
    f = view(spark, sf, "cv_file").withColumn("drive_url", F.concat(F.lit("https://drive.example/"), "source_file_id"))
    return sk.export_rows(f.join(view(spark, sf, "candidate"), "cv_file_id", "left"), "https://app.example/")


_EXP = """SELECT f.cv_file_id, coalesce(candidate_name, 'Not Found') AS "Candidate Name", coalesce(phone_number, 'Not Found') AS "Phone Number", coalesce(job_role_applied_for, 'Not Found') AS "Job Role Applied For",
   file_name AS "CV File Name", coalesce('https://drive.example/' || source_file_id, 'https://app.example/api/cv-files/' || f.cv_file_id || '/download') AS "CV Link",
   CASE source_type WHEN 'GOOGLE_DRIVE' THEN 'Google Drive' ELSE 'Manual Upload' END AS "Source", replace(status, '_', ' ') AS "Status",
   coalesce(regexp_replace(cast(round(overall_confidence * 100) / 100 AS varchar), '\\.0$', ''), '') AS "Confidence", coalesce(strftime(processed_at, '%Y-%m-%dT%H:%M:%S.000Z'), '') AS "Processed At"
  FROM cv_file f LEFT JOIN candidate c ON c.cv_file_id = f.cv_file_id"""


@query("export_rows", "SELECT * FROM expo", expo=_EXP)
def _(spark, sf):
    return export(spark, sf)


@query("csv_export", "SELECT cv_file_id, " + " || ',' || ".join(CELL(f'"{h}"') for h in V.EXPORT_HEADERS) + " AS line FROM expo", expo=_EXP)
def _(spark, sf):
    return sk.csv_lines(export(spark, sf), V.EXPORT_HEADERS, ["cv_file_id"])


CHOICE = rp.CandidateFilters(source="MANUAL", status="PROCESSED", role="engineer", from_="1996-03-01", to="2000-12-31", q="resume")
_CHOSEN = f"""SELECT e.*, row_number() OVER (ORDER BY f.created_at DESC, f.cv_file_id) AS row_no FROM expo e JOIN cv_file f ON f.cv_file_id = e.cv_file_id
  WHERE f.workspace_id = 7 AND f.source_type = 'MANUAL' AND f.status = 'PROCESSED' AND e."Job Role Applied For" ILIKE '%engineer%' AND f.created_at >= timestamp '1996-03-01' AND f.created_at <= timestamp '2000-12-31 23:59:59.999'
  AND (f.file_name ILIKE '%resume%' OR e."Candidate Name" ILIKE '%resume%' OR e."Job Role Applied For" ILIKE '%resume%')"""


def chosen(spark, sf):
    """Scope, filters, search and order as a page shows them, then the display columns."""
    f = view(spark, sf, "cv_file").withColumn("drive_url", F.concat(F.lit("https://drive.example/"), "source_file_id"))
    rows = rp.selection(rp.scope_filter(f, rp.Session("ADMIN", 7)), view(spark, sf, "candidate"), CHOICE)
    numbered = sk.numbered(rows, *rp.ordering(CHOICE))
    return sk.export_rows(numbered, "https://app.example/").join(numbered.select("cv_file_id", "row_no"), "cv_file_id")


@query("export_filtered", "SELECT * FROM chosen", expo=_EXP, chosen=_CHOSEN)
def _(spark, sf):
    return chosen(spark, sf)


@query("csv_export_core", "SELECT row_no, " + " || ',' || ".join(CELL(f'"{h}"') for h in V.EXPORT_HEADERS[:3]) + " AS line FROM chosen", expo=_EXP, chosen=_CHOSEN)
def _(spark, sf):
    return sk.csv_lines(chosen(spark, sf), V.EXPORT_HEADERS[:3], ["row_no"])


@query("export_chunks", "SELECT n // 2000 AS chunk, (n // 2000) * 2000 + 1 AS start_row, count(*) AS rows FROM (SELECT 0 AS n UNION ALL SELECT row_number() OVER (ORDER BY created_at DESC, cv_file_id) FROM cv_file) x GROUP BY n // 2000")
def _(spark, sf):
    return sk.export_chunks(view(spark, sf, "cv_file"))


@query("export_chunk_rows", "SELECT cv_file_id, n // 2000 AS chunk, n + 1 AS sheet_row FROM (SELECT cv_file_id, row_number() OVER (ORDER BY created_at DESC, cv_file_id) AS n FROM cv_file) x")
def _(spark, sf):
    return sk.export_chunk_rows(view(spark, sf, "cv_file").select("cv_file_id", "created_at"), F.desc("created_at"), "cv_file_id").select("cv_file_id", "chunk", "sheet_row")


@query("write_candidates", """SELECT cv_file_id, workspace_id, CASE WHEN cv_file_id % 6 = 5 AND workspace_id % 5 = 2 THEN upper(candidate_name) ELSE candidate_name END AS candidate_name, phone_number
   FROM candidate JOIN (SELECT cv_file_id, workspace_id FROM cv_file) f USING (cv_file_id) WHERE cv_file_id % 5 <> 4 OR (cv_file_id % 6 = 5 AND workspace_id % 5 = 2)""")
def _(spark, sf):
    at = place(spark, "candidates")
    rows = view(spark, sf, "candidate").join(view(spark, sf, "cv_file").select("cv_file_id", "workspace_id"), "cv_file_id").select("cv_file_id", "candidate_name", "phone_number", "workspace_id")
    sk.write_candidates(rows.filter("cv_file_id % 5 <> 4"), at)
    sk.write_candidates(rows.filter("cv_file_id % 6 = 5 AND workspace_id % 5 = 2").withColumn("candidate_name", F.upper("candidate_name")), at)
    return spark.read.schema(rows.schema).parquet(at)


#: Files that a task of :func:`scan_files` writes.
OBJECTS = 500


@query("scan_files", """SELECT 's_suppkey=' || s_suppkey AS folder, strlen(s_name || s_suppkey) + 1 + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END AS size,
   sha256(CASE WHEN s_suppkey % 3 = 0 THEN '%PDF-' ELSE '' END || s_name || s_suppkey || chr(10)) AS sha256, CASE WHEN s_suppkey % 3 = 0 THEN 'application/pdf' END AS kind FROM supplier""")
def _(spark, sf):
    at = place(spark, "objects")
    s = raw(spark, sf, "supplier")
    body = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "%PDF-").otherwise(""), "s_name", F.col("s_suppkey").cast("string"))
    # one file a supplier: made by all tasks, each of which moves its own files into place
    rows = s.select("s_suppkey", body.alias("value")).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-s.count() // OBJECTS)), "s_suppkey")

    def store(part: DataFrame) -> None:
        part.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(at + "/in")

    store(rows.where("s_suppkey % 2 = 0"))
    sfiles.refresh_manifest(spark, at + "/in", at + "/m0")
    store(rows.where("s_suppkey % 2 = 1"))
    sfiles.refresh_manifest(spark, at + "/in", at + "/m1", at + "/m0")
    return spark.read.parquet(at + "/m1").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "size", "sha256", "kind")


@query("export_log", "SELECT 7 AS user_id, 'CV Export' AS sheet_title, count(*) AS row_count FROM cv_file")
def _(spark, sf):
    return sk.export_log(export(spark, sf), 7, "CV Export")
