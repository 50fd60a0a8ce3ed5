"""Registered queries: relational reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import values as V
from ..operators import reports as op
from ..operators.reports import CandidateFilters, Session
from ..sources.views import view
from . import sql as S
from .out import plain

QUERIES, ORACLE = {}, {}
TENANT, OWNER = Session("ADMIN", 7), Session("OWNER")
AS_OF = f"timestamp '{V.AS_OF}'"
ST = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in V.STATUSES)


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


def files(spark, sf, session=OWNER):
    return op.scope_filter(view(spark, sf, "cv_file"), session)


def jobs(spark, sf):
    return view(spark, sf, "processing_job")


def rows(spark, sf, session=OWNER):
    return op.with_candidates(files(spark, sf, session), view(spark, sf, "candidate"))


_ROWS = "SELECT f.*, c.* EXCLUDE (cv_file_id) FROM cv_file f LEFT JOIN candidate c ON c.cv_file_id = f.cv_file_id"
SHOW = ["cv_file_id", "workspace_id", "source_type", "file_name", "status", "created_at", "candidate_name", "phone_number", "job_role_applied_for", "overall_confidence"]
SHOW_SQL = ", ".join(S.stamp(c) + f" AS {c}" if c == "created_at" else c for c in SHOW)


@query("scope_filter", "SELECT cv_file_id, workspace_id, file_name FROM cv_file WHERE workspace_id = 7")
def _(spark, sf):
    return files(spark, sf, TENANT).select("cv_file_id", "workspace_id", "file_name")


F1 = CandidateFilters(source="MANUAL", status="PROCESSED", role="ENGINEER", from_="1996-03-01", to="2000-12-31")


@query("candidate_filter", f"""SELECT {SHOW_SQL} FROM allrows WHERE source_type = 'MANUAL' AND status = 'PROCESSED' AND job_role_applied_for ILIKE '%engineer%'
  AND created_at >= timestamp '1996-03-01' AND created_at <= timestamp '2000-12-31 23:59:59.999'""", allrows=_ROWS)
def _(spark, sf):
    return op.candidate_filter(rows(spark, sf), F1).select(SHOW)


@query("candidate_search", f"SELECT {SHOW_SQL} FROM allrows WHERE file_name ILIKE '%verghese%' OR candidate_name ILIKE '%verghese%' OR job_role_applied_for ILIKE '%verghese%'", allrows=_ROWS)
def _(spark, sf):
    return op.candidate_search(rows(spark, sf), "verghese").select(SHOW)


@query("candidate_search_phone", f"SELECT {SHOW_SQL} FROM allrows WHERE file_name ILIKE '%60000%' OR candidate_name ILIKE '%60000%' OR job_role_applied_for ILIKE '%60000%' OR phone_number LIKE '%60000%'", allrows=_ROWS)
def _(spark, sf):
    return op.candidate_search(rows(spark, sf), " 60000 ").select(SHOW)


@query("parse_count", "SELECT cv_file_id, (SELECT count(*) FROM processing_job j WHERE j.cv_file_id = f.cv_file_id AND j.status IN ('PROCESSED', 'NEEDS_REVIEW')) AS parse_count FROM cv_file f")
def _(spark, sf):
    return op.parse_count(files(spark, sf), jobs(spark, sf)).select("cv_file_id", "parse_count")


def after_the_second_page(spark, sf, f):
    """The third page, from the last row of the second."""
    given, candidates = files(spark, sf, TENANT), view(spark, sf, "candidate")
    last = op.candidate_page(given, candidates, replace(f, page=2)).select(F.col(op.SORTS[f.sort]).cast("double" if f.sort == "overallConfidence" else "string").alias("v"), "cv_file_id").collect()[-1:]
    return op.candidate_page_after(given, candidates, f, last[0].v, last[0].cv_file_id) if last else op.candidate_page(given, candidates, f)


for _sort, _col in op.SORTS.items():
    for _order in ("asc", "desc"):
        _f = CandidateFilters(sort=_sort, order=_order, page=3, page_size=25)
        _nulls = "LAST" if _order == "asc" or _sort == "processedAt" else "FIRST"
        query(f"candidate_page_{_col}_{_order}", f"SELECT {SHOW_SQL} FROM allrows WHERE workspace_id = 7 ORDER BY allrows.{_col} {_order} NULLS {_nulls}, cv_file_id LIMIT 25 OFFSET 50", allrows=_ROWS)(
            lambda spark, sf, f=_f: op.candidate_page(files(spark, sf, TENANT), view(spark, sf, "candidate"), f).select(SHOW))
        query(f"candidate_page_after_{_col}_{_order}", f"SELECT {SHOW_SQL} FROM allrows WHERE workspace_id = 7 ORDER BY allrows.{_col} {_order} NULLS {_nulls}, cv_file_id LIMIT 25 OFFSET 50", allrows=_ROWS)(
            lambda spark, sf, f=_f: after_the_second_page(spark, sf, f).select(SHOW))


@query("candidate_page", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 25.0))::bigint AS pages FROM allrows WHERE workspace_id = 7 AND status = 'NEEDS_REVIEW'", allrows=_ROWS)
def _(spark, sf):
    f = CandidateFilters(status="NEEDS_REVIEW")
    return op.page_totals(files(spark, sf, TENANT), view(spark, sf, "candidate"), f)


@query("candidate_page_after", f"SELECT {SHOW_SQL} FROM allrows WHERE workspace_id = 7 AND (allrows.created_at, -cv_file_id) < (timestamp '1998-06-10 12:00:00', -1) ORDER BY allrows.created_at DESC, cv_file_id LIMIT 25", allrows=_ROWS)
def _(spark, sf):
    return op.candidate_page_after(files(spark, sf, TENANT), view(spark, sf, "candidate"), CandidateFilters(), "1998-06-10 12:00:00", 1).select(SHOW)


@query("candidate_iterate", f"SELECT {SHOW_SQL} FROM allrows", allrows=_ROWS)
def _(spark, sf):
    return op.candidate_iterate(rows(spark, sf), CandidateFilters()).select(SHOW)


@query("candidate_detail", """SELECT f.cv_file_id, f.file_name, f.status, c.candidate_name, (SELECT string_agg(job_id || ':' || status, ' | ' ORDER BY created_at DESC, job_id DESC) FROM
   (SELECT * FROM processing_job j WHERE j.cv_file_id = 77 ORDER BY created_at DESC, job_id LIMIT 10) x) AS jobs FROM cv_file f LEFT JOIN candidate c ON c.cv_file_id = f.cv_file_id WHERE f.cv_file_id = 77""")
def _(spark, sf):
    d = op.candidate_detail(rows(spark, sf), jobs(spark, sf), 77)
    shown = F.array_join(F.transform("jobs", lambda j: F.concat(j["job_id"], F.lit(":"), j["status"])), " | ")
    return d.select("cv_file_id", "file_name", "status", "candidate_name", shown.alias("jobs"))


@query("top_roles", "SELECT job_role_applied_for AS role, count(*) AS n FROM candidate c JOIN cv_file f ON f.cv_file_id = c.cv_file_id WHERE job_role_applied_for <> 'Not Found' GROUP BY 1 ORDER BY n DESC, role LIMIT 50")
def _(spark, sf):
    return op.top_roles(view(spark, sf, "candidate"), files(spark, sf))


@query("dashboard_stats", f"SELECT count(*) AS total, {ST}, count(*) FILTER (source_type = 'MANUAL') AS manual, count(*) FILTER (source_type = 'GOOGLE_DRIVE') AS google_drive, count(*) FILTER (created_at >= {AS_OF} - interval 1 day) AS last_24h FROM cv_file")
def _(spark, sf):
    return op.dashboard_stats(files(spark, sf), V.AS_OF)


@query("recent_files", f"SELECT {SHOW_SQL} FROM allrows ORDER BY allrows.created_at DESC, cv_file_id LIMIT 8", allrows=_ROWS)
def _(spark, sf):
    return op.recent_files(files(spark, sf), view(spark, sf, "candidate")).select(SHOW)


@query("job_list", f"""SELECT job_id, j.cv_file_id, j.status, j.error_code, {S.stamp('j.created_at')} AS created_at, file_name, f.status AS file_status FROM processing_job j JOIN cv_file f ON f.cv_file_id = j.cv_file_id
  WHERE workspace_id = 7 AND j.status = 'FAILED' ORDER BY j.created_at DESC, job_id LIMIT 50""")
def _(spark, sf):
    return op.job_list(jobs(spark, sf), files(spark, sf, TENANT), status="FAILED").select("job_id", "cv_file_id", "status", "error_code", "created_at", "file_name", "file_status")


_PROG = f"SELECT count(*) AS total, count(*) FILTER (status IN ('PROCESSED', 'NEEDS_REVIEW', 'FAILED', 'SKIPPED')) AS done, {ST} FROM cv_file WHERE cv_file_id IN (SELECT cv_file_id FROM processing_job WHERE "


@query("batch_progress", _PROG + "batch_id = 'batch_3')")
def _(spark, sf):
    return op.batch_progress(files(spark, sf), jobs(spark, sf), V.AS_OF, "batch_3")


@query("batch_progress_recent", _PROG + f"created_at >= {AS_OF} - interval 1 day)")
def _(spark, sf):
    return op.batch_progress(files(spark, sf), jobs(spark, sf), V.AS_OF)




def _at(day: str, zone: str) -> str:
    return f"((timestamp '{day} 00:00:00' AT TIME ZONE '{zone}') AT TIME ZONE 'UTC')"


def _range(a: str, b: str, zone: str) -> str:
    return f"created_at >= {_at(a, zone)} AND created_at < {_at(b, zone)}"


@query("activity_by_day", f"""SELECT strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (source_type = 'MANUAL') AS manual,
   count(*) FILTER (source_type = 'GOOGLE_DRIVE') AS drive, {S.stamp('min(created_at)')} AS first, {S.stamp('max(created_at)')} AS last FROM cv_file WHERE {_range('1997-02-01', '1999-04-01', 'Asia/Kolkata')} GROUP BY 1""")
def _(spark, sf):
    return op.activity_by_day(files(spark, sf), "1997-02-01", "1999-03-31", "Asia/Kolkata")


@query("activity_by_day_tenant", f"""SELECT strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (source_type = 'MANUAL') AS manual,
   count(*) FILTER (source_type = 'GOOGLE_DRIVE') AS drive, {S.stamp('min(created_at)')} AS first, {S.stamp('max(created_at)')} AS last FROM cv_file WHERE workspace_id = 7 AND {_range('1996-01-01', '2001-01-01', 'America/New_York')} GROUP BY 1""")
def _(spark, sf):
    return op.activity_by_day(files(spark, sf, TENANT), "1996-01-01", "2000-12-31", "America/New_York")


@query("activity_summary", f"""SELECT count(*) AS all_time, count(*) FILTER (created_at >= {AS_OF} - interval 7 day) AS last_7_days, count(*) FILTER (created_at >= {AS_OF} - interval 30 day) AS last_30_days,
   {S.stamp('max(created_at)')} AS last_fetched_at, count(*) FILTER ({_range('2001-07-01', '2001-08-01', 'Asia/Kolkata')}) AS in_range FROM cv_file""")
def _(spark, sf):
    return op.activity_summary(files(spark, sf), V.AS_OF, "2001-07-01", "2001-07-31", "Asia/Kolkata")


@query("zone_or_utc", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total FROM cv_file GROUP BY 1")
def _(spark, sf):
    return op.activity_by_day(files(spark, sf), "1990-01-01", "2010-12-31", "Mars/Olympus").select("day", "total")


def day_files(spark, sf):
    w = lambda n: view(spark, sf, n)
    return op.activity_day_files(files(spark, sf), w("app_user"), w("workspace"), w("candidate"), jobs(spark, sf), "1998-06-10", "Asia/Kolkata")


_DAY = f"""SELECT f.cv_file_id, f.file_name, f.status, f.created_at, f.workspace_id, u.name AS uploader, w.name AS workspace, c.candidate_name,
   (SELECT count(*) FROM processing_job j WHERE j.cv_file_id = f.cv_file_id AND j.status IN ('PROCESSED', 'NEEDS_REVIEW')) AS parse_count
  FROM (SELECT * FROM cv_file WHERE {_range('1998-06-10', '1998-06-11', 'Asia/Kolkata')} ) f
  LEFT JOIN app_user u ON u.user_id = f.uploaded_by LEFT JOIN workspace w ON w.workspace_id = f.workspace_id LEFT JOIN candidate c ON c.cv_file_id = f.cv_file_id"""


@query("activity_day_files", f"SELECT cv_file_id, file_name, status, {S.stamp('created_at')} AS created_at, uploader, workspace, candidate_name, parse_count FROM dayf", dayf=_DAY)
def _(spark, sf):
    return day_files(spark, sf).select("cv_file_id", "file_name", "status", "created_at", "uploader", "workspace", "candidate_name", "parse_count")


@query("activity_day_clients", "SELECT workspace_id, workspace, count(*) AS n FROM dayf GROUP BY ALL", dayf=_DAY)
def _(spark, sf):
    return op.activity_day_clients(files(spark, sf), view(spark, sf, "workspace"), "1998-06-10", "Asia/Kolkata")


@query("workspace_list", f"""SELECT w.workspace_id, w.name, w.slug, w.is_active, {S.stamp('w.created_at')} AS created_at, (SELECT count(*) FROM app_user u WHERE u.workspace_id = w.workspace_id) AS users,
   (SELECT name FROM app_user u WHERE u.workspace_id = w.workspace_id AND role = 'ADMIN' ORDER BY created_at, user_id LIMIT 1) AS contact, count(f.cv_file_id) AS files,
   count(*) FILTER (f.created_at >= {AS_OF} - interval 7 day) AS last_7_days, {S.stamp('max(f.created_at)')} AS last_fetched_at
  FROM workspace w LEFT JOIN cv_file f ON f.workspace_id = w.workspace_id GROUP BY ALL""")
def _(spark, sf):
    return op.workspace_list(view(spark, sf, "workspace"), view(spark, sf, "app_user"), files(spark, sf), V.AS_OF)


@query("user_list", f"SELECT user_id, workspace_id, name, role, {S.stamp('created_at')} AS created_at FROM app_user WHERE workspace_id = 7")
def _(spark, sf):
    return op.user_list(op.scope_filter(view(spark, sf, "app_user"), TENANT))


@query("pending_signups", f"SELECT request_id, name, {S.stamp('created_at')} AS created_at, attempts FROM signup_request WHERE NOT consumed AND created_at >= {AS_OF} - interval 7 day")
def _(spark, sf):
    return op.pending_signups(view(spark, sf, "signup_request"), V.AS_OF).select("request_id", "name", "created_at", "attempts")


@query("status_overview", "SELECT 'file' AS source, status, count(*) AS n FROM cv_file GROUP BY status UNION ALL SELECT 'job', status, count(*) FROM processing_job GROUP BY status")
def _(spark, sf):
    return op.status_overview(files(spark, sf), jobs(spark, sf))


@query("failure_reasons", "SELECT coalesce(error_code, '(none)') AS code, count(*) AS n, arg_max(job_id, struct_pack(a := created_at, b := job_id)) AS newest_job FROM processing_job WHERE status = 'FAILED' GROUP BY 1")
def _(spark, sf):
    return op.failure_reasons(jobs(spark, sf))


@query("pending_age", f"SELECT job_id, status, attempts, cast(round(cast(epoch({AS_OF}) - epoch(created_at) AS decimal(20,3)) / 60, 1) AS double) AS age_minutes FROM processing_job WHERE status IN ('PENDING', 'PROCESSING')")
def _(spark, sf):
    return op.pending_age(jobs(spark, sf), V.AS_OF).select("job_id", "status", "attempts", "age_minutes")


@query("latest_job", f"SELECT cv_file_id, job_id, status, {S.stamp('created_at')} AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY cv_file_id ORDER BY created_at DESC, job_id DESC) AS n FROM processing_job) j WHERE n = 1")
def _(spark, sf):
    return op.latest_job(jobs(spark, sf))


@query("review_causes", "SELECT code, count(*) AS n FROM (SELECT unnest(review_codes) AS code FROM candidate) c GROUP BY code")
def _(spark, sf):
    return op.review_causes(view(spark, sf, "candidate"))


@query("engine_mix", "SELECT extraction_engine, extraction_version, count(*) AS n, cast(sum(extraction_ms) AS double) / count(*) AS avg_ms FROM candidate GROUP BY ALL")
def _(spark, sf):
    return op.engine_mix(view(spark, sf, "candidate"))
