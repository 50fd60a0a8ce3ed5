"""Searches, dashboards, activity and lists over files, candidates and jobs.

Every report takes its clock (``as_of``) as an argument and starts from scoped files.
Sort orders carry their null order and a unique last key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions.phones import with_phone


@dataclass(frozen=True)
class Session:
    role: str
    workspace_id: int | None = None


@dataclass(frozen=True)
class CandidateFilters:
    q: str | None = None
    source: str | None = None
    status: str | None = None
    role: str | None = None
    from_: str | None = None
    to: str | None = None
    sort: str = "createdAt"
    order: str = "desc"
    page: int = 1
    page_size: int = 25


def scope_filter(rows: DataFrame, session: Session) -> DataFrame:
    """Rows of the session's tenant; everything for an owner without one; an error for anyone else."""
    if session.workspace_id is not None:
        return rows.filter(F.col("workspace_id") == session.workspace_id)
    if session.role == "OWNER":
        return rows
    raise PermissionError("This account is not attached to a client workspace")


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def _has(col: str, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(part.lower()))


def candidate_filter(rows: DataFrame, f: CandidateFilters) -> DataFrame:
    if f.source:
        rows = rows.filter(F.col("source_type") == f.source)
    if f.status:
        rows = rows.filter(F.col("status") == f.status)
    if f.role:
        rows = rows.filter(_has("job_role_applied_for", f.role))
    if f.from_:
        rows = rows.filter(F.col("created_at") >= _ts(f.from_))
    if f.to:
        rows = rows.filter(F.col("created_at") <= _ts(f.to + " 23:59:59.999" if len(f.to) == 10 else f.to))
    return candidate_search(rows, f.q) if f.q else rows


def search_digits(q: str) -> str | None:
    """What a search looks for among phone numbers: the normal form of a valid Indian or international number, else its digits."""
    digits = "".join(c for c in q if c in "0123456789")
    return digits if len(digits) >= 4 else None


def candidate_search(rows: DataFrame, q: str) -> DataFrame:
    q = q.strip()
    hit = _has("file_name", q) | _has("candidate_name", q) | _has("job_role_applied_for", q)
    digits = search_digits(q)
    if digits is None:
        return rows.filter(hit)
    probe = with_phone(rows.withColumn("_q", F.lit(q)), "_q", "_p")
    wanted = F.when(F.col("_p_valid"), F.col("_p")).otherwise(digits)
    hit = hit | F.contains(F.coalesce("phone_number", F.lit("")), wanted)
    return probe.filter(hit).drop("_q", "_p", "_p_valid", "_p_country", "_p_reason")


def with_candidates(files: DataFrame, candidates: DataFrame) -> DataFrame:
    return files.join(candidates, "cv_file_id", "left")


def parse_count(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs that finished with a result, per file; jobs are counted before they are joined."""
    runs = jobs.filter(F.col("status").isin(*V.PARSED_STATUSES)).groupBy("cv_file_id").agg(F.count("*").alias("parse_count"))
    return files.join(runs, "cv_file_id", "left").withColumn("parse_count", F.coalesce("parse_count", F.lit(0)))


SORTS = {"createdAt": "created_at", "processedAt": "processed_at", "candidateName": "candidate_name", "overallConfidence": "overall_confidence"}


def ordering(f: CandidateFilters) -> list[Column]:
    c = F.col(SORTS[f.sort])
    if f.order == "asc":
        first = c.asc_nulls_last()
    else:
        first = c.desc_nulls_last() if f.sort == "processedAt" else c.desc_nulls_first()
    return [first, F.col("cv_file_id").asc()]


#: Sorts on columns that only candidates have.
CANDIDATE_SORTS = {"processedAt", "candidateName", "overallConfidence"}


def selection(files: DataFrame, candidates: DataFrame, f: CandidateFilters) -> DataFrame:
    """The filtered files; joined with their candidates only where a filter asks for them."""
    return candidate_filter(with_candidates(files, candidates) if f.role or f.q else files, f)


def candidate_page(files: DataFrame, candidates: DataFrame, f: CandidateFilters) -> DataFrame:
    """One page in order. Sorted by a file column, files are cut before they meet their candidates."""
    cut = lambda rows: rows.orderBy(*ordering(f)).offset((f.page - 1) * f.page_size).limit(f.page_size)
    rows = selection(files, candidates, f)
    if f.role or f.q:
        return cut(rows)
    if f.sort in CANDIDATE_SORTS:
        return cut(with_candidates(rows, candidates))
    page = cut(rows)
    return with_candidates(page, _of(candidates, page)).orderBy(*ordering(f))


def _after(f: CandidateFilters, value: str | float | None, cv_file_id: int) -> Column:
    """Rows that come behind a given one in the order of ``f``; the value may be null."""
    c, later = F.col(SORTS[f.sort]), F.col("cv_file_id") > cv_file_id
    nulls_last = f.order == "asc" or f.sort == "processedAt"
    if value is None:
        behind = c.isNull() & later
        return behind if nulls_last else behind | c.isNotNull()
    at = _ts(value) if f.sort in ("createdAt", "processedAt") else F.lit(value)
    behind = ((c > at) if f.order == "asc" else (c < at)) | ((c == at) & later)
    return F.coalesce(behind | c.isNull() if nulls_last else behind, F.lit(nulls_last))


def candidate_page_after(files: DataFrame, candidates: DataFrame, f: CandidateFilters, value: str | float | None, cv_file_id: int) -> DataFrame:
    """The page after the row of this id and value of the sort column: the same cost however deep it lies."""
    if f.sort in CANDIDATE_SORTS:
        rows = selection(files, candidates, f)
        rows = rows if f.role or f.q else with_candidates(rows, candidates)
        return rows.where(_after(f, value, cv_file_id)).orderBy(*ordering(f)).limit(f.page_size)
    return candidate_page(files.filter(_after(f, value, cv_file_id)), candidates, replace(f, page=1))


def _of(candidates: DataFrame, page: DataFrame) -> DataFrame:
    """The candidates of a page's few files."""
    return candidates.join(F.broadcast(page.select("cv_file_id")), "cv_file_id", "left_semi")


def page_totals(files: DataFrame, candidates: DataFrame, f: CandidateFilters) -> DataFrame:
    n = F.count("*")
    return selection(files, candidates, f).agg(n.alias("total"), F.greatest(F.ceil(n / f.page_size), F.lit(1)).alias("pages"))


def candidate_iterate(rows: DataFrame, f: CandidateFilters) -> DataFrame:
    """The whole selection in order: one range-partitioned sort, no paging."""
    return rows.orderBy(*ordering(f))


def candidate_detail(rows: DataFrame, jobs: DataFrame, cv_file_id: int) -> DataFrame:
    """One file of the scope with its ten newest jobs."""
    one = rows.filter(F.col("cv_file_id") == cv_file_id)
    last = jobs.filter(F.col("cv_file_id") == cv_file_id).orderBy(F.desc("created_at"), "job_id").limit(10)
    ten = last.groupBy("cv_file_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "job_id", "status")), asc=False).alias("jobs"))
    return one.join(ten, "cv_file_id", "left")


def top_roles(candidates: DataFrame, files: DataFrame, n: int = 50) -> DataFrame:
    kept = candidates.filter(F.col("job_role_applied_for") != V.NOT_FOUND).join(files.select("cv_file_id"), "cv_file_id", "left_semi")
    return kept.groupBy(F.col("job_role_applied_for").alias("role")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(n)


def _by_status() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s.lower()) for s in V.STATUSES]


def _since(as_of: str, **ago) -> Column:
    return F.lit(str(datetime.fromisoformat(as_of) - timedelta(**ago))).cast("timestamp")


def dashboard_stats(files: DataFrame, as_of: str) -> DataFrame:
    src = lambda s: F.count_if(F.col("source_type") == s)
    return files.agg(
        F.count("*").alias("total"), *_by_status(), src("MANUAL").alias("manual"), src("GOOGLE_DRIVE").alias("google_drive"),
        F.count_if(F.col("created_at") >= _since(as_of, hours=24)).alias("last_24h"))


def recent_files(files: DataFrame, candidates: DataFrame | None = None, n: int = 8) -> DataFrame:
    """The newest files, cut before they meet their candidates."""
    order = [F.desc("created_at"), F.col("cv_file_id")]
    top = files.orderBy(*order).limit(n)
    return top if candidates is None else with_candidates(top, _of(candidates, top)).orderBy(*order)


def job_list(jobs: DataFrame, files: DataFrame, batch_id: str | None = None, status: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    if batch_id:
        jobs = jobs.filter(F.col("batch_id") == batch_id)
    if status:
        jobs = jobs.filter(F.col("status") == status)
    f = files.select("cv_file_id", "file_name", "source_type", F.col("status").alias("file_status"))
    return jobs.join(f, "cv_file_id").orderBy(F.desc("created_at"), "job_id").offset((page - 1) * page_size).limit(page_size)


def batch_progress(files: DataFrame, jobs: DataFrame, as_of: str, batch_id: str | None = None) -> DataFrame:
    """Counts of distinct files with some job of the batch, or of the last 24 hours."""
    mine = jobs.filter(F.col("batch_id") == batch_id) if batch_id else jobs.filter(F.col("created_at") >= _since(as_of, hours=24))
    done = F.count_if(F.col("status").isin("PROCESSED", "NEEDS_REVIEW", "FAILED", "SKIPPED")).alias("done")
    return files.join(mine.select("cv_file_id"), "cv_file_id", "left_semi").agg(F.count("*").alias("total"), done, *_by_status())


def zone_or_utc(zone: str | None) -> str:
    return zone if zone and zone in available_timezones() else "UTC"


def day_bounds(first: str, last: str, zone: str) -> tuple[Column, Column]:
    """UTC instants of the first local midnight and of the midnight after the last day, as literals."""
    tz = ZoneInfo(zone)

    def at(day: date) -> Column:
        local = datetime(day.year, day.month, day.day, tzinfo=tz)
        return F.lit(local.astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    return at(date.fromisoformat(first)), at(date.fromisoformat(last) + timedelta(days=1))


def activity_by_day(files: DataFrame, first: str, last: str, zone: str | None) -> DataFrame:
    """Files per calendar day of the viewer's zone. Bounds are literals, so the bare column prunes the scan."""
    tz = zone_or_utc(zone)
    lo, hi = day_bounds(first, last, tz)
    day = F.date_format(F.from_utc_timestamp("created_at", tz), "yyyy-MM-dd").alias("day")
    src = lambda s: F.count_if(F.col("source_type") == s)
    return (
        files.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi)).groupBy(day)
        .agg(F.count("*").alias("total"), src("MANUAL").alias("manual"), src("GOOGLE_DRIVE").alias("drive"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        .orderBy(F.desc("day"))
    )


def activity_summary(files: DataFrame, as_of: str, first: str, last: str, zone: str | None) -> DataFrame:
    lo, hi = day_bounds(first, last, zone_or_utc(zone))
    at = F.col("created_at")
    return files.agg(
        F.count("*").alias("all_time"), F.count_if(at >= _since(as_of, days=7)).alias("last_7_days"), F.count_if(at >= _since(as_of, days=30)).alias("last_30_days"),
        F.max(at).alias("last_fetched_at"), F.count_if((at >= lo) & (at < hi)).alias("in_range"))


def activity_day_files(files: DataFrame, users: DataFrame, workspaces: DataFrame, candidates: DataFrame, jobs: DataFrame, day: str, zone: str | None) -> DataFrame:
    """Every file of one local day, with uploader, tenant, candidate and parse count. Order and pages are the caller's."""
    lo, hi = day_bounds(day, day, zone_or_utc(zone))
    at = F.col("created_at")
    listed = files.filter((at >= lo) & (at < hi))
    return (
        parse_count(listed, jobs.join(listed.select("cv_file_id"), "cv_file_id", "left_semi"))
        .join(users.select(F.col("user_id").alias("uploaded_by"), F.col("name").alias("uploader")), "uploaded_by", "left")
        .join(workspaces.select("workspace_id", F.col("name").alias("workspace")), "workspace_id", "left")
        .join(candidates.select("cv_file_id", "candidate_name"), "cv_file_id", "left")
    )


def activity_day_clients(files: DataFrame, workspaces: DataFrame, day: str, zone: str | None) -> DataFrame:
    """Files of one local day for each tenant, counted before the tenants' names are joined."""
    lo, hi = day_bounds(day, day, zone_or_utc(zone))
    n = files.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi)).groupBy("workspace_id").agg(F.count("*").alias("n"))
    return n.join(workspaces.select("workspace_id", F.col("name").alias("workspace")), "workspace_id", "left").select("workspace_id", "workspace", "n").orderBy(F.desc("n"), "workspace_id")


def workspace_list(workspaces: DataFrame, users: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """Every tenant with its people, files, first administrator and latest activity; each side aggregated before its join."""
    u = users.groupBy("workspace_id").agg(F.count("*").alias("users"))
    admin = users.filter(F.col("role") == "ADMIN").groupBy("workspace_id").agg(F.min_by("name", F.struct("created_at", "user_id")).alias("contact"))
    f = files.groupBy("workspace_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("created_at") >= _since(as_of, days=7)).alias("last_7_days"), F.max("created_at").alias("last_fetched_at"))
    out = workspaces.join(u, "workspace_id", "left").join(admin, "workspace_id", "left").join(f, "workspace_id", "left")
    return out.fillna(0, ["users", "files", "last_7_days"]).orderBy(F.desc("created_at"), "workspace_id")


def user_list(users: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, V.USER_ROLES)), F.col("role"))
    return users.orderBy(rank, "name", "user_id")


def pending_signups(requests: DataFrame, as_of: str) -> DataFrame:
    return requests.filter(~F.col("consumed") & (F.col("created_at") >= _since(as_of, days=7))).orderBy(F.desc("created_at"), "request_id")


def status_overview(files: DataFrame, jobs: DataFrame) -> DataFrame:
    count = lambda df, t: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(t).alias("source"), "status", "n")
    return count(files, "file").unionByName(count(jobs, "job"))


def failure_reasons(jobs: DataFrame) -> DataFrame:
    """Failed jobs per code, with the newest job as a sample."""
    return jobs.filter(F.col("status") == "FAILED").groupBy(F.coalesce("error_code", F.lit("(none)")).alias("code")).agg(
        F.count("*").alias("n"), F.max_by("job_id", F.struct("created_at", "job_id")).alias("newest_job"))


def pending_age(jobs: DataFrame, as_of: str) -> DataFrame:
    seconds = F.unix_timestamp(_ts(as_of)) - F.unix_timestamp("created_at")
    return jobs.filter(F.col("status").isin(*V.ACTIVE_STATUSES)).withColumn("age_minutes", F.round(seconds.cast("decimal(20,3)") / 60, 1).cast("double")).orderBy("created_at", "job_id")


def latest_job(jobs: DataFrame) -> DataFrame:
    newest = F.max(F.struct("created_at", "job_id", "status")).alias("j")
    return jobs.groupBy("cv_file_id").agg(newest).select("cv_file_id", "j.job_id", "j.status", "j.created_at")


def review_causes(candidates: DataFrame) -> DataFrame:
    codes = candidates.select(F.explode("review_codes").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def engine_mix(candidates: DataFrame) -> DataFrame:
    avg = (F.sum("extraction_ms").cast("double") / F.count("*")).alias("avg_ms")
    return candidates.groupBy("extraction_engine", "extraction_version").agg(F.count("*").alias("n"), avg)
