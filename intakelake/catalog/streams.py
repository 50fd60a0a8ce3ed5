"""Registered queries: streams replayed over the tables, and their batch forms.

Streams read the table files as a file source and write to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import intake as oi, rates
from ..plans.extraction import parse_documents
from ..session import checkpointed, tuned
from ..sources.files import stream_files
from ..sources.views import raw, view
from ..streaming import dedupe, jobs as st, processors as pr
from . import intake as ci, sql as S
from .extraction import ORACLE as FIELD_ORACLE
from .out import place, plain

QUERIES, ORACLE = {}, {}
EVENTS_AS_OF = "2024-01-31 00:00:00"


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


#: Rows of one file and of one trigger in :func:`arriving`.
FILE_ROWS, TRIGGER_ROWS = 250_000, 4_000_000


def arriving(spark, sf, table: str, order: str, closing: dict[str, str] | None = None) -> DataFrame:
    """The table as files that arrive in the order of an expression, at least four triggers of them.

    ``closing`` gives columns of one more row, in a last file of its own: what comes after everything.
    """
    tuned(spark)
    at, rows = place(spark, "arriving"), raw(spark, sf, table)
    n = rows.count()
    parts = max(4, -(-n // TRIGGER_ROWS))
    files = max(1, -(-n // parts // FILE_ROWS))
    laid = checkpointed(rows.repartitionByRange(parts, F.expr(order)).withColumn("_part", F.spark_partition_id()))
    for part in range(parts):
        laid.where(F.col("_part") == part).drop("_part").repartition(files).write.mode("append").parquet(at)
    if closing:
        last = rows.agg(*[F.expr(closing.get(c, f"max({c})")).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        last.coalesce(1).write.mode("append").parquet(at)
    return stream_files(spark, at, rows.schema, glob="*.parquet", per_trigger=files)


def view_stream(spark, sf, name: str, over: str, order: str, closing: dict[str, str] | None = None) -> DataFrame:
    return view(spark, sf, name, {over: arriving(spark, sf, over, order, closing)})


@query("stream_files", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    at = place(spark, "stream_files")
    st.run_now(arriving(spark, sf, "orders", "o_orderkey").select("o_orderkey", F.col("o_orderstatus").alias("status")), at + "/out", at + "/ck").awaitTermination()
    return spark.read.parquet(at + "/out").groupBy("status").agg(F.count("*").alias("n"))


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_file_id ORDER BY ts DESC, event_id DESC) AS k FROM job_event) e WHERE k = 1"


def latest(spark, sf) -> DataFrame:
    at = place(spark, "latest")
    st.keep_newest(view_stream(spark, sf, "job_event", "events", "ts"), ["cv_file_id"], ["ts", "event_id"], at, at + "-ck").awaitTermination()
    return st.snapshot(spark.read.parquet(at).drop("batch"), ["cv_file_id"], ["ts", "event_id"])


@query("live_status_counts", "SELECT status, count(*) AS n FROM newest GROUP BY status", newest=_LATEST)
def _(spark, sf):
    at = place(spark, "live_counts")
    pr.live_counts(view_stream(spark, sf, "job_event", "events", "ts"), at, at + "-ck").awaitTermination()
    return pr.counts_after(spark, at)


@query("newest_status_counts", "SELECT status, count(*) AS n FROM newest GROUP BY status", newest=_LATEST)
def _(spark, sf):
    return st.status_counts(latest(spark, sf))


ORACLE["stream_extract"] = FIELD_ORACLE["validate_row"]


@query("stream_extract")
def _(spark, sf):
    at = place(spark, "stream_extract")
    st.each_batch(arriving(spark, sf, "orders", "o_orderkey"), lambda b: parse_documents(view(b.sparkSession, sf, "cv_text", {"orders": b})), at, at + "-ck").awaitTermination()
    return spark.read.parquet(at).select("doc_id", "candidate_name", "phone_number", "job_role_applied_for", "name_confidence", "phone_confidence",
                                         "role_confidence", "overall_confidence", "review_codes")


@query("stream_change_apply", "SELECT file_id, workspace_id, outcome FROM outc", **ci.Y)
def _(spark, sf):
    at = place(spark, "stream_change_apply")

    def judge(batch: DataFrame, known) -> tuple[DataFrame, DataFrame]:
        own = batch.sparkSession  # a micro-batch lives in its own session
        stored = view(own, sf, "cv_file").withColumn("drive_modified_at", F.col("created_at"))
        return oi.judged_changes(view(own, sf, "feed", {"orders": batch}), stored, known, view(own, sf, "ignore_list"))

    seen = st.seen_files(at + "-seen", 16)
    st.apply_changes(arriving(spark, sf, "orders", "o_orderkey"), judge, seen, at, at + "-ck").awaitTermination()
    return st.outcomes(spark, at, seen).select("file_id", "workspace_id", "outcome")


@query("stream_dedupe", "SELECT DISTINCT workspace_id, file_hash FROM cv_file")
def _(spark, sf):
    at = place(spark, "stream_dedupe")
    st.run_now(st.stream_dedupe(view_stream(spark, sf, "cv_file", "orders", "o_orderkey").select("workspace_id", "file_hash", "created_at")), at + "/out", at + "/ck").awaitTermination()
    return spark.read.parquet(at + "/out").select("workspace_id", "file_hash")


@query("stream_dedupe_stored", "SELECT workspace_id, file_hash, min(cv_file_id) AS cv_file_id FROM cv_file GROUP BY 1, 2")
def _(spark, sf):
    at = place(spark, "first_arrivals")
    files = view_stream(spark, sf, "cv_file", "orders", "o_orderkey").select("workspace_id", "file_hash", "cv_file_id")
    dedupe.first_arrivals(files, ["workspace_id", "file_hash"], ["cv_file_id"], at, at + "-ck", 16).awaitTermination()
    return dedupe.arrived(spark, at)


_SESSIONS = f"""SELECT worker_id, {S.stamp('min(ts)')} AS online_from, {S.stamp("max(ts) + interval 20 second")} AS online_until, count(*) AS beats, {S.stamp('max(ts)')} AS last_beat FROM (
   SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id) < interval 20 second THEN 0 ELSE 1 END AS fresh FROM heartbeat) a) b
  GROUP BY worker_id, g"""
#: Events in the order in which they come when each is up to ten minutes late, and one long after all others.
LATE_EVENTS, AFTER_ALL = "ts + make_interval(0, 0, 0, 0, 0, event_id % 11, 0)", {"ts": "max(ts) + interval 30 days", "user_id": "-1"}


@query("liveness", _SESSIONS)
def _(spark, sf):
    return st.liveness(view(spark, sf, "heartbeat"))


@query("liveness_stream", _SESSIONS)
def _(spark, sf):
    at = place(spark, "liveness")
    beats = view_stream(spark, sf, "heartbeat", "events", LATE_EVENTS, AFTER_ALL)
    st.run_now(st.liveness(beats, "11 minutes"), at + "/out", at + "/ck").awaitTermination()
    return spark.read.parquet(at + "/out")


_SAID = "Processing was interrupted (the server stopped mid-way)"


@query("stale_claims", f"""SELECT cv_file_id, event_id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS new_status, '{_SAID}' || CASE WHEN attempts >= 3 THEN '; no attempts left' ELSE '; retrying' END AS message
   FROM newest WHERE status = 'PROCESSING' AND ts < timestamp '{EVENTS_AS_OF}' - interval 3 minute""", newest=_LATEST)
def _(spark, sf):
    return st.stale_claims(latest(spark, sf), EVENTS_AS_OF).select("cv_file_id", "event_id", "new_status", "message")


@query("stale_claims_stream", f"""SELECT cv_file_id, event_id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS new_status, '{_SAID}' || CASE WHEN attempts >= 3 THEN '; no attempts left' ELSE '; retrying' END AS message, 'INTERRUPTED' AS error_code
   FROM (SELECT *, lead(ts) OVER (PARTITION BY cv_file_id ORDER BY ts, event_id) AS later FROM job_event) e WHERE status = 'PROCESSING' AND (later IS NULL OR later > ts + interval 3 minute)""")
def _(spark, sf):
    at = place(spark, "stale_claims")
    with pr.keyed_state(spark):
        q = st.run_now(pr.stale_claims_stream(view_stream(spark, sf, "job_event", "events", "ts", AFTER_ALL | {"event_type": "'signup'"})), at + "/out", at + "/ck")
    q.awaitTermination()
    return spark.read.parquet(at + "/out")


_WINDOWS = """SELECT * FROM (WITH RECURSIVE win AS (SELECT key, min(ts) AS s FROM request GROUP BY key
    UNION ALL SELECT w.key, (SELECT min(r.ts) FROM request r WHERE r.key = w.key AND r.ts >= w.s + interval 6 hour) AS s FROM win w WHERE w.s IS NOT NULL)
  SELECT key, event_id, n, n <= 3 AS allowed, greatest(3 - n, 0) AS remaining FROM (SELECT r.key, r.event_id, row_number() OVER (PARTITION BY r.key, w.s ORDER BY r.ts, r.event_id) AS n
    FROM request r ASOF JOIN (SELECT * FROM win WHERE s IS NOT NULL) w ON r.key = w.key AND r.ts >= w.s) x) y"""


@query("rate_windows", _WINDOWS)
def _(spark, sf):
    return rates.rate_windows(view(spark, sf, "request"), 3, 6 * 3600).select("key", "event_id", "n", "allowed", "remaining")


@query("rate_windows_stream", f"SELECT key, event_id, n, allowed FROM ({_WINDOWS}) z")
def _(spark, sf):
    at = place(spark, "rate_windows")
    live = st.rate_windows_stream(view_stream(spark, sf, "request", "events", "ts"), 3, 6 * 3600)
    st.run_now(live, at + "/out", at + "/ck").awaitTermination()
    return spark.read.parquet(at + "/out")


_DAYS = "SELECT " + S.stamp("date_trunc('day', created_at)") + " AS window_start, source_type, count(*) AS n FROM cv_file GROUP BY 1, 2"


@query("arrivals_windowed", _DAYS)
def _(spark, sf):
    return st.arrivals_windowed(view(spark, sf, "cv_file"), "1 day")


@query("arrivals_windowed_stream", _DAYS)
def _(spark, sf):
    at = place(spark, "arrivals")  # every seventh file comes about a year late
    order = "o_orderdate + make_interval(CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END)"
    st.arrivals_with_ledger(view_stream(spark, sf, "cv_file", "orders", order), "1 day", "7 days", at, at + "-ck").awaitTermination()
    return st.arrivals_so_far(spark, at).drop("late")


@query("retry_backoff", f"SELECT event_id, attempts, CASE WHEN attempts < 3 THEN 5000 * (1 << (attempts - 1)) END AS delay_ms, CASE WHEN attempts < 3 THEN {S.stamp('ts + to_milliseconds(5000 * (1 << (attempts - 1)))')} END AS next_attempt_at FROM job_event WHERE status = 'FAILED'")
def _(spark, sf):
    return st.retry_backoff(view(spark, sf, "job_event").filter("status = 'FAILED'"), 5000).select("event_id", "attempts", "delay_ms", "next_attempt_at")
