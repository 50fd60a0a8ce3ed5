"""Streams replayed in small triggers give the batch answer."""

from __future__ import annotations

import os
import random
import re
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from intakelake.operators import rates
from intakelake.session import tuned
from intakelake.sources.files import stream_files
from intakelake.sources.views import view
from intakelake.streaming import dedupe, jobs as st, processors as pr
from intakelake.streaming.store import KeyedStore

SF = "/root/testdata/sf0.001"


def replay(spark, df: DataFrame, order: str, parts: int) -> DataFrame:
    """The table as a stream of ``parts`` files, one per trigger, in order."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, chunk in enumerate(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()).orderBy(order).toPandas().groupby("_p")):
        spark.createDataFrame(chunk[1].drop(columns="_p"), df.schema).coalesce(1).write.parquet(f"{path}/x{i}")
        one = [f for f in os.listdir(f"{path}/x{i}") if f.endswith(".parquet")][0]
        os.utime(f"{path}/x{i}/{one}", (1_700_000_000 + i, 1_700_000_000 + i))
    return stream_files(spark, path + "/x*", df.schema, per_trigger=1)


def arrive(spark, frames: list[DataFrame]) -> DataFrame:
    """Frames as files that come one after another, one per trigger."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{path}/x{i}")
        one = [f for f in os.listdir(f"{path}/x{i}") if f.endswith(".parquet")][0]
        os.utime(f"{path}/x{i}/{one}", (1_700_000_000 + i, 1_700_000_000 + i))
    return stream_files(spark, path + "/x*", frames[0].schema, per_trigger=1)


def drain(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    name = "m" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).start()
    q.awaitTermination()
    return spark.table(name)


def test_newest_status_per_file(spark):
    e = view(tuned(spark), SF, "job_event")
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = st.keep_newest(replay(spark, e, "ts", 4), ["cv_file_id"], ["ts", "event_id"], at + "/t", at + "/c")
    q.awaitTermination()
    assert sum(d.startswith("batch=") for d in os.listdir(at + "/t")) == 4
    now = st.snapshot(spark.read.parquet(at + "/t").drop("batch"), ["cv_file_id"], ["ts", "event_id"])
    assert spark.read.parquet(at + "/t/batch=3").count() <= e.count() // 3  # a trigger writes what it changed
    got = {tuple(r) for r in st.status_counts(now).collect()}
    want = e.groupBy("cv_file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    assert got == {tuple(r) for r in st.status_counts(want).collect()}


def test_counts_are_right_after_each_trigger(spark):
    e = view(tuned(spark), SF, "job_event").withColumn("cv_file_id", F.col("cv_file_id") % 400)
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pr.live_counts(replay(spark, e, "ts", 4), at + "/t", at + "/c").awaitTermination()
    cuts = e.repartitionByRange(4, "ts").withColumn("_p", F.spark_partition_id())
    for k in range(4):
        want = cuts.where(F.col("_p") <= k).groupBy("cv_file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status")).groupBy("status").count()
        assert {tuple(r) for r in pr.counts_after(spark, at + "/t", k).collect()} == {tuple(r) for r in want.collect()}, k
    # an older event, or one of the same status, changes nothing; state is one row a file
    rows = [[(1, 1, "PENDING", "2024-01-01"), (2, 2, "PENDING", "2024-01-01")], [(3, 1, "FAILED", "2024-01-03")], [(4, 1, "PENDING", "2024-01-02"), (5, 2, "PENDING", "2024-01-05")]]
    frames = [spark.createDataFrame(x, "event_id long, cv_file_id long, status string, t string").withColumn("ts", F.to_timestamp("t")).drop("t") for x in rows]
    q = pr.live_counts(arrive(spark, frames), at + "/t2", at + "/c2")
    q.awaitTermination()
    assert [{tuple(r) for r in pr.counts_after(spark, at + "/t2", k).collect()} for k in range(3)] == [{("PENDING", 2)}, {("PENDING", 1), ("FAILED", 1)}, {("PENDING", 1), ("FAILED", 1)}]
    assert max(x.numRowsTotal for p in q.recentProgress for x in p.stateOperators) == 2


def rate_windows_by_hand(rows, limit, seconds):
    out, begun = set(), {}
    for key, ts, event in sorted(rows):
        start, n = begun.get(key, (None, 0))
        if start is None or (ts - start).total_seconds() >= seconds:
            start, n = ts, 0
        begun[key] = (start, n + 1)
        out.add((key, event, start, n + 1, n < limit))
    return out


def test_rate_windows_by_hand(spark):
    rng, day = random.Random(7), datetime(2024, 1, 1)
    rows = [(1, day + timedelta(seconds=rng.randrange(40_000)), i) for i in range(4000)]  # one busy key that never pauses
    rows += [(rng.randrange(2, 30), day + timedelta(seconds=rng.randrange(900) * 10, microseconds=rng.randrange(2)), 5000 + i) for i in range(1500)]
    rows += [(40, day + timedelta(seconds=60 * i), 8000 + i) for i in range(50)] + [(41, day, 9000), (41, day, 9001), (42, day + timedelta(days=900), 9002), (42, day, 9003)]
    given = spark.createDataFrame(rows, "key long, ts timestamp, event_id long")
    for seconds in (60, 7, 3600):
        got = {(r.key, r.event_id, r.window_start, r.n, r.allowed) for r in rates.rate_windows(given, 3, seconds).collect()}
        assert got == rate_windows_by_hand(rows, 3, seconds)
    assert rates.rate_windows(given.limit(0), 3, 60).count() == 0


def test_a_busy_key_is_dealt_over_tasks(spark):
    busy = spark.range(60_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 5).alias("ts"))
    out = rates.rate_windows(busy, 3, 60)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("MapIn|Python|Pandas|Arrow", plan)
    starts = rates.window_starts(busy, 60)
    assert starts.count() == 5000
    links = rates._links(rates._moments(busy, 60_000_000), 60_000_000)
    sizes = [r["count"] for r in links.repartition(8, "key", "to").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_rate_windows(spark):
    q = view(spark, SF, "request")
    batch = {(r.key, r.event_id, r.n, r.allowed) for r in rates.rate_windows(q, 3, 6 * 3600).collect()}
    live = {(r.key, r.event_id, r.n, r.allowed) for r in drain(spark, st.rate_windows_stream(replay(spark, q, "ts", 4), 3, 6 * 3600)).collect()}
    assert batch == live


def test_late_arrivals_go_to_the_ledger(spark):
    f = view(spark, SF, "cv_file").select("created_at", "source_type", (F.col("cv_file_id") % 7 == 3).alias("late"))
    whole = {tuple(r) for r in st.arrivals_windowed(f, "1 day").collect()}
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    order = F.col("created_at") + F.expr("make_interval(case when late then 1 else 0 end)")
    stream = replay(spark, f.withColumn("o", order), "o", 5)
    st.arrivals_with_ledger(stream, "1 day", "2 days", at + "/t", at + "/c").awaitTermination()
    rows = st.arrivals_so_far(spark, at + "/t").collect()
    assert {(r.window_start, r.source_type, r.n) for r in rows} == whole
    # what is on time is closed once, late rows are in the ledger alone
    closed = spark.read.parquet(at + "/t/closed").drop("batch")
    assert closed.count() == closed.select("window_start", "source_type").distinct().count() > 0
    late = sum(r.late for r in rows)
    assert 0 < late <= f.where("late").count()
    # another batch that holds nothing but rows long past
    again = spark.createDataFrame([(datetime(1980, 1, 1, 5), "MANUAL"), (datetime(1980, 1, 1, 6), "MANUAL")], "created_at timestamp, source_type string")
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    st.arrivals_with_ledger(arrive(spark, [f.select("created_at", "source_type"), again]), "1 day", "2 days", at + "/t", at + "/c").awaitTermination()
    assert [(r.n, r.late) for r in st.arrivals_so_far(spark, at + "/t").where("window_start < '1981-01-01'").collect()] == [(2, 2)]


def test_late_beats_merge_sessions(spark):
    day = datetime(2024, 1, 1)
    at = lambda *seconds: spark.createDataFrame([(1, i, day + timedelta(seconds=s)) for i, s in enumerate(seconds)], "worker_id long, event_id long, ts timestamp")
    # 0 and 30 are two sessions until the beat at 15 joins them; 100 stands alone; the last file closes all
    stream = arrive(spark, [at(0, 30), at(15), at(100), at(100_000), at(100_001)])
    got = {((r.online_from - day).seconds, (r.online_until - day).seconds, r.beats) for r in drain(spark, st.liveness(stream, "1 minute")).collect()}
    assert got == {(0, 50, 3), (100, 120, 1)}
    h = view(spark, SF, "heartbeat")
    whole = {tuple(r) for r in st.liveness(h).collect()}
    live = {tuple(r) for r in drain(spark, st.liveness(replay(spark, h, "ts", 4), "1 minute")).collect()}
    last = h.agg(F.max("ts")).first()[0] - timedelta(minutes=1)  # the watermark after the last file
    assert live == {r for r in whole if r[2] <= last}


def test_dedupe(spark):
    f = view(spark, SF, "cv_file").select("cv_file_id", "workspace_id", "file_hash", "created_at")
    got = drain(spark, st.stream_dedupe(replay(spark, f, "cv_file_id", 3)))
    assert got.count() == f.select("workspace_id", "file_hash").distinct().count()


def test_first_arrivals_are_exact(spark):
    rng = random.Random(5)
    parts = [[(rng.randrange(5), f"h{rng.randrange(300)}", n * 1000 + i) for i in range(200)] for n in range(4)]
    parts.insert(2, parts[1])  # a trigger of nothing but repeats
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frames = [spark.createDataFrame(p, "tenant int, hash string, id long") for p in parts]
    dedupe.first_arrivals(arrive(spark, frames), ["tenant", "hash"], ["id"], at + "/t", at + "/c", 4).awaitTermination()
    want, rows = {}, [x for p in parts for x in sorted(p, key=lambda x: x[2])]
    for tenant, h, i in rows:
        want.setdefault((tenant, h), i)
    got = {(r.tenant, r.hash): r.id for r in dedupe.arrived(spark, at + "/t").collect()}
    assert got == want and dedupe.arrived(spark, at + "/t").count() == len(want)
    # the filter has a stated size, passes every key it was given, and hardly any other
    filters = spark.read.schema(dedupe.FILTER).parquet(at + "/t/filter/batch=4")
    assert filters.count() <= dedupe.BITS // dedupe.ROW and {r[0] for r in filters.select(F.length("bits")).collect()} == {dedupe.ROW // 8}
    keys = spark.createDataFrame([*want, *[(9, f"h{i}") for i in range(3000)]], "tenant int, hash string")
    hits = {tuple(r) for r in dedupe.suspects(keys, ["tenant", "hash"], filters).collect()}
    assert set(want) <= hits and len(hits - set(want)) <= 3
    # one that says yes to everything changes nothing but the work
    full = spark.createDataFrame([(i, bytearray(b"\xff" * (dedupe.ROW // 8))) for i in range(dedupe.BITS // dedupe.ROW)], dedupe.FILTER)
    assert dedupe.suspects(keys, ["tenant", "hash"], full).count() == keys.count()
    store = dedupe.seen_contents(at + "/t", frames[0].schema, ["tenant", "hash"], 4)
    assert {tuple(r) for r in store.held(keys, 5).collect()} == set(want)


EVENT = "event_id long, cv_file_id long, status string, attempts long, max_attempts long, t string"


def test_stale_claims_time_out(spark):
    rows = [(1, 1, "PROCESSING", 1, 3, "2024-01-01 00:00:00"), (2, 2, "PROCESSING", 3, 3, "2024-01-01 00:00:01"), (3, 3, "PROCESSING", 1, 3, "2024-01-01 00:00:02"),
            (4, 3, "PROCESSED", 1, 3, "2024-01-01 00:01:00"), (5, 4, "PROCESSING", 1, 3, "2024-01-01 00:01:01"), (6, 4, "PROCESSING", 2, 3, "2024-01-01 00:04:01"),
            (7, 5, "PROCESSING", 1, 0, "2024-01-01 00:05:00"), (8, 5, "FAILED", 1, 0, "2024-01-01 00:20:00"), (9, 9, "PENDING", 1, 3, "2024-01-01 00:30:00"), (10, 9, "PENDING", 1, 3, "2024-01-01 00:40:00")]
    e = spark.createDataFrame(rows, EVENT).withColumn("ts", F.to_timestamp("t")).drop("t")
    for parts in (1, 3, 6):  # the answer does not depend on the triggers
        with pr.keyed_state(spark):
            got = {(r.cv_file_id, r.event_id, r.new_status) for r in drain(spark, pr.stale_claims_stream(replay(spark, e, "ts", parts))).collect()}
        # file 4's second claim comes at the last moment and renews it, then times out itself
        assert got == {(1, 1, "PENDING"), (2, 2, "FAILED"), (4, 6, "PENDING"), (5, 7, "PENDING")}, parts


STORED = "k long, v long"


def size_of(paths):
    return sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, fs in os.walk(p.removeprefix("file:")) for f in fs if f.endswith(".parquet"))


def test_store_keeps_the_newest_and_reads_what_is_touched(spark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = KeyedStore(at, ("k",), StructType.fromDDL(STORED), buckets=8, share=0.5, parts=3)
    rng, want, read = random.Random(3), {}, []
    for n in range(8):
        keys = range(20_000) if n == 0 else rng.sample(range(20_050), 5000) if n == 4 else [rng.randrange(20_050)]
        rows = spark.createDataFrame([(k, n * 100_000 + k) for k in keys], STORED)
        known = {tuple(r) for r in store.held(rows, n).collect()}
        assert known == {(k, want[k]) for k in keys if k in want}
        read.append(size_of(store.folders(spark, n - 1, store.touched(rows))))
        before = store.manifest(spark, n - 1)
        after = store.write(rows, n)
        want |= {k: n * 100_000 + k for k in keys}
        assert after == store.manifest(spark, n) and sum(after[b] != before.get(b) for b in after) == len(store.touched(rows))
        assert all(len(parts) <= 3 and added <= base * 0.5 for parts, base, added in after.values())
    assert {tuple(r) for r in store.read(spark, 7).collect()} == set(want.items())
    whole = size_of(store.folders(spark, 7))
    assert all(x < whole / 6 for n, x in enumerate(read) if n not in (0, 4)) and read[4] > whole / 2  # one key reads one bucket, many read many
    # a batch that is replayed gives the same again
    again = spark.createDataFrame([(k, v) for k, v in want.items() if v >= 700_000], STORED)
    old = store.manifest(spark, 7)
    assert store.write(again, 7) == old and {tuple(r) for r in store.read(spark, 7).collect()} == set(want.items())
    # removing what no manifest lists changes nothing that is read
    disk = size_of([at])
    assert store.vacuum(spark, 7, keep=2) > 0 and size_of([at]) < disk
    assert {tuple(r) for r in store.read(spark, 7).collect()} == set(want.items())
    assert len({tuple(r) for r in store.read(spark, 6).collect()}) in (len(want), len(want) - 1)


def test_changes_follow_what_was_seen(spark):
    from intakelake.operators import intake

    def feed(*rows):
        return spark.createDataFrame([(f, 1, f"{f}.pdf", "application/pdf", ["folder_1"], ["elsewhere"], False, False, removed, when) for f, when, removed in rows],
                                     "file_id string, workspace_id int, name string, mime_type string, parents_in array<string>, parents_out array<string>, moved boolean, trashed boolean, removed boolean, t string"
                                     ).withColumn("modified_at", F.to_timestamp("t")).drop("t")

    stored = spark.createDataFrame([(1, "old", "GOOGLE_DRIVE", "2024-01-01")], "workspace_id int, source_file_id string, source_type string, t string").withColumn("drive_modified_at", F.to_timestamp("t")).drop("t")
    ignored = spark.createDataFrame([(1, "never")], "workspace_id int, file_id string")
    parts = [feed(("new", "2024-02-01", False), ("old", "2024-01-01", False), ("never", "2024-02-01", False)), feed(("new", "2024-02-01", False), ("old", "2024-03-01", False)),
             feed(("new", "2024-04-01", False), ("old", "2024-03-01", True)), feed(("old", "2024-03-01", False), ("new", "2024-03-01", False))]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    judge = lambda batch, known: intake.judged_changes(batch, stored, known, ignored)
    seen = st.seen_files(path + "/seen", 4)
    st.apply_changes(arrive(spark, parts), judge, seen, path + "/t", path + "/ck").awaitTermination()
    got = {(r.batch, r.file_id): r.outcome for r in st.outcomes(spark, path + "/t", seen).collect()}
    assert got == {(0, "new"): "enqueued", (0, "old"): "unchanged", (1, "new"): "unchanged", (1, "old"): "reprocessed", (2, "new"): "reprocessed", (3, "old"): "enqueued", (3, "new"): "unchanged"}
    # of two changes of one time the order does not matter
    twice = feed(("new", "2024-02-01", True), ("new", "2024-02-01", False))
    both = [intake.judged_changes(twice.orderBy(order), stored, lambda rows: spark.createDataFrame([], st.SEEN), ignored)[0].collect() for order in (F.col("removed"), F.desc("removed"))]
    assert both[0] == both[1]
