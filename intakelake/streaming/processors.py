"""Keyed state with value states and timers: live status counts by retraction, claims that time out.

Both processors follow a key's events in the order of time and id, so their output does not depend on how
events are cut into triggers, as long as none comes later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import values as V

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that value states and timers need; a started query holds its own settings."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator:
    """One key's events of one trigger by time and id; the engine hands them over in Arrow batches."""
    held = [x for x in rows if len(x)]
    yield from pd.concat(held).sort_values(["ts", "event_id"]).itertuples(index=False) if held else ()


class StatusChanges(StatefulProcessor):
    """Per file the newest status; a newer one takes the old one out of the counts (-1) and comes in itself (+1)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts timestamp, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:  # only the newest event counts, so batches are looked at one by one
            if len(frame):
                best = frame.sort_values(["ts", "event_id"]).iloc[-1]
                if last is None or (best.ts, best.event_id) > (last.ts, last.event_id):
                    last = best
        old = self.newest.get() if self.newest.exists() else None
        if last is None or (old is not None and (last.ts, last.event_id) <= (pd.Timestamp(old[0]), old[1])):
            return
        self.newest.update((last.ts.to_pydatetime(), int(last.event_id), last.status))
        if old is None or old[2] != last.status:
            out = [(last.status, 1)] if old is None else [(old[2], -1), (last.status, 1)]
            yield pd.DataFrame(out, columns=["status", "delta"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """(status, delta) of each file whose newest status changes; state is one row a file."""
    return events.select("cv_file_id", "ts", "event_id", "status").groupBy("cv_file_id").transformWithStateInPandas(StatusChanges(), "status string, delta long", "Update", "None")


def live_counts(events: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Files per status after each trigger, in ``batch=n``: the counts of the trigger before and what has changed.

    A trigger's work follows its events; the counts have one row a status. Batch ``n`` reads batch ``n - 1`` and
    owns its folder, so a replay writes the same.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            before = batch.sparkSession.read.schema("status string, n long").parquet(f"{path}/batch={n - 1}")
            rows = batch.unionByName(before.select("status", F.col("n").alias("delta")))
        now = rows.groupBy("status").agg(F.sum("delta").alias("n")).where("n <> 0")
        now.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")

    with keyed_state(events.sparkSession):
        w = status_changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def counts_after(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """status and n after trigger ``n``, or after the last one."""
    rows = spark.read.parquet(path)
    n = rows.agg(F.max("batch")).first()[0] if n is None else n
    return rows.where(F.col("batch") == n).select("status", "n")


class StaleClaims(StatefulProcessor):
    """A claim waits for its file's next event; when three minutes of event time pass without one it is given up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "event_id long, attempts long, max_attempts long, due long")

    def _said(self, key, claim) -> tuple:
        spent = claim[1] >= (claim[2] or 3)
        message = "Processing was interrupted (the server stopped mid-way)" + ("; no attempts left" if spent else "; retrying")
        return (key[0], claim[0], "FAILED" if spent else "PENDING", message, "INTERRUPTED")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        claim = tuple(self.claim.get()) if self.claim.exists() else None
        armed, out = claim, []
        for e in in_order(rows):
            at = int(e.ts.timestamp() * 1000)
            if claim and at > claim[3]:
                out.append(self._said(key, claim))
            claim = (int(e.event_id), int(e.attempts), int(e.max_attempts), at + V.STALE_CLAIM_SECONDS * 1000) if e.status == "PROCESSING" else None
        if armed != claim:
            if armed:
                self.handle.deleteTimer(armed[3])
                self.claim.clear()
            if claim:
                self.claim.update(claim)
                self.handle.registerTimer(claim[3])
        if out:
            yield pd.DataFrame(out, columns=STALE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists():
            claim = tuple(self.claim.get())
            self.claim.clear()
            yield pd.DataFrame([self._said(key, claim)], columns=STALE)

    def close(self) -> None:
        pass


STALE = ["cv_file_id", "event_id", "new_status", "message", "error_code"]


def stale_claims_stream(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Claims given up, as they time out: back to the queue, or failed once their attempts are spent.

    An event that comes in time cancels the claim's timer. State is one row for each open claim. Start the
    query inside :func:`keyed_state`.
    """
    rows = events.select("cv_file_id", "ts", "event_id", "status", "attempts", "max_attempts").withWatermark("ts", late)
    return rows.groupBy("cv_file_id").transformWithStateInPandas(StaleClaims(), "cv_file_id long, event_id long, new_status string, message string, error_code string", "Append", "EventTime")
