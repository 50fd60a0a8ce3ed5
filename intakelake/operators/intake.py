"""Intake: duplicates, change feeds, ignore lists, deletion and retry plans.

Keys can be hot (one content hash, one tenant), so groups are reduced to one row by
aggregates with map-side partials and joined back; no pairs are formed within a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V

FILE_KEY = ["workspace_id", "file_hash"]
SHARES = 64


def upload_outcome(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """queued / duplicate (of which file) / rejected for every upload of a batch, in ``seq`` order.

    The oldest stored file of the tenant with the same content wins; else the first valid upload of the batch.
    """
    oldest = existing.groupBy(*FILE_KEY).agg(F.min(F.struct("created_at", "cv_file_id", "status")).alias("old"))
    first = batch.filter(F.col("error").isNull()).groupBy(*FILE_KEY).agg(F.min(F.struct("seq", "upload_id")).alias("first"))
    j = batch.join(oldest, FILE_KEY, "left").join(first, FILE_KEY, "left")
    bad, old, later = F.col("error").isNotNull(), F.col("old").isNotNull(), F.col("first.seq") < F.col("seq")
    return j.select(
        "upload_id", "workspace_id",
        F.when(bad, "rejected").when(old | later, "duplicate").otherwise("queued").alias("outcome"),
        F.when(~bad & old, F.col("old.cv_file_id")).when(~bad & later, F.col("first.upload_id")).alias("duplicate_of"),
        F.when(~bad & old, F.col("old.status")).when(~bad & later, "PENDING").alias("existing_status"), "error")


def cross_source_dup(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Remote files whose content another file of the tenant already holds a candidate for.

    Any other such file will do: the smallest id, or the largest when the file itself is the smallest.
    """
    done = files.join(candidates.select("cv_file_id"), "cv_file_id", "left_semi")
    ends = done.groupBy(*FILE_KEY).agg(F.min(F.struct("cv_file_id", "file_name")).alias("lo"), F.max(F.struct("cv_file_id", "file_name")).alias("hi"))
    j = files.filter(F.col("source_type") == "GOOGLE_DRIVE").join(ends, FILE_KEY)
    other = F.when(F.col("lo.cv_file_id") != F.col("cv_file_id"), F.col("lo")).otherwise(F.col("hi"))
    j = j.withColumn("_o", other).filter(F.col("_o.cv_file_id") != F.col("cv_file_id"))
    message = F.concat(F.lit('Duplicate content of "'), "_o.file_name", F.lit('" ('), F.col("_o.cv_file_id").cast("string"), F.lit(") – skipped"))
    return j.select("cv_file_id", "workspace_id", F.lit("SKIPPED").alias("status"), message.alias("message"))


def supported_remote(name: Column, mime: Column, trashed: Column) -> Column:
    by_name = F.lit(False)
    for ext in V.EXTENSION_MIME:
        by_name = by_name | F.lower(F.coalesce(name, F.lit(""))).endswith(ext)
    known = F.coalesce(mime.isin(*V.SUPPORTED_MIMES, V.HOSTED_DOC_MIME), F.lit(False))
    return ~F.coalesce(trashed, F.lit(False)) & F.coalesce(mime != V.FOLDER_MIME, F.lit(True)) & (known | by_name)


def effective_mime(mime: Column) -> Column:
    return F.when(mime == V.HOSTED_DOC_MIME, V.EXTENSION_MIME[".pdf"]).otherwise(mime)


def change_split(feed: DataFrame) -> DataFrame:
    """Mark each change ``removed`` or ``changed``; unsupported files drop out."""
    gone = F.col("removed") | F.col("name").isNull() | F.col("trashed")
    kind = F.when(gone, "removed").when(supported_remote(F.col("name"), F.col("mime_type"), F.col("trashed")), "changed")
    return feed.withColumn("change", kind).filter(F.col("change").isNotNull())


def in_folder(changed: DataFrame, folder: Column) -> DataFrame:
    return changed.filter(F.array_contains("parents", folder))


def drop_ignored(feed: DataFrame, ignored: DataFrame) -> DataFrame:
    return feed.join(ignored.select("workspace_id", "file_id"), ["workspace_id", "file_id"], "left_anti")


def change_outcome(changed: DataFrame, files: DataFrame) -> DataFrame:
    """New files are enqueued, newer ones reprocessed, all others left alone."""
    known = files.filter(F.col("source_type") == "GOOGLE_DRIVE").select(
        "workspace_id", F.col("source_file_id").alias("file_id"), "cv_file_id", F.col("drive_modified_at").alias("_was"))
    j = changed.join(known, ["workspace_id", "file_id"], "left")
    newer = F.coalesce(F.col("modified_at") > F.col("_was"), F.lit(False))
    return j.withColumn("outcome", F.when(F.col("cv_file_id").isNull(), "enqueued").when(newer, "reprocessed").otherwise("unchanged")).drop("_was")


def judged_changes(feed: DataFrame, stored: DataFrame, seen: Callable[[DataFrame], DataFrame], ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of a batch of changes, and the rows it adds to the files seen.

    ``seen(rows)`` gives what was seen before of the files that ``rows`` name. A file's newest change counts; of
    changes with one time (or none) that are not one and the same, the greatest by all its columns. Known is what is stored, overlaid by what was seen since: a later
    modification time, or that the file is gone, after which it is new again. Changes of removed files have
    no outcome; they only mark the file as gone.
    """
    f = feed.withColumn("parents", F.when(F.col("moved"), F.col("parents_out")).otherwise(F.col("parents_in"))).drop("parents_in", "parents_out", "moved")
    rest = [c for c in f.columns if c not in ("workspace_id", "file_id")]
    rest = ["modified_at", *[c for c in rest if c != "modified_at"]]  # a null time comes before all others
    f = f.groupBy("workspace_id", "file_id").agg(F.max(F.struct(*rest)).alias("r")).select("workspace_id", "file_id", "r.*")
    split = change_split(f)
    changed = drop_ignored(in_folder(split.filter("change = 'changed'"), F.concat(F.lit("folder_"), F.col("workspace_id").cast("string"))), ignored)
    mine = stored.filter((F.col("source_type") == "GOOGLE_DRIVE") & F.col("source_file_id").isNotNull()).select(
        "workspace_id", F.col("source_file_id").alias("file_id"), F.col("drive_modified_at").alias("_stored"), F.lit(True).alias("_is_stored"))
    later = seen(f).select("workspace_id", "file_id", F.col("modified_at").alias("_seen"), "gone")
    j = changed.join(mine, ["workspace_id", "file_id"], "left").join(later, ["workspace_id", "file_id"], "left")
    gone = F.coalesce("gone", F.lit(False))
    known = ~gone & (F.col("_is_stored").isNotNull() | F.col("gone").isNotNull())
    newer = F.coalesce(F.col("modified_at") > F.coalesce("_seen", "_stored"), F.lit(False))
    outcomes = j.select("file_id", "workspace_id", "modified_at", F.when(~known, "enqueued").when(newer, "reprocessed").otherwise("unchanged").alias("outcome"))
    removed = split.filter("change = 'removed'").select("workspace_id", "file_id", "modified_at", F.lit(True).alias("gone"))
    added = outcomes.filter("outcome <> 'unchanged'").select("workspace_id", "file_id", "modified_at", F.lit(False).alias("gone"))
    return outcomes.drop("modified_at"), added.unionByName(removed)


def sync_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.groupBy(*keys).agg(F.count("*").alias("discovered"), n("enqueued"), n("reprocessed"), n("unchanged"))


def due_connections(conns: DataFrame, as_of: str, interval_minutes: int) -> DataFrame:
    cutoff = F.expr(f"timestamp '{as_of}' - interval {max(1, interval_minutes)} minutes")
    return conns.filter(F.col("is_active") & F.col("folder_id").isNotNull() & (F.col("last_sync_at").isNull() | (F.col("last_sync_at") < cutoff)))


def due_totals(due: DataFrame, summaries: DataFrame) -> DataFrame:
    j = due.join(summaries, "connection_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return j.agg(F.count("*").alias("connections_checked"), F.count("discovered").alias("connections_synced"), total("discovered"), total("enqueued"))


def ignore_append(current: DataFrame, added: DataFrame, size: int | None = None) -> DataFrame:
    """Per tenant: first-seen order, no repeats; all of it, or the last ``size`` where a size is asked for."""
    both = current.select("workspace_id", "file_id", F.lit(0).alias("part"), "seq").unionByName(
        added.select("workspace_id", "file_id", F.lit(1).alias("part"), "seq"))
    seen = both.groupBy("workspace_id", "file_id").agg(F.min(F.struct("part", "seq")).alias("_at"))
    if size is None:
        return seen.select("workspace_id", "file_id", "_at.part", "_at.seq")
    # a tenant's last entries are among the last entries of its shares, so a large tenant is cut in many tasks first
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("file_id")))
    shares = seen.withColumn("_s", F.pmod(F.hash("file_id"), F.lit(SHARES)))
    kept = shares.withColumn("_n", newest("workspace_id", "_s")).filter(F.col("_n") <= size)
    return kept.withColumn("_n", newest("workspace_id")).filter(F.col("_n") <= size).select("workspace_id", "file_id", "_at.part", "_at.seq")


def ignore_remove(current: DataFrame, ids: DataFrame) -> DataFrame:
    """The list without ``ids``."""
    return current.join(ids, ["workspace_id", "file_id"], "left_anti")


def ignore_removed_count(current: DataFrame, ids: DataFrame) -> DataFrame:
    hit = current.join(ids, ["workspace_id", "file_id"], "left_semi")
    return hit.groupBy("workspace_id").agg(F.count("*").alias("removed"))


def delete_plan(ids: DataFrame, files: DataFrame, ignore_future: bool = True) -> DataFrame:
    """What deleting ``ids`` within the scoped ``files`` would do, as one row."""
    j = ids.select("cv_file_id").join(files.withColumn("_f", F.lit(True)), "cv_file_id", "left")
    found, remote = F.col("_f").isNotNull(), (F.col("source_type") == "GOOGLE_DRIVE") & F.col("source_file_id").isNotNull()
    return j.agg(
        F.count("*").alias("requested"), F.count_if(found).alias("deleted"), F.count_if(~found).alias("not_found"), F.count_if(remote).alias("drive_unlinked"),
        (F.count_if(remote) if ignore_future else F.lit(0).cast("bigint")).alias("drive_ignored"), F.count_if(F.col("storage_path").isNotNull()).alias("objects_removed"))


def survivors(table: DataFrame, ids: DataFrame, scoped_files: DataFrame) -> DataFrame:
    """Rows of a file, candidate or job table left after the delete cascades."""
    gone = ids.join(scoped_files.select("cv_file_id"), "cv_file_id", "left_semi").select("cv_file_id")
    return table.join(gone, "cv_file_id", "left_anti")


def retry_selection(files: DataFrame, jobs: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Failed files of the scope; ``new_job`` is false where a job is already waiting or running."""
    failed = files.filter(F.col("status") == "FAILED")
    if batch_id is not None:
        failed = failed.join(jobs.filter(F.col("batch_id") == batch_id).select("cv_file_id"), "cv_file_id", "left_semi")
    active = jobs.filter(F.col("status").isin(*V.ACTIVE_STATUSES)).groupBy("cv_file_id").agg(F.lit(True).alias("_active"))
    return failed.join(active, "cv_file_id", "left").select("cv_file_id", "workspace_id", F.col("_active").isNull().alias("new_job"))


def enqueue_rows(files: DataFrame, batch_id: str | None, max_attempts: int) -> DataFrame:
    """A pending job row per file, with the file's reset status."""
    return files.select(
        "cv_file_id", F.lit(batch_id).alias("batch_id"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"),
        F.lit(max_attempts).alias("max_attempts"), F.lit("PENDING").alias("file_status"))
