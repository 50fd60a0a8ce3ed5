"""Registered queries: intake, change feed, deletion and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import files as ff
from ..operators import intake as op
from ..sources.views import raw, view
from . import sql as S
from .out import plain

QUERIES, ORACLE = {}, {}
SCOPE = 3


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


# File contents: a magic prefix before each document's text; names of every kind.
KINDS = ["25504446", "D0CF11E0A1B11AE1", "504B0304", "FFD8FFE0", "89504E470D0A1A0A", "52494646AAAAAAAA57454250", "00000000", ""]
NAMES = ["résumé.PDF", "a/b:c.doc", "x?.docx", "photo.jpeg", "scan.png", "pic.webp", "notes.txt", "noext", "cv.pdf", ".docx", "  ", "old.jpg"]


def contents(spark, sf):
    d = raw(spark, sf, "documents")
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    body = F.concat(F.unhex(pick(KINDS, i)), F.when(i % 11 == 5, F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.encode("text", "utf-8")))
    return d.select("doc_id", pick(NAMES, i).alias("file_name"), body.alias("content"))


_C = f"""SELECT doc_id, ({S.lst(NAMES)})[doc_id % {len(NAMES)} + 1] AS file_name, doc_id % 8 AS kind,
   length(({S.lst(KINDS)})[doc_id % 8 + 1]) // 2 + CASE WHEN doc_id % 11 = 5 THEN 0 ELSE strlen(text) END AS n FROM documents"""
_SAN = f"coalesce(nullif(left(trim({S.rep('split_part(file_name, chr(47), -1)', V.UNSAFE_NAME_CHARS, '_')}), 200), ''), 'cv')"
_EXT = "lower(regexp_extract({c}, '^.+(\\.[^.]*)$', 1))"
_MIME = lambda e: f"CASE {e} " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in V.EXTENSION_MIME.items()) + " END"
_GOT = f"""CASE kind WHEN 0 THEN 'application/pdf' WHEN 1 THEN CASE WHEN ext = '.doc' THEN 'application/msword' ELSE 'application/x-cfb' END
  WHEN 2 THEN CASE WHEN ext = '.docx' THEN {S.q(V.EXTENSION_MIME['.docx'])} ELSE 'application/zip' END WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'image/png' WHEN 5 THEN 'image/webp' END"""
X = {"cont": _C, "named": f"SELECT *, {_SAN} AS safe FROM cont", "typed": f"SELECT *, {_EXT.format(c='safe')} AS ext FROM named",
     "sniffed": f"SELECT *, {_MIME('ext')} AS want, {_GOT} AS got FROM typed"}


@query("sanitize_name", "SELECT doc_id, safe AS safe_name FROM named", **X)
def _(spark, sf):
    return contents(spark, sf).select("doc_id", ff.sanitize_name(F.col("file_name")).alias("safe_name"))


@query("ext_to_mime", f"SELECT doc_id, {_MIME(_EXT.format(c='file_name'))} AS mime FROM cont", **X)
def _(spark, sf):
    return contents(spark, sf).select("doc_id", ff.ext_to_mime(F.col("file_name")).alias("mime"))


@query("sniff_mime", f"SELECT doc_id, {_GOT} AS mime FROM (SELECT *, {_EXT.format(c='file_name')} AS ext FROM cont) z", **X)
def _(spark, sf):
    return contents(spark, sf).select("doc_id", ff.sniff_mime(F.col("content"), F.col("file_name")).alias("mime"))


@query("validate_file", f"""SELECT doc_id, safe AS safe_name, CASE WHEN error IS NULL THEN got END AS mime_type, error FROM (SELECT *, CASE WHEN want IS NULL THEN 'Unsupported file type: ' || safe || '. Allowed: {", ".join(V.EXTENSION_MIME)}'
    WHEN n = 0 THEN 'File is empty: ' || safe WHEN n > 10485 THEN 'File too large: ' || safe || ' (' || printf('%.1f', n / 1048576.0) || ' MB > 0 MB)'
    WHEN got IS NULL OR got NOT IN ({", ".join(map(S.q, V.SUPPORTED_MIMES))}) THEN 'File content does not match a supported document type: ' || safe
    WHEN (want LIKE 'image/%') <> (got LIKE 'image/%') OR (got NOT LIKE 'image/%' AND want <> got) THEN 'File content (' || got || ') does not match its extension: ' || safe END AS error FROM sniffed) z""", **X)
def _(spark, sf):
    return ff.validate_file(contents(spark, sf), 10485).select("doc_id", "safe_name", "mime_type", "error")


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("hash"))


def _batch(spark, sf):
    f = view(spark, sf, "cv_file").filter(F.col("cv_file_id") % 2 == 0)
    bad = F.when(F.col("cv_file_id") % 15 == 4, F.concat(F.lit("File is empty: "), "file_name"))
    return f.select(F.col("cv_file_id").alias("upload_id"), F.col("cv_file_id").alias("seq"), "workspace_id", "file_hash", bad.alias("error"))


@query("upload_outcome", """SELECT b.cv_file_id AS upload_id, b.workspace_id, CASE WHEN bad THEN 'rejected' WHEN o.cv_file_id IS NOT NULL OR rn > 1 THEN 'duplicate' ELSE 'queued' END AS outcome,
   CASE WHEN bad THEN NULL WHEN o.cv_file_id IS NOT NULL THEN o.cv_file_id WHEN rn > 1 THEN first_id END AS duplicate_of,
   CASE WHEN bad THEN NULL WHEN o.cv_file_id IS NOT NULL THEN o.status WHEN rn > 1 THEN 'PENDING' END AS existing_status, CASE WHEN bad THEN 'File is empty: ' || b.file_name END AS error
  FROM (SELECT *, cv_file_id % 15 = 4 AS bad, row_number() OVER w AS rn, first_value(cv_file_id) OVER w AS first_id FROM cv_file WHERE cv_file_id % 2 = 0
     WINDOW w AS (PARTITION BY workspace_id, file_hash, cv_file_id % 15 = 4 ORDER BY cv_file_id)) b
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY workspace_id, file_hash ORDER BY created_at, cv_file_id) AS k FROM cv_file WHERE cv_file_id % 2 = 1) o
    ON o.workspace_id = b.workspace_id AND o.file_hash = b.file_hash AND k = 1""")
def _(spark, sf):
    return op.upload_outcome(_batch(spark, sf), view(spark, sf, "cv_file").filter(F.col("cv_file_id") % 2 == 1))


@query("cross_source_dup", """SELECT cv_file_id, workspace_id, 'SKIPPED' AS status, 'Duplicate content of "' || other.file_name || '" (' || other.cv_file_id || ') – skipped' AS message FROM (
  SELECT f.cv_file_id, f.workspace_id, CASE WHEN bool_or(d.cv_file_id < f.cv_file_id) OR min(d.cv_file_id) > f.cv_file_id AND NOT bool_or(d.is_self) THEN arg_min(d, d.cv_file_id) ELSE arg_max(d, d.cv_file_id) END AS other
  FROM cv_file f JOIN (SELECT cf.cv_file_id, cf.file_name, cf.workspace_id, cf.file_hash, false AS is_self FROM cv_file cf JOIN candidate c ON c.cv_file_id = cf.cv_file_id) d
    ON d.workspace_id = f.workspace_id AND d.file_hash = f.file_hash AND d.cv_file_id <> f.cv_file_id
  WHERE f.source_type = 'GOOGLE_DRIVE' AND NOT EXISTS (SELECT 1 FROM candidate c WHERE c.cv_file_id = f.cv_file_id AND f.cv_file_id < (
      SELECT min(x.cv_file_id) FROM cv_file x JOIN candidate y ON y.cv_file_id = x.cv_file_id WHERE x.workspace_id = f.workspace_id AND x.file_hash = f.file_hash AND x.cv_file_id <> f.cv_file_id))
  GROUP BY f.cv_file_id, f.workspace_id
  UNION ALL SELECT f.cv_file_id, f.workspace_id, arg_max(d, d.cv_file_id) FROM cv_file f JOIN candidate c ON c.cv_file_id = f.cv_file_id JOIN (SELECT cf.cv_file_id, cf.file_name, cf.workspace_id, cf.file_hash, false AS is_self FROM cv_file cf JOIN candidate c2 ON c2.cv_file_id = cf.cv_file_id) d
    ON d.workspace_id = f.workspace_id AND d.file_hash = f.file_hash WHERE f.source_type = 'GOOGLE_DRIVE' GROUP BY f.cv_file_id, f.workspace_id HAVING min(d.cv_file_id) = f.cv_file_id AND max(d.cv_file_id) > f.cv_file_id) z""")
def _(spark, sf):
    return op.cross_source_dup(view(spark, sf, "cv_file"), view(spark, sf, "candidate"))


def feed(spark, sf):
    f = view(spark, sf, "feed")
    return f.withColumn("parents", F.when(F.col("moved"), F.col("parents_out")).otherwise(F.col("parents_in"))).drop("parents_in", "parents_out", "moved")


SUPPORTED = f"""(NOT trashed AND mime_type <> '{V.FOLDER_MIME}' AND (mime_type IN ({", ".join(map(S.q, [*V.SUPPORTED_MIMES, V.HOSTED_DOC_MIME]))}) OR regexp_matches(lower(name), '\\.(pdf|doc|docx|jpg|jpeg|png|webp)$')))"""
_CH = f"SELECT *, CASE WHEN removed OR trashed THEN 'removed' WHEN {SUPPORTED} THEN 'changed' END AS change FROM feed"
_IN = "SELECT * FROM ch WHERE change = 'changed' AND NOT moved AND list_contains(parents_in, 'folder_' || workspace_id)"
_KEPT = "SELECT * FROM infold f WHERE NOT EXISTS (SELECT 1 FROM ignore_list i WHERE i.workspace_id = f.workspace_id AND i.file_id = f.file_id)"
_OUT = """SELECT f.file_id, f.workspace_id, c.cv_file_id, CASE WHEN c.cv_file_id IS NULL THEN 'enqueued' WHEN f.modified_at > c.created_at THEN 'reprocessed' ELSE 'unchanged' END AS outcome
  FROM kept f LEFT JOIN cv_file c ON c.source_type = 'GOOGLE_DRIVE' AND c.workspace_id = f.workspace_id AND c.source_file_id = f.file_id"""
Y = {"ch": _CH, "infold": _IN, "kept": _KEPT, "outc": _OUT}


def changed(spark, sf):
    c = op.change_split(feed(spark, sf)).filter("change = 'changed'")
    return op.drop_ignored(op.in_folder(c, F.concat(F.lit("folder_"), F.col("workspace_id").cast("string"))), view(spark, sf, "ignore_list"))


def outcomes(spark, sf):
    return op.change_outcome(changed(spark, sf), view(spark, sf, "cv_file").withColumn("drive_modified_at", F.col("created_at")))


@query("supported_remote", f"SELECT file_id, name, mime_type FROM feed WHERE {SUPPORTED}")
def _(spark, sf):
    return feed(spark, sf).filter(op.supported_remote(F.col("name"), F.col("mime_type"), F.col("trashed"))).select("file_id", "name", "mime_type")


@query("effective_mime", f"SELECT file_id, CASE mime_type WHEN '{V.HOSTED_DOC_MIME}' THEN 'application/pdf' ELSE mime_type END AS mime FROM feed")
def _(spark, sf):
    return feed(spark, sf).select("file_id", op.effective_mime(F.col("mime_type")).alias("mime"))


@query("change_split", "SELECT file_id, workspace_id, change FROM ch WHERE change IS NOT NULL", **Y)
def _(spark, sf):
    return op.change_split(feed(spark, sf)).select("file_id", "workspace_id", "change")


@query("in_folder", "SELECT file_id, workspace_id FROM infold", **Y)
def _(spark, sf):
    c = op.change_split(feed(spark, sf)).filter("change = 'changed'")
    return op.in_folder(c, F.concat(F.lit("folder_"), F.col("workspace_id").cast("string"))).select("file_id", "workspace_id")


@query("drop_ignored", "SELECT file_id, workspace_id FROM kept", **Y)
def _(spark, sf):
    return changed(spark, sf).select("file_id", "workspace_id")


@query("change_outcome", "SELECT file_id, workspace_id, cv_file_id, outcome FROM outc", **Y)
def _(spark, sf):
    return outcomes(spark, sf).select("file_id", "workspace_id", "cv_file_id", "outcome")


_SUM = "SELECT workspace_id, count(*) AS discovered, count(*) FILTER (outcome = 'enqueued') AS enqueued, count(*) FILTER (outcome = 'reprocessed') AS reprocessed, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM outc GROUP BY workspace_id"


def summaries(spark, sf):
    c = view(spark, sf, "source_connection").filter(F.col("is_active") & F.col("folder_id").isNotNull())
    s = op.sync_summary(outcomes(spark, sf), ["workspace_id"])
    return c.join(s, "workspace_id").withColumn("mode", F.when(F.col("has_page_token"), "incremental").otherwise("full"))


@query("sync_summary", "SELECT connection_id, CASE WHEN has_page_token THEN 'incremental' ELSE 'full' END AS mode, discovered, enqueued, reprocessed, unchanged FROM source_connection c JOIN summ s ON s.workspace_id = c.workspace_id WHERE is_active AND folder_id IS NOT NULL", summ=_SUM, **Y)
def _(spark, sf):
    return summaries(spark, sf).select("connection_id", "mode", "discovered", "enqueued", "reprocessed", "unchanged")


_DUE = f"SELECT * FROM source_connection WHERE is_active AND folder_id IS NOT NULL AND (last_sync_at IS NULL OR last_sync_at < timestamp '{V.AS_OF}' - interval 5 minute)"


@query("due_connections", "SELECT connection_id, workspace_id FROM due", due=_DUE)
def _(spark, sf):
    return op.due_connections(view(spark, sf, "source_connection"), V.AS_OF, 5).select("connection_id", "workspace_id")


@query("due_totals", "SELECT count(*) AS connections_checked, count(discovered) AS connections_synced, sum(discovered)::bigint AS discovered, sum(enqueued)::bigint AS enqueued FROM due LEFT JOIN summ ON summ.workspace_id = due.workspace_id", due=_DUE, summ=_SUM, **Y)
def _(spark, sf):
    s = summaries(spark, sf).select("connection_id", "discovered", "enqueued")
    return op.due_totals(op.due_connections(view(spark, sf, "source_connection"), V.AS_OF, 5), s)


_ADD = "SELECT workspace_id, source_file_id AS file_id, cv_file_id AS seq FROM cv_file WHERE source_type = 'GOOGLE_DRIVE' AND cv_file_id % 5 = 0"


def added(spark, sf):
    f = view(spark, sf, "cv_file").filter((F.col("source_type") == "GOOGLE_DRIVE") & (F.col("cv_file_id") % 5 == 0))
    return f.select("workspace_id", F.col("source_file_id").alias("file_id"), F.col("cv_file_id").alias("seq"))


@query("ignore_append", """SELECT workspace_id, file_id, part, seq FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY part DESC, seq DESC, file_id DESC) AS n FROM (
    SELECT workspace_id, file_id, 0 AS part, seq FROM ignore_list UNION ALL SELECT workspace_id, file_id, 1, seq FROM addd a WHERE NOT EXISTS (SELECT 1 FROM ignore_list i WHERE i.workspace_id = a.workspace_id AND i.file_id = a.file_id)) x) y""", addd=_ADD)
def _(spark, sf):
    return op.ignore_append(view(spark, sf, "ignore_list"), added(spark, sf))


@query("ignore_remove", "SELECT workspace_id, file_id, seq FROM ignore_list i WHERE seq % 5 <> 0")
def _(spark, sf):
    return op.ignore_remove(view(spark, sf, "ignore_list"), added(spark, sf).select("workspace_id", "file_id"))


@query("ignore_removed_count", "SELECT workspace_id, count(*) AS removed FROM ignore_list WHERE seq % 5 = 0 GROUP BY workspace_id")
def _(spark, sf):
    return op.ignore_removed_count(view(spark, sf, "ignore_list"), added(spark, sf).select("workspace_id", "file_id"))


def delete_ids(spark, sf):
    o = raw(spark, sf, "orders").filter("o_orderkey % 11 = 0")
    return o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 44 == 0, 10**12).otherwise(0)).alias("cv_file_id"))


_IDS = "SELECT o_orderkey + CASE WHEN o_orderkey % 44 = 0 THEN 1000000000000 ELSE 0 END AS cv_file_id FROM orders WHERE o_orderkey % 11 = 0"


def scoped(spark, sf):
    f = view(spark, sf, "cv_file").filter(F.col("workspace_id") == SCOPE)
    return f.withColumn("storage_path", F.when(F.col("source_type") == "MANUAL", F.concat(F.lit("uploads/"), "file_name")))


@query("delete_plan", f"""SELECT count(*) AS requested, count(f.cv_file_id) AS deleted, count(*) - count(f.cv_file_id) AS not_found, count(*) FILTER (f.source_type = 'GOOGLE_DRIVE') AS drive_unlinked,
   count(*) FILTER (f.source_type = 'GOOGLE_DRIVE') AS drive_ignored, count(*) FILTER (f.source_type = 'MANUAL') AS objects_removed FROM ids i LEFT JOIN cv_file f ON f.cv_file_id = i.cv_file_id AND f.workspace_id = {SCOPE}""", ids=_IDS)
def _(spark, sf):
    return op.delete_plan(delete_ids(spark, sf), scoped(spark, sf))


_GONE = f"(SELECT f.cv_file_id FROM cv_file f JOIN ids i ON i.cv_file_id = f.cv_file_id WHERE f.workspace_id = {SCOPE})"


@query("delete_survivors", "SELECT kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS kind FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.cv_file_id = t.cv_file_id)" for t in ("cv_file", "candidate", "processing_job")) + ") x GROUP BY kind", ids=_IDS, gone=_GONE[1:-1])
def _(spark, sf):
    left = [op.survivors(view(spark, sf, t), delete_ids(spark, sf), scoped(spark, sf)).select(F.lit(t).alias("kind")) for t in ("cv_file", "candidate", "processing_job")]
    return left[0].unionByName(left[1]).unionByName(left[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("retry_selection", """SELECT cv_file_id, workspace_id, NOT EXISTS (SELECT 1 FROM processing_job j WHERE j.cv_file_id = f.cv_file_id AND j.status IN ('PENDING', 'PROCESSING')) AS new_job FROM cv_file f WHERE status = 'FAILED'""")
def _(spark, sf):
    return op.retry_selection(view(spark, sf, "cv_file"), view(spark, sf, "processing_job"))


@query("retry_batch", """SELECT cv_file_id, workspace_id, NOT EXISTS (SELECT 1 FROM processing_job j WHERE j.cv_file_id = f.cv_file_id AND j.status IN ('PENDING', 'PROCESSING')) AS new_job FROM cv_file f
  WHERE status = 'FAILED' AND cv_file_id IN (SELECT cv_file_id FROM processing_job WHERE batch_id = 'batch_7')""")
def _(spark, sf):
    return op.retry_selection(view(spark, sf, "cv_file"), view(spark, sf, "processing_job"), "batch_7")


@query("enqueue_rows", "SELECT cv_file_id, 'again' AS batch_id, 'PENDING' AS status, 0 AS attempts, 3 AS max_attempts, 'PENDING' AS file_status FROM cv_file WHERE status = 'FAILED'")
def _(spark, sf):
    return op.enqueue_rows(op.retry_selection(view(spark, sf, "cv_file"), view(spark, sf, "processing_job")), "again", 3)
