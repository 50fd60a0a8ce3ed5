"""Export tables, files and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..session import checkpointed

BOM = "﻿"


def csv_cell(value: Column) -> Column:
    """Neutralise formulas (plain signed numbers are safe), then quote as RFC 4180 asks."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    risky = s.rlike(V.FORMULA_START) & ~s.rlike(V.SAFE_NUMERIC)
    safe = F.when(risky, F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return rows.select(*order, F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def csv_export(rows: DataFrame, columns: list[str], path: str, order: str) -> None:
    """A folder of CSV parts in row order: BOM and header first, CRLF line ends."""
    lines = csv_lines(rows, columns, [order]).select(F.lit(1).alias("part"), F.col(order).alias("k"), "line")
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(rows.schema[order].dataType).alias("k"), F.lit(BOM + ",".join(columns)).alias("line"))
    head.unionByName(lines).orderBy("part", "k").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_rows(rows: DataFrame, app_url: str) -> DataFrame:
    """The nine display columns of an export, keyed by file."""
    base = app_url.rstrip("/")
    has = F.col("candidate_name").isNotNull()
    link = F.when((F.col("source_type") == "GOOGLE_DRIVE") & F.col("drive_url").isNotNull(), F.col("drive_url")).otherwise(
        F.concat(F.lit(base + "/api/cv-files/"), F.col("cv_file_id").cast("string"), F.lit("/download")))
    conf = F.regexp_replace((F.round(F.col("overall_confidence") * 100) / 100).cast("string"), r"\.0$", "")
    cols = [
        F.coalesce("candidate_name", F.lit(V.NOT_FOUND)), F.coalesce("phone_number", F.lit(V.NOT_FOUND)), F.coalesce("job_role_applied_for", F.lit(V.NOT_FOUND)),
        F.col("file_name"), link, F.when(F.col("source_type") == "GOOGLE_DRIVE", "Google Drive").otherwise("Manual Upload"),
        F.regexp_replace("status", "^([^_]*)_", "$1 "), F.when(has, conf).otherwise(""),
        F.coalesce(F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")),
    ]
    return rows.select("cv_file_id", *[c.alias(n) for c, n in zip(cols, V.EXPORT_HEADERS)])


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Add ``row_no`` (1-based) in a total order without a single-task window.

    Rows are range-sorted and written once; each part's size gives the next part's offset, and the
    table of offsets has one row per part.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, pos = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")  # one row per part
    parts = sizes.select("_p", before.alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(parts), "_p").withColumn("row_no", F.col("_before") + pos + 1).drop("_p", "_m", "_before")


def export_chunks(rows: DataFrame, size: int = V.EXPORT_CHUNK) -> DataFrame:
    """Write ranges of an export, from its count alone: the header is sheet row 1, ``size`` rows per write."""
    last = rows.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / size))).alias("chunk"))
    return last.select("chunk", (F.col("chunk") * size + 1).alias("start_row"), (F.least((F.col("chunk") + 1) * size - 1, F.col("n")) - F.col("chunk") * size + 1).alias("rows"))


def export_chunk_rows(rows: DataFrame, *order, size: int = V.EXPORT_CHUNK) -> DataFrame:
    """Each row with its chunk and sheet row."""
    return numbered(rows, *order).withColumn("chunk", F.floor(F.col("row_no") / size)).withColumn("sheet_row", F.col("row_no") + 1)


def upsert_candidates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot after new results: one row per file, the new row where there is one."""
    cols = [c for c in existing.columns if c != "cv_file_id"]
    a = existing.select("cv_file_id", F.struct(*cols).alias("_old"))
    b = new.select("cv_file_id", F.struct(*cols).alias("_new"))
    return a.join(b, "cv_file_id", "full").select("cv_file_id", F.coalesce("_new", "_old").alias("r")).select("cv_file_id", "r.*")


def write_candidates(new: DataFrame, path: str) -> None:
    """Upsert results into a table partitioned by tenant: only the tenants of ``new`` are read and written.

    ``new`` has one row per file. The merged partitions are written to the shared folder before they replace the
    ones they were read from.
    """
    spark = new.sparkSession
    merged = new
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        merged = upsert_candidates(touched_tenants(spark.read.schema(new.schema).parquet(path), new), new)
    checkpointed(merged).repartition("workspace_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def touched_tenants(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the tenants that ``new`` names. Their ids, of which the table has a folder each, prune the partitions read."""
    ids = [r[0] for r in new.select("workspace_id").distinct().collect()]
    return existing.where(F.col("workspace_id").isin(ids)).select(*new.columns)


def export_log(rows: DataFrame, user_id: int, sheet: str) -> DataFrame:
    return rows.agg(F.lit(user_id).cast("bigint").alias("user_id"), F.lit(sheet).alias("sheet_title"), F.count("*").alias("row_count"))
