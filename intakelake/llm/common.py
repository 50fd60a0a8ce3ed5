"""Helpers the operators share: reading, Arrow passes, written intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import shared_folder

#: Rows and bytes of one Arrow batch; together they bound what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Rows whose crc32(doc_id as text) leaves 0 here are held out of learning.
LABEL_FOLDS, CORPUS_FOLDS = 5, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def plus(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with more columns, each given by name and DDL type."""
    return StructType([*df.schema.fields, *[StructField(name, DataType.fromDDL(kind)) for name, kind in columns.items()]])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it what ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id, folds: int):
    """True where crc32(doc_id as text) mod ``folds`` is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and no lost executor takes it along."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_bytes: int) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels to fit a model on: a bounded sample, the same in every run.

    Of each class at most ``per_class`` rows outside the held-out fold, in the order of a hash of
    doc_id; texts above ``max_bytes`` are left to scoring. So the driver holds at most the sum of
    ``per_class`` times ``max_bytes``. Rows without id, label or text are not learnt from, nor are longer
    texts, and neither take up places; of texts that share an id, the one of the least hash is learnt from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), LABEL_FOLDS))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_label"))
    short = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    fit = written(known.join(short.select("doc_id"), "doc_id", "left_semi"), "labelled")
    pick = None
    for value, n in per_class.items():
        part = fit.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        pick = part if pick is None else pick.union(part)
    rows = short.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "_label").toArrow()
    return utf8(rows.column("text")), rows.column("_label").to_pylist()
