"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tuned(spark: SparkSession) -> SparkSession:
    """Settings every job of this package expects.

    Timestamps are UTC. Constraint propagation is off: over long chains of pattern columns it
    takes most of the planning time, and these plans state their null filters themselves.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # sessions of a busy key are merged before the shuffle
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A local session without that setting, as in tests, gets a temporary one; a cluster must name its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: its lineage ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
