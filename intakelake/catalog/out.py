"""Plain output columns (lists become text, timestamps become text, integers become bigint), and folders to write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder


def plain(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            shown = F.transform(c, lambda a: F.concat(a["value"], F.lit("="), a["confidence"].cast("string")))
            c = F.array_join(shown, " | ")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), " | ")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
