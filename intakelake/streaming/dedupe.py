"""First arrivals by content, exact, without keeping every key as state.

Contents seen lie in a :class:`KeyedStore`. A Bloom filter of a fixed size stands before it: most new
contents miss it and are new for certain; only those that hit it are looked for in the buckets they fall in.
The filter is read and written whole by every trigger, BITS / 8 bytes at most; the fuller it is, the more keys
are looked up, and nothing else changes. Trigger ``n`` reads the filter and the store of trigger ``n - 1``
and owns its folders, so a replay gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from .store import KeyedStore

#: Bits of the filter, positions of a key in it, and bits of one of its rows.
BITS, POSITIONS, ROW = 1 << 26, 3, 32768
FILTER = "part int, bits binary"


def positions(keys: DataFrame, names: list[str]) -> DataFrame:
    """Each key with its positions, as part and bit within."""
    at = F.array(*[F.pmod(F.xxhash64(F.lit(i), *names), F.lit(BITS)) for i in range(POSITIONS)])
    spread = keys.select(*names, F.explode(at).alias("at"))
    return spread.select(*names, F.floor(F.col("at") / ROW).cast("int").alias("part"), (F.col("at") % ROW).cast("int").alias("bit"))


def suspects(keys: DataFrame, names: list[str], filters: DataFrame) -> DataFrame:
    """Keys all of whose positions are set. ``filters`` has BITS / ROW rows at most and is broadcast."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, F.col("bit") % 8).bitwiseAND(F.lit(1))
    hit = positions(keys, names).join(F.broadcast(filters), "part").where(set_ == 1)
    return hit.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") == POSITIONS).select(*names)


def first_arrivals(stream: DataFrame, names: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The first row of each key over all triggers, by ``order`` within a trigger; the keys hold no nulls."""
    store = seen_contents(path, stream.schema, names, buckets)
    rest = [c for c in stream.columns if c not in names and c not in order]

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*names).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*names, "_r.*")
        new, old = first, spark.createDataFrame([], FILTER)
        if n > 0:
            old = spark.read.schema(FILTER).parquet(f"{path}/filter/batch={n - 1}")
            known = store.held(suspects(first.select(*names), names, old), n)
            new = first.join(known.select(*names), names, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        new = spark.read.schema(first.schema).parquet(f"{path}/out/batch={n}")
        added = positions(new, names).groupBy("part").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
        old.unionByName(added).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).write.mode("overwrite").parquet(f"{path}/filter/batch={n}")
        store.write(new.select(*names), n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_contents(path: str, schema: StructType, names: list[str], buckets: int = 64) -> KeyedStore:
    return KeyedStore(f"{path}/seen", tuple(names), StructType([StructField(x, schema[x].dataType) for x in names]), buckets)


def arrived(spark: SparkSession, path: str) -> DataFrame:
    """First arrivals of the triggers that the store has taken in."""
    whole = spark.read.parquet(f"{path}/seen/manifest").select("batch").distinct()
    return spark.read.parquet(f"{path}/out").join(F.broadcast(whole), "batch", "left_semi").drop("batch")
