"""A keyed table that micro-batches change: hash buckets, written by batch, listed in a manifest.

Batch ``n`` owns the folders ``data/batch=n/bucket=b`` of the buckets whose keys it changes, with the rows it
changes. A bucket's content is what the parts in its manifest entry hold, the newest row per key. Once the
added rows outgrow a share of the bucket's first part, the batch writes the bucket whole (``whole/batch=n``)
and its entry starts over. Manifest ``n`` is written last and makes the batch count; it is made from manifest
``n - 1`` alone, so a batch that is replayed reads the same and writes the same. Work follows the keys that
arrive: buckets they do not fall in are neither read nor written, and a bucket is rewritten only after
rows in proportion to its size have come. Choose ``buckets`` so that one holds some 100,000 keys; the manifest
has one row for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

MANIFEST = "bucket int, parts array<string>, base long, added long"
#: Of a bucket: the folders that hold it, rows of the first of them, and of all others.
Entry = tuple[list[str], int, int]


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` holds the keys and all other columns, of types that can be ordered."""

    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64
    #: A bucket is written whole when its added rows exceed this share of its first part, or lie in more parts than this.
    share: float = 0.5
    parts: int = 16

    @property
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("_batch", IntegerType())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession, n: int) -> dict[int, Entry]:
        """Entries by bucket after batch ``n``; there are none before the first."""
        if n < 0:
            return {}
        return {r.bucket: (list(r.parts), r.base, r.added) for r in spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/batch={n}").collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall in."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def folders(self, spark: SparkSession, n: int, only: list[int] | None = None) -> list[str]:
        """What has to be read for some buckets, or for all, after batch ``n``."""
        listed = self.manifest(spark, n)
        return [f"{self.path}/{part}/bucket={b}" for b in (listed if only is None else only) if b in listed for part in listed[b][0]]

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in self._stored.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("_batch", *[c for c in names if c != "_batch"])).alias("_r"))
        return newest.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in names])

    def read(self, spark: SparkSession, n: int, only: list[int] | None = None) -> DataFrame:
        """The newest row per key after batch ``n``, of some buckets or of all."""
        paths = self.folders(spark, n, only)
        if not paths:
            return spark.createDataFrame([], self.schema)
        return self._newest(spark.read.schema(self._stored).parquet(*paths)).select(*self.schema.names)

    def held(self, rows: DataFrame, n: int) -> DataFrame:
        """What was known before batch ``n`` of the keys of ``rows``; only the buckets they fall in are read."""
        keys = rows.select(*self.keys)
        return self.read(rows.sparkSession, n - 1, self.touched(keys)).join(keys, list(self.keys), "left_semi")

    def write(self, changed: DataFrame, n: int) -> dict[int, Entry]:
        """Add the rows of batch ``n``, one for each key it changes, and make them count."""
        spark, old = changed.sparkSession, self.manifest(changed.sparkSession, n - 1)
        new = changed.select(*self.schema.names, F.lit(n).alias("_batch"), self._bucket().alias("bucket"))
        now = {b: (old[b][0] + [part], old[b][1], old[b][2] + rows) if b in old else ([part], rows, 0) for b, part, rows in self._put(new, "data", n)}
        full = [b for b, (parts, base, added) in now.items() if added > self.share * base or len(parts) > self.parts]
        if full:
            paths = [f"{self.path}/{part}/bucket={b}" for b in full for part in now[b][0]]
            whole = self._newest(spark.read.schema(self._stored).parquet(*paths)).withColumn("bucket", self._bucket())
            now |= {b: ([part], rows, 0) for b, part, rows in self._put(whole, "whole", n)}
        entries = [(b, *x) for b, x in sorted((old | now).items())]
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={n}")
        return old | now

    def _put(self, rows: DataFrame, kind: str, n: int) -> list[tuple[int, str, int]]:
        """Write the rows of a batch by bucket: bucket, folder and count."""
        at = f"{self.path}/{kind}/batch={n}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        counted = rows.sparkSession.read.schema(StructType([*rows.schema.fields])).parquet(at).groupBy("bucket").agg(F.count("*").alias("n"))
        return [(r.bucket, f"{kind}/batch={n}", r["n"]) for r in counted.collect()]

    def vacuum(self, spark: SparkSession, n: int, keep: int = 2) -> int:
        """Remove bucket folders up to batch ``n`` that none of the last ``keep`` manifests lists; returns how many.

        Batches before those can then no longer be read or replayed.
        """
        wanted = {f"{part}/bucket={b}" for k in range(max(0, n - keep + 1), n + 1) for b, (parts, *_) in self.manifest(spark, k).items() for part in parts}
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
        for kind in ("data", "whole"):
            for k in range(n + 1):
                at = jvm.org.apache.hadoop.fs.Path(root, f"{kind}/batch={k}")
                for entry in files.listStatus(at) if files.exists(at) else []:
                    name = entry.getPath().getName()
                    if name.startswith("bucket=") and f"{kind}/batch={k}/{name}" not in wanted:
                        gone += files.delete(entry.getPath(), True)
        return gone
