"""File sources: stored objects, labelled corpora, arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.files import sniff_mime
from ..session import checkpointed

TRUTH_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("layout", T.StringType()),
    T.StructField("expected", T.StructType([T.StructField(f, T.StringType()) for f in ("name", "phone", "role")])),
    T.StructField("traits", T.ArrayType(T.StringType())),
])
CORPUS_SCHEMA = T.StructType([T.StructField("count", T.LongType()), T.StructField("entries", T.ArrayType(TRUTH_SCHEMA))])


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Stored objects by key. The bytes are read only where ``content`` is used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("key"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


MANIFEST = "path string, size long, modified_at timestamp, sha256 string, kind string"
#: Paths named at a time where files come with an older time than those known.
GROUP = 1000


def refresh_manifest(spark: SparkSession, folder: str, to: str, was: str | None = None) -> None:
    """What a folder holds (path, size, time, hash of the content and kind by its first bytes), as a table at ``to``.

    Files that the manifest ``was`` lists with their size and time are taken from it unread; those that are gone
    drop out. New and changed ones are read: by their time, which the scan of the folder filters on before it opens
    a file, and one by one where they are older than what was known. Files without a byte are not listed.
    """

    def objects(*paths: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))

    def looked_at(files: DataFrame) -> DataFrame:
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), sniff_mime(F.col("content"), F.col("path")).alias("kind"))

    if was is None:
        looked_at(objects(folder)).write.parquet(to)
        return
    known, key = spark.read.schema(MANIFEST).parquet(was), ["path", "size", "modified_at"]
    last = known.agg(F.max("modified_at")).first()[0]
    held = objects(folder)  # the folder is listed once for all that follows
    listed = held.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    known.join(listed, key, "left_semi").write.parquet(to)
    newer = held if last is None else held.where(F.col("modificationTime") >= F.lit(last))
    looked_at(newer).join(known, key, "left_anti").write.mode("append").parquet(to)
    group: list[str] = []
    # found by all tasks and written, then read one by one: a local iterator runs its parts one after the other
    older = checkpointed(listed.where(F.col("modified_at") < F.lit(last)).join(known, key, "left_anti").select("path")) if last else None
    for row in older.toLocalIterator() if older else ():
        group.append(row[0])
        if len(group) == GROUP:
            looked_at(objects(*group)).write.mode("append").parquet(to)
            group = []
    if group:
        looked_at(objects(*group)).write.mode("append").parquet(to)


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus file. A null expectation means that ``Not Found`` is the right answer."""
    doc = spark.read.schema(CORPUS_SCHEMA).option("multiLine", "true").json(path)
    return truth_rows(doc.select(F.explode("entries").alias("e")), F.col("e"))


def truth_rows(df: DataFrame, entry: Column) -> DataFrame:
    e = df.select(entry.alias("e"))
    return e.select("e.file", "e.layout", F.col("e.expected.name").alias("name"), F.col("e.expected.phone").alias("phone"), F.col("e.expected.role").alias("role"), "e.traits")


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Newly arrived files of a folder as a stream."""
    return (
        spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    )
