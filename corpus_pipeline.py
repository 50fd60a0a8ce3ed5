"""The document pipeline: each stage works on all its predecessor kept, written and read again between stages."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from intakelake.llm import bpe, mixing, quality_cnn, rules, simhash
from intakelake.llm.common import labelled_sample, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the trained network predicts to be good stay; it learns from the labelled rows of ``docs``.

    Null and empty texts are scored like any other; without labels of both kinds every text scores alike.
    """
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality_cnn.PER_CLASS, quality_cnn.MAX_BYTES)
    return quality_cnn.keep_good(docs.select(*COLUMNS), quality_cnn.fit(*sample))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts inside the thresholds of their language and source stay; the thresholds come from ``docs``.

    Null and short texts fail; a null language or source is a group of its own; repeated rows are judged each.
    """
    return rules.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row with the smallest doc_id, one of rows that are alike.

    A row without doc_id stays only where no other is linked to it; empty and null texts are near copies.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks are due: sorted across and inside the files.

    A null source is a source of its own; null texts take no room; no row is dropped or repeated.
    """
    return mixing.in_order(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens, and the place in the mixture: file and row of the stage before.

    A table that was not read from files has no places; they are null then.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select("doc_id", "source", "text", *_places(docs))
    return bpe.encode(docs, path, public_tokenizers.PATTERN, carry=["source", "mix_file", "mix_row"])


def _places(docs: DataFrame) -> list:
    if docs.inputFiles():
        return [F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row")]
    return [F.lit(None).cast("string").alias("mix_file"), F.lit(None).cast("long").alias("mix_row")]


STAGES = [("quality classifier", quality), ("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("pfair mixture", mixture), ("byte-level bpe", tokens)]

#: Trained models, tries and schedules have no SQL form; the tests check the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
