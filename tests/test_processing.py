"""What the composed job and the manifest leave undone where nobody asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrameReader

from intakelake.plans import processing
from intakelake.sources.files import refresh_manifest

PAGES = "doc_id long, page_no int, text string, ocr_text string, confidence_pct long"


def test_failures_extract_nothing(spark, monkeypatch):
    def never(*_):
        raise AssertionError("failures need no extraction")

    monkeypatch.setattr(processing, "parse_documents", never)
    pages = spark.createDataFrame([(1, 0, "", "", 90), (2, 0, "Asha Rao, who keeps the ledgers of a mill in order", "", 90)], PAGES)
    files = spark.createDataFrame([(1, "a.docx", "application/pdf"), (2, "b.docx", "application/pdf")], "doc_id long, file_name string, mime_type string")
    out = processing.process_documents(pages, files, spark.range(0))
    assert [(r[0], r[1], r[2]) for r in out.failures.collect()] == [(1, "NO_TEXT", 0)]


def test_manifest_lists_the_folder_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("one")
    refresh_manifest(spark, str(folder), str(tmp_path / "m0"))
    (folder / "b").write_text("two")
    loads, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: loads.append(a) or load(self, *a, **k))
    refresh_manifest(spark, str(folder), str(tmp_path / "m1"), str(tmp_path / "m0"))
    assert len(loads) == 1 and spark.read.parquet(str(tmp_path / "m1")).count() == 2
