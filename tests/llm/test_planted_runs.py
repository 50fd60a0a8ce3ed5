"""The query of runs takes texts without words too: nothing is planted in them."""

from __future__ import annotations

import hashlib
import zlib

from intakelake.llm import queries

SHA0 = hashlib.sha256(b"").hexdigest()


def test_texts_without_words(spark, tmp_path):
    picked = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = list(zip(picked, [None, "", " \n\t ", "one"])) + [(1, None), (2, ""), (None, "x"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {tuple(r) for r in queries.op13_runs(spark, str(tmp_path)).collect()}
    kept = lambda text: hashlib.sha256(" ".join((text or "").split()).encode()).hexdigest()
    assert out == {(i, 0, None, None, None, None, SHA0, kept(text)) for i, text in rows}
