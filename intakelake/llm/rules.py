"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

Each text gives whole-number measures. A sketch counts, for a group and a measure, the values in
buckets of 1/16 relative width (whole numbers below 16 are exact); adding counts merges sketches, so a
group with few texts takes the sketch of its language, or else of everything. A measure fails above
``q75 + FENCE * max(q75 - q25, floor)``, mean word length also below ``q25 - ...``: the quartiles say
what is usual in the group, and a text fails only far outside. Thresholds are joined to the texts.

Only texts that pass the base rules go into the sketches. Defined cases: a null text has no words and
fails; null language or source is a group of its own; repeated rows are judged each; extra columns
are not read by :func:`judged` and stay untouched in :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_pass, fresh, plus, utf8, written

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Measures and the smallest spread each is credited with.
FLOORS = {"word_length": 50, "symbol_share": 100, "dup_line_share": 500, "repeat_share": 500}
#: Measures that also have a lower threshold.
TWO_SIDED = {"word_length"}
FENCE, MIN_GROUP = 4, 200


def count_text(text: bytes) -> tuple[int, ...]:
    """The six counts of ``COUNTS``."""
    words = text.split()  # at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, pair = np.unique(code[:-2] * len(ids) + code[1:-1], return_inverse=True)
        _, window, times = np.unique(pair * len(ids) + code[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + n - 2] |= again
        repeat = int(cover.sum())
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat


def with_counts(docs: DataFrame, name: str = "_counts") -> DataFrame:
    """``docs`` with the counts of its texts in a struct of that name."""
    schema = plus(docs, **{name: ", ".join(f"{c}: bigint" for c in COUNTS).join(["struct<", ">"])})
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([count_text(x) for x in utf8(b.column(at))], np.int64).reshape(-1, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(COUNTS))], COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, counts], schema.names)

    return arrow_pass(docs, run, schema)


def base_failed(c) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words"))


def measures(c) -> dict[str, Column]:
    """Hundredths of a character, and shares in 1/10000, as whole numbers."""
    share = lambda a, b: F.floor(10000 * a / F.greatest(b, F.lit(1)))
    return {"word_length": F.floor(100 * c("word_chars") / F.greatest(c("n_words"), F.lit(1))), "symbol_share": share(c("n_symbols"), c("word_chars")),
            "dup_line_share": share(c("n_dup_lines"), c("n_lines")), "repeat_share": share(c("n_repeat_words"), c("n_words"))}


def bucket(x: Column) -> Column:
    """Largest bucket start at or below ``x``: five leading bits."""
    low = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, low), low)


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the merged sketch of every group."""
    own = stats.where(~base_failed(F.col))
    tall = own.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), m.cast("long").alias("x")) for k, m in measures(F.col).items()])))
    return tall.groupBy("lang", "source", "measure", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """n, q25 and q75 for each group: the bucket that holds the row of rank ceil(q * n)."""
    group = Window.partitionBy(*by, "measure")
    run = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
    return run.groupBy(*by, "measure").agg(F.max("all").alias("n"), at(25).alias("q25"), at(75).alias("q75"))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source and a low and high limit for each measure, one row for each group with a text that passes the base rules."""
    sketch = written(sketches(stats), "sketch")
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(f).alias("floor"), F.lit(k in TWO_SIDED).alias("two")) for k, f in FLOORS.items()])
    groups = sketch.select("lang", "source").distinct().select("lang", "source", F.inline(rows))
    level = lambda by, name: _quartiles(sketch, by).select(*[F.col(c).alias(f"{name}_{c}") for c in [*by, "measure"]], F.struct("n", "q25", "q75").alias(name))
    for by, name in ((["lang", "source"], "own"), (["lang"], "language"), ([], "every")):
        on = F.col("measure") == F.col(f"{name}_measure")
        for c in by:
            on &= F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
        groups = groups.join(level(by, name), on, "left").drop(*[f"{name}_{c}" for c in [*by, "measure"]])
    use = F.when(F.col("own.n") >= MIN_GROUP, F.col("own")).when(F.col("language.n") >= MIN_GROUP, F.col("language")).otherwise(F.col("every"))
    limits = groups.withColumn("use", use).withColumn("reach", FENCE * F.greatest(F.col("use.q75") - F.col("use.q25"), "floor"))
    limits = limits.select("lang", "source", "measure", F.when(F.col("two"), F.col("use.q25") - F.col("reach")).alias("low"), (F.col("use.q75") + F.col("reach")).alias("high"))
    each = [F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}") for k in FLOORS for side in ("low", "high")]
    return limits.groupBy("lang", "source").agg(*each)


def within(c, limit) -> Column:
    """Passes the base rules and lies inside the limits of its group."""
    ok = ~base_failed(c)
    for k, m in measures(c).items():
        ok &= (m <= limit(f"{k}_high")) & ((m >= limit(f"{k}_low")) if k in TWO_SIDED else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row."""
    stats = written(with_counts(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "_counts.*"), "counts")
    limits = thresholds(stats).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct("*").alias("_limit"))
    met = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return met.select("doc_id", *COUNTS, base_failed(F.col).alias("base_failed"), within(F.col, lambda k: F.col(f"_limit.{k}")).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, untouched.

    Texts are counted twice, once for the sketches and once beside the row, so that no text is
    shuffled to meet its verdict; the joined thresholds are one row for each group.
    """
    counts, limit = fresh(docs, "_counts"), fresh(docs, "_limit")
    counted = with_counts(docs, counts)
    limits = written(thresholds(counted.select("lang", "source", f"{counts}.*")), "limits").select(F.struct("*").alias(limit))
    met = counted.join(limits, F.col("lang").eqNullSafe(F.col(f"{limit}.lang")) & F.col("source").eqNullSafe(F.col(f"{limit}.source")), "left")
    return met.where(within(lambda k: F.col(f"{counts}.{k}"), lambda k: F.col(f"{limit}.{k}"))).select(*docs.columns)
