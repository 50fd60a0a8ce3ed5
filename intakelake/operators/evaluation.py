"""Scoring answers against labels, and comparing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions.phones import digits_of
from ..functions.regex import squeeze
from ..session import checkpointed
from ..sources.taxonomy import Taxonomy
from .taxonomy import role_match

FIELDS = ["name", "phone", "role"]
#: Distinct resolved titles up to which they are broadcast.
BROADCAST_ROWS = 50_000
RIGHT = ["truePositive", "trueNegative"]


def _norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def with_canonical(rows: DataFrame, tax: Taxonomy) -> DataFrame:
    """Resolve wanted and given roles: every distinct title once, then joined back."""
    titles = rows.select(F.explode(F.array_compact(F.array("truth_role", "got_role"))).alias("title")).distinct()
    canon = checkpointed(role_match(titles, ["title"], "title", tax).filter(F.col("m_canonical").isNotNull()).select("title", "m_canonical"))
    want = canon.select(F.col("title").alias("truth_role"), F.col("m_canonical").alias("_want"))
    got = canon.select(F.col("title").alias("got_role"), F.col("m_canonical").alias("_got"))
    small = canon.count() <= BROADCAST_ROWS
    for title, side in (("truth_role", want), ("got_role", got)):
        # absent answers match nothing: they are dealt by document instead of meeting in one task
        absent = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(1024)).cast("string"))
        key = F.when(F.col(title).isNull() | (F.col(title) == V.NOT_FOUND), absent).otherwise(F.col(title))
        side = side.withColumnRenamed(title, "_title")
        rows = rows.withColumn("_key", key).join(F.broadcast(side) if small else side, F.col("_key") == F.col("_title"), "left").drop("_key", "_title")
    return rows


def field_outcome(rows: DataFrame, tax: Taxonomy) -> DataFrame:
    """One row per document, run and field with its outcome. A failed run misses every field."""
    r = with_canonical(rows, tax)
    same_role = F.contains(_norm(F.col("got_role")), _norm(F.col("truth_role"))) | F.coalesce(_norm(F.col("_want")) == _norm(F.col("_got")), F.lit(False))
    same = {
        "name": _norm(F.col("got_name")) == _norm(F.col("truth_name")),
        "phone": F.endswith(digits_of(F.col("got_phone")), F.right(digits_of(F.col("truth_phone")), F.lit(10))),
        "role": same_role,
    }

    def outcome(f: str) -> Column:
        none = F.coalesce(_norm(F.col(f"got_{f}")), F.lit("")).isin("", V.NOT_FOUND.lower())
        return (
            F.when(F.col("failed"), "falseNegative")
            .when(F.col(f"truth_{f}").isNull(), F.when(none, "trueNegative").otherwise("falsePositive"))
            .when(none, "falseNegative").when(same[f], "truePositive").otherwise("wrongValue")
        )

    three = F.array(*[F.struct(F.lit(f).alias("field"), outcome(f).alias("outcome")) for f in FIELDS])
    return r.select("doc_id", "engine", "traits", "needs_review", "failed", F.inline(three))


def prf(outcomes: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("outcome") == k) for k in ("truePositive", "wrongValue", "falseNegative", "falsePositive", "trueNegative")}
    g = outcomes.groupBy("engine", "field").agg(*[c.alias(k) for k, c in n.items()])
    tp, wv, fn, fp, tn = (F.col(k) for k in n)
    produced, wanted = tp + wv + fp, tp + wv + fn
    p = F.when(produced == 0, 1.0).otherwise(tp / produced)
    r = F.when(wanted == 0, 1.0).otherwise(tp / wanted)
    g = g.withColumn("precision", p).withColumn("recall", r).withColumn("accuracy", (tp + tn) / (wanted + fp + tn))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def per_document(outcomes: DataFrame) -> DataFrame:
    right = F.col("outcome").isin(*RIGHT) & ~F.col("failed")
    return outcomes.groupBy("doc_id", "engine").agg(
        F.min(right).alias("all_ok"), F.first("traits").alias("traits"), F.first("needs_review").alias("needs_review"), F.first("failed").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~right, F.col("field")))), ",").alias("missed"))


def all_fields_correct(outcomes: DataFrame) -> DataFrame:
    d = per_document(outcomes)
    ok = F.count_if("all_ok")
    return d.groupBy("engine").agg(F.count("*").alias("n"), ok.alias("ok"), (ok / F.count("*")).alias("rate"),
                                   F.count_if(F.col("needs_review") | F.col("failed")).alias("flagged"), F.count_if("failed").alias("failures"))


def accuracy_by_trait(outcomes: DataFrame, least: int = 3) -> DataFrame:
    t = per_document(outcomes).select("engine", "all_ok", F.explode("traits").alias("trait"))
    ok = F.count_if("all_ok")
    return t.groupBy("engine", "trait").agg(ok.alias("ok"), F.count("*").alias("n"), (ok / F.count("*")).alias("rate")).filter(F.col("n") >= least)


def latency_percentiles(rows: DataFrame, value: str = "total_ms", points: tuple = (50, 95, 99)) -> DataFrame:
    """Mean, maximum and nearest-rank percentiles per run, from counts of each distinct millisecond."""
    counts = rows.groupBy("engine", F.col(value).alias("ms")).agg(F.count("*").alias("c"))
    run = Window.partitionBy("engine").orderBy("ms")
    cum = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy("engine")))
    rank = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("n") * p, F.col("ms"))).alias(f"p{p}")
    return cum.groupBy("engine").agg((F.sum(F.col("ms") * F.col("c")) / F.sum("c")).alias("mean"), *[rank(p) for p in points], F.max("ms").alias("max"))


#: Size of a quantile sketch, and the share of the rows by which a rank it gives may be off (with a certainty of 99 %).
SKETCH_SIZE, RANK_ERROR = 2000, 0.002


def latency_sketches(rows: DataFrame, keys: list[str], value: str = "total_ms") -> DataFrame:
    """One quantile sketch for each group, of bounded size whatever the number of rows; groups merge by :func:`merged_percentiles`."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), SKETCH_SIZE).alias("sketch"), F.count("*").alias("n"))


def merged_percentiles(sketches: DataFrame, points: tuple = (50, 95, 99)) -> DataFrame:
    """Percentiles per run of any number of sketches, without going back to the rows."""
    one = sketches.groupBy("engine").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))
    return one.select("engine", "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(f"p{p}") for p in points])


def rank_errors(rows: DataFrame, estimates: DataFrame, value: str = "total_ms", points: tuple = (50, 95, 99)) -> DataFrame:
    """How far, as a share of the rows, the rank of each estimate lies from the one asked for."""
    met = rows.select("engine", value).join(F.broadcast(estimates), "engine")
    out = []
    for p in points:
        low, high = F.count_if(F.col(value) < F.col(f"p{p}")), F.count_if(F.col(value) <= F.col(f"p{p}"))
        out.append((F.greatest(low - F.col("n") * p / 100, F.col("n") * p / 100 - high, F.lit(0.0)) / F.col("n")).alias(f"p{p}_off"))
    return met.groupBy("engine", "n").agg(*out)


def miss_sample(outcomes: DataFrame, n: int = 15) -> DataFrame:
    return per_document(outcomes).filter(~F.col("all_ok")).orderBy("doc_id", "engine").limit(n).select("doc_id", "engine", "missed")


def rescore(rows: DataFrame, tax: Taxonomy) -> DataFrame:
    """Stored answers judged again: correct, wrong, missed or invented per field."""
    o = field_outcome(rows.withColumn("failed", F.lit(False)), tax)
    count = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return o.groupBy("engine", "field").agg(count(*RIGHT).alias("correct"), count("wrongValue").alias("wrong"), count("falseNegative").alias("missed"), count("falsePositive").alias("invented"))


def head_to_head(rows: DataFrame, tax: Taxonomy, a: str, b: str) -> DataFrame:
    """Accuracy of two runs and their difference, per field and for all fields together."""
    o = field_outcome(rows.withColumn("failed", F.lit(False)), tax).filter(F.col("engine").isin(a, b))
    right = F.col("outcome").isin(*RIGHT)
    whole = o.groupBy("doc_id", "engine").agg(F.min(right).alias("right")).select("engine", F.lit("all").alias("field"), "right")
    both = o.select("engine", "field", right.alias("right")).unionByName(whole)
    rate = lambda e: (F.count_if(F.col("right") & (F.col("engine") == e)) / F.count_if(F.col("engine") == e)).alias(e)
    return both.groupBy("field").agg(rate(a), rate(b)).withColumn("delta", F.col(a) - F.col(b))


def slice_role_accuracy(outcomes: DataFrame, trait: str) -> DataFrame:
    s = outcomes.filter((F.col("field") == "role") & F.array_contains("traits", trait))
    return s.groupBy("engine").agg(F.count_if(F.col("outcome").isin(*RIGHT)).alias("ok"), F.count("*").alias("n"))


def model_ranking(outcomes: DataFrame, timings: DataFrame) -> DataFrame:
    """Runs by fields right, then by mean time of the calls that did not fail."""
    score = outcomes.groupBy("engine").agg(F.count_if(F.col("outcome").isin(*RIGHT) & ~F.col("failed")).alias("score"))
    live = ~F.col("failed")
    t = timings.groupBy("engine").agg(F.count_if("failed").alias("errors"), (F.sum(F.when(live, F.col("total_ms"))) / F.greatest(F.count_if(live), F.lit(1))).alias("avg_ms"))
    # one row per run: the ranking window sees only those
    return score.join(t, "engine").withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"), "avg_ms")))


def token_cost(texts: DataFrame, monthly: int) -> DataFrame:
    """Tokens and cost of sending every text to each priced model."""
    tokens = F.floor((F.length("text") + V.PROMPT_CHARS) / V.CHARS_PER_TOKEN)
    total = texts.agg(F.count("*").alias("documents"), F.sum(tokens).alias("input_tokens"))
    prices = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("_in"), F.lit(o).alias("_out")) for m, i, o in V.MODEL_PRICES])
    p = total.select("*", F.inline(prices)).withColumn("output_tokens", F.col("documents") * V.REPLY_TOKENS)
    per = (F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out")) / F.col("documents") / 1000000
    return p.select("model", "documents", "input_tokens", "output_tokens", F.round(per, 8).alias("cost_per_cv"), F.round(per * monthly, 4).alias("cost_per_month"))
