"""Registered queries: evaluation of labelled runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..operators import evaluation as op
from ..sources.taxonomy import built_in
from ..sources.views import view
from . import sql as S
from .out import plain

QUERIES, ORACLE = {}, {}
TAX = built_in()


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


def rows(spark, sf):
    return view(spark, sf, "result_row")


def outcomes(spark, sf):
    return op.field_outcome(rows(spark, sf), TAX)


N = lambda c: f"lower({S.squeeze(c)})"
GONE = lambda c: f"coalesce({N(c)}, '') IN ('', 'not found')"


def _judge(f: str, same: str, failed: str) -> str:
    return f"""SELECT doc_id, engine, traits, needs_review, failed, '{f}' AS field, CASE WHEN {failed} THEN 'falseNegative' WHEN truth_{f} IS NULL THEN CASE WHEN {GONE(f'got_{f}')} THEN 'trueNegative' ELSE 'falsePositive' END
      WHEN {GONE(f'got_{f}')} THEN 'falseNegative' WHEN {same} THEN 'truePositive' ELSE 'wrongValue' END AS outcome FROM judged"""


def _out(failed: str) -> str:
    return " UNION ALL ".join([
        _judge("name", f"{N('got_name')} = {N('truth_name')}", failed),
        _judge("phone", "regexp_replace(got_phone, '[^0-9]', '', 'g') LIKE '%' || right(regexp_replace(truth_phone, '[^0-9]', '', 'g'), 10)", failed),
        _judge("role", f"contains({N('got_role')}, {N('truth_role')}) OR coalesce(want = got, false)", failed)])


X = {
    "probe_title": "SELECT truth_role AS title FROM result_row WHERE truth_role IS NOT NULL UNION ALL SELECT got_role FROM result_row",
    "judged": "SELECT r.*, a.canonical AS want, b.canonical AS got FROM result_row r LEFT JOIN matched a ON a.title = r.truth_role LEFT JOIN matched b ON b.title = r.got_role",
    "outcome": _out("failed"), "rejudged": _out("false"),
    "perdoc": """SELECT doc_id, engine, bool_and(outcome LIKE 'true%' AND NOT failed) AS all_ok, any_value(traits) AS traits, any_value(needs_review) AS needs_review, any_value(failed) AS failed,
       coalesce(string_agg(field, ',' ORDER BY field) FILTER (outcome NOT LIKE 'true%' OR failed), '') AS missed FROM outcome GROUP BY doc_id, engine""",
    "counted": """SELECT engine, field, count(*) FILTER (outcome = 'truePositive') AS tp, count(*) FILTER (outcome = 'wrongValue') AS wv, count(*) FILTER (outcome = 'falseNegative') AS fn,
       count(*) FILTER (outcome = 'falsePositive') AS fp, count(*) FILTER (outcome = 'trueNegative') AS tn FROM outcome GROUP BY engine, field""",
    "pr": "SELECT *, CASE WHEN tp + wv + fp = 0 THEN 1 ELSE tp / (tp + wv + fp) END AS pre, CASE WHEN tp + wv + fn = 0 THEN 1 ELSE tp / (tp + wv + fn) END AS rec FROM counted",
}


@query("corpus_generate", "SELECT doc_id, workspace_id, file_name, text, truth_name, truth_phone, truth_role, array_to_string(traits, ' | ') AS traits FROM cv_text")
def _(spark, sf):
    return view(spark, sf, "cv_text").drop("ocr_confidence")


@query("field_outcome", "SELECT doc_id, engine, field, outcome FROM outcome", **X)
def _(spark, sf):
    return outcomes(spark, sf).select("doc_id", "engine", "field", "outcome")


@query("prf", """SELECT engine, field, tp AS "truePositive", wv AS "wrongValue", fn AS "falseNegative", fp AS "falsePositive", tn AS "trueNegative", pre AS precision, rec AS recall,
   (tp + tn) / (tp + wv + fn + fp + tn) AS accuracy, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS f1 FROM pr""", **X)
def _(spark, sf):
    return op.prf(outcomes(spark, sf))


@query("all_fields_correct", "SELECT engine, count(*) AS n, count(*) FILTER (all_ok) AS ok, count(*) FILTER (all_ok) / count(*) AS rate, count(*) FILTER (needs_review OR failed) AS flagged, count(*) FILTER (failed) AS failures FROM perdoc GROUP BY engine", **X)
def _(spark, sf):
    return op.all_fields_correct(outcomes(spark, sf))


@query("accuracy_by_trait", "SELECT engine, trait, count(*) FILTER (all_ok) AS ok, count(*) AS n, count(*) FILTER (all_ok) / count(*) AS rate FROM (SELECT engine, all_ok, unnest(traits) AS trait FROM perdoc) t GROUP BY engine, trait HAVING count(*) >= 3", **X)
def _(spark, sf):
    return op.accuracy_by_trait(outcomes(spark, sf))


@query("latency_percentiles", "SELECT engine, sum(total_ms) / count(*) AS mean, " + ", ".join(f"quantile_disc(total_ms, {p / 100}) AS p{p}" for p in (50, 95, 99)) + ", max(total_ms) AS max FROM result_row GROUP BY engine")
def _(spark, sf):
    return op.latency_percentiles(rows(spark, sf))


@query("latency_sketch", "SELECT engine, count(*) AS n, true AS p50_ok, true AS p95_ok, true AS p99_ok FROM result_row GROUP BY engine")
def _(spark, sf):
    given = rows(spark, sf)
    daily = op.latency_sketches(given.withColumn("day", F.col("doc_id") % 30), ["engine", "day"])
    errors = op.rank_errors(given, op.merged_percentiles(daily))
    return errors.select("engine", "n", *[(F.col(f"p{p}_off") <= op.RANK_ERROR).alias(f"p{p}_ok") for p in (50, 95, 99)])


@query("miss_sample", "SELECT doc_id, engine, missed FROM perdoc WHERE NOT all_ok ORDER BY doc_id, engine LIMIT 15", **X)
def _(spark, sf):
    return op.miss_sample(outcomes(spark, sf))


@query("rescore", """SELECT engine, field, count(*) FILTER (outcome LIKE 'true%') AS correct, count(*) FILTER (outcome = 'wrongValue') AS wrong, count(*) FILTER (outcome = 'falseNegative') AS missed,
   count(*) FILTER (outcome = 'falsePositive') AS invented FROM rejudged GROUP BY engine, field""", **X)
def _(spark, sf):
    return op.rescore(rows(spark, sf), TAX)


@query("head_to_head", """SELECT field, local, remote, local - remote AS delta FROM (SELECT field, count(*) FILTER (ok AND engine = 'local') / count(*) FILTER (engine = 'local') AS local,
   count(*) FILTER (ok AND engine = 'remote') / count(*) FILTER (engine = 'remote') AS remote FROM (SELECT field, engine, outcome LIKE 'true%' AS ok FROM rejudged
     UNION ALL SELECT 'all', engine, bool_and(outcome LIKE 'true%') FROM rejudged GROUP BY doc_id, engine) x GROUP BY field) y""", **X)
def _(spark, sf):
    return op.head_to_head(rows(spark, sf), TAX, "local", "remote")


@query("slice_role_accuracy", "SELECT engine, count(*) FILTER (outcome LIKE 'true%') AS ok, count(*) AS n FROM outcome WHERE field = 'role' AND list_contains(traits, 'current_role_only') GROUP BY engine", **X)
def _(spark, sf):
    return op.slice_role_accuracy(outcomes(spark, sf), "current_role_only")


@query("model_ranking", """SELECT engine, score, errors, avg_ms, rank() OVER (ORDER BY score DESC, avg_ms) AS rank FROM (SELECT engine, count(*) FILTER (outcome LIKE 'true%' AND NOT failed) AS score FROM outcome GROUP BY engine) s
   JOIN (SELECT engine AS e, count(*) FILTER (failed) AS errors, sum(total_ms) FILTER (NOT failed) / count(*) FILTER (NOT failed) AS avg_ms FROM result_row GROUP BY engine) t ON t.e = s.engine""", **X)
def _(spark, sf):
    return op.model_ranking(outcomes(spark, sf), rows(spark, sf))


@query("token_cost", "SELECT model, n AS documents, t AS input_tokens, n * 80 AS output_tokens, round((t * pin + n * 80 * pout) / n / 1000000, 8) AS cost_per_cv, round((t * pin + n * 80 * pout) / n / 1000000 * 10000, 4) AS cost_per_month FROM (SELECT count(*) AS n, sum((length(text) + 2158) // 4)::bigint AS t FROM cv_text) d, (VALUES "
       + ", ".join(f"('{m}', {i}::double, {o}::double)" for m, i, o in V.MODEL_PRICES) + ") p(model, pin, pout)")
def _(spark, sf):
    return op.token_cost(view(spark, sf, "cv_text"), 10000)
