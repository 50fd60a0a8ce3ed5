"""Registered queries over résumé texts: structure, phone, name, role, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import values as V
from ..functions import names as fn, review as fr, titles as ft
from ..functions.phones import digits_of, impossible, phone_mentions, with_phone
from ..functions.regex import matches
from ..operators import name as on, phone as op, review as rv, role as orole, structure as st, taxonomy as tx
from ..plans.extraction import document_model, extract_fields, fields_of, parse_documents
from ..session import checkpointed
from ..sources.taxonomy import built_in, flatten_taxonomies
from ..sources.views import view
from . import sql as S
from .out import plain

QUERIES, ORACLE = {}, {}
ALL = {"txt": "SELECT doc_id, text FROM all_text"}
TAX = built_in()


def query(key: str, oracle: str | None = None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


def cv(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "cv_text")


def every_text(spark, sf) -> DataFrame:
    return view(spark, sf, "all_text")


def lines(spark, sf, texts=cv) -> DataFrame:
    return st.annotate_lines(texts(spark, sf).select("doc_id", "text"))


# ------------------------------------------------------------------ structure
@query("doc_lines", "SELECT doc_id, idx, text FROM lines_raw", **ALL)
def _(spark, sf):
    return st.doc_lines(every_text(spark, sf)).select("doc_id", "idx", "text")


@query("strip_decoration", "SELECT doc_id, idx, bare FROM lines_kind", **ALL)
def _(spark, sf):
    return st.with_headings(st.doc_lines(every_text(spark, sf))).select("doc_id", "idx", "bare")


@query("detect_section", "SELECT doc_id, idx, kind FROM lines_kind WHERE kind IS NOT NULL", **ALL)
def _(spark, sf):
    return st.with_headings(st.doc_lines(every_text(spark, sf))).filter("kind is not null").select("doc_id", "idx", "kind")


@query("section_fill", "SELECT doc_id, idx, section, is_heading FROM lines", **ALL)
def _(spark, sf):
    return st.section_fill(st.with_headings(st.doc_lines(every_text(spark, sf)))).select("doc_id", "idx", "section", "is_heading")


@query("header_bounds", "SELECT doc_id, max(header_end) AS header_end, bool_or(has_headings) AS has_headings FROM lines GROUP BY doc_id", **ALL)
def _(spark, sf):
    b = st.header_bounds(st.with_headings(st.doc_lines(every_text(spark, sf))))
    return b.groupBy("doc_id").agg(F.max("header_end").alias("header_end"), F.max("has_headings").alias("has_headings"))


@query("label_value", f"SELECT doc_id, idx, label, value FROM lines WHERE kind IS NULL AND {S.has('text', V.LABEL_LINE)}", **ALL)
def _(spark, sf):
    return st.label_value(st.with_headings(st.doc_lines(every_text(spark, sf)))).filter("separated").select("doc_id", "idx", "label", "value")


@query("bare_label_value", f"SELECT doc_id, idx, label, value FROM lines WHERE kind IS NULL AND label IS NOT NULL AND NOT {S.has('text', V.LABEL_LINE)}", **ALL)
def _(spark, sf):
    l = st.label_value(st.with_headings(st.doc_lines(every_text(spark, sf))))
    return l.filter("not separated and label is not null").select("doc_id", "idx", "label", "value")


@query("find_emails", "SELECT doc_id, idx, unnest(range(len(emails))) AS pos, unnest(emails) AS email FROM lines", **ALL)
def _(spark, sf):
    return st.find_emails(st.doc_lines(every_text(spark, sf)))


@query("find_urls", f"SELECT doc_id, idx, unnest(range(len(u))) AS pos, unnest(u) AS url FROM (SELECT *, regexp_extract_all(text, {S.q(V.URL)}, 0) AS u FROM lines_raw) x", **ALL)
def _(spark, sf):
    return st.find_urls(st.doc_lines(every_text(spark, sf)))


@query("section_lines", "SELECT doc_id, idx, text FROM lines WHERE section = 'experience' AND NOT is_heading", **ALL)
def _(spark, sf):
    return st.section_lines(lines(spark, sf, every_text), "experience")


@query("section_starts", "SELECT doc_id, coalesce(min(idx) FILTER (section = 'references'), -1) AS start FROM lines GROUP BY doc_id", **ALL)
def _(spark, sf):
    return st.section_starts(lines(spark, sf, every_text), "references")


@query("line_windows", "SELECT doc_id, idx, section, joined, text FROM windows", **ALL)
def _(spark, sf):
    return st.line_windows(lines(spark, sf, every_text))


@query("section_profile", "SELECT section, count(*) AS n_lines, count(kind) AS n_headings, count(label) AS n_labels FROM lines GROUP BY section", **ALL)
def _(spark, sf):
    return st.section_profile(lines(spark, sf, every_text))


# ------------------------------------------------------------------ phone
@query("phone_runs", "SELECT doc_id, idx, pos, raw FROM phone_run", **ALL)
def _(spark, sf):
    return op.phone_runs(st.doc_lines(every_text(spark, sf))).select("doc_id", "idx", "pos", "raw")


@query("normalize_phone", f"SELECT doc_id, idx, pos, raw, phone, {S.VALID} AS phone_valid, {S.COUNTRY} AS phone_country, phone_reason FROM phone_norm", **ALL)
def _(spark, sf):
    r = op.phone_runs(st.doc_lines(every_text(spark, sf))).select("doc_id", "idx", "pos", "raw")
    return with_phone(r, "raw")


@query("phone_impossible", "SELECT doc_id, idx, pos, NOT (length(dg_all) BETWEEN 8 AND 15) OR replace(dg_all, dg_all[1], '') = '' AS impossible FROM phone_norm", **ALL)
def _(spark, sf):
    r = op.phone_runs(st.doc_lines(every_text(spark, sf)))
    return r.select("doc_id", "idx", "pos", impossible(digits_of(F.col("raw"))).alias("impossible"))


@query("phone_context_veto", f"""SELECT doc_id, idx, pos, ({S.has('text', V.NON_PHONE_CONTEXT)} AND ({S.has("substr(text, greatest(instr(text, raw) - 40, 1), least(40, instr(text, raw) - 1))", V.NON_PHONE_CONTEXT)}
    OR {S.has("substr(text, instr(text, raw) + length(raw), 20)", V.NON_PHONE_CONTEXT)})) OR (length(dg_all) <= 8 AND {S.has('text', V.DATE_LIKE)}) AS veto FROM phone_norm""", **ALL)
def _(spark, sf):
    r = op.phone_runs(st.doc_lines(every_text(spark, sf)))
    return r.select("doc_id", "idx", "pos", op.context_veto(digits_of(F.col("raw"))).alias("veto"))


@query("phone_score", "SELECT doc_id, idx, pos, phone, cast(round(score * 100) AS bigint) AS points, signals, why FROM phones_scored")
def _(spark, sf):
    return op.phone_score(op.plausible_runs(lines(spark, sf))).select("doc_id", "idx", "pos", "phone", "points", "signals", "why")


@query("phone_dedupe", "SELECT doc_id, phone, cast(round(score * 100) AS bigint) AS points, first_at AS ord, h.s AS signals FROM phones_one")
def _(spark, sf):
    return op.phone_candidates(lines(spark, sf)).select("doc_id", "phone", "points", (F.col("ord.idx") * 1000 + F.col("ord.pos")).alias("ord"), "signals")


@query("phone_best", "SELECT doc_id, phone, phone_confidence, phone_method, phone_why, phone_line FROM phone_best")
def _(spark, sf):
    return op.phone_best(cv(spark, sf), op.phone_candidates(lines(spark, sf))).drop("phone_alternatives")


@query("phone_alternatives", "SELECT doc_id, phone_alternatives FROM phone_best WHERE phone_alternatives <> ''")
def _(spark, sf):
    b = op.phone_best(cv(spark, sf), op.phone_candidates(lines(spark, sf)))
    return b.filter(F.size("phone_alternatives") > 0).select("doc_id", "phone_alternatives")


@query("phone_mentions", "SELECT doc_id, phone FROM mention", **ALL)
def _(spark, sf):
    return phone_mentions(every_text(spark, sf))


@query("phone_reuse", "SELECT workspace_id, phone_number, count(*) AS n_cvs FROM candidate c JOIN cv_file f ON f.cv_file_id = c.cv_file_id WHERE phone_number <> 'Not Found' GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return op.phone_reuse(view(spark, sf, "candidate").join(view(spark, sf, "cv_file").select("cv_file_id", "workspace_id"), "cv_file_id"))


# ------------------------------------------------------------------ name
STEP = {"label": 1, "header": 2, "details": 3, "adjacent": 4}


@query("strip_contact", f"SELECT doc_id, idx, {S.STRIPPED} AS plain FROM lines_raw", **ALL)
def _(spark, sf):
    return st.doc_lines(every_text(spark, sf)).select("doc_id", "idx", fn.strip_contact(F.col("text")).alias("plain"))


@query("title_case_name", f"SELECT doc_id, k, {S.TITLE_WORD} AS word FROM (SELECT doc_id, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM txt)) x WHERE w <> ''")
def _(spark, sf):
    w = cv(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "w")).filter("w <> ''")
    return w.select("doc_id", "k", fn.title_case_name(F.col("w")).alias("word"))


@query("clean_name", f"SELECT doc_id, idx, name FROM (SELECT doc_id, idx, {S.clean_name('text')} AS name FROM lines_raw) x WHERE name IS NOT NULL", **ALL)
def _(spark, sf):
    return fn.clean_names(st.doc_lines(every_text(spark, sf)), "text").select("doc_id", "idx", "name")


@query("email_tokens", "SELECT doc_id, array_to_string(list_sort(et), ' | ') AS tokens FROM doc_tokens")
def _(spark, sf):
    return on.doc_tokens(cv(spark, sf)).select("doc_id", F.sort_array("email_tokens").alias("tokens"))


@query("file_tokens", "SELECT doc_id, array_to_string(list_sort(ft), ' | ') AS tokens FROM doc_tokens")
def _(spark, sf):
    return on.doc_tokens(cv(spark, sf)).select("doc_id", F.sort_array("file_tokens").alias("tokens"))


def named_lines(spark, sf) -> DataFrame:
    """Lines for the name alone: of the labels, only those of a field are looked for."""
    return st.annotate_lines(cv(spark, sf).select("doc_id", "text"), labelled=F.col("text").rlike(st.FIELD_LABEL))


def _hits(step: int):
    def run(spark, sf):
        return on.name_hits(named_lines(spark, sf)).filter(F.col("step") == step).select("doc_id", "idx", "name", "points")
    return run


for _key, _step in STEP.items():
    query(f"name_{_key}_hits", f"SELECT doc_id, idx, name, cast(round(score * 100) AS bigint) AS points FROM names_clean WHERE step = {_step}")(_hits(_step))


@query("name_fallback_hits", "SELECT doc_id, idx, name FROM names_hit WHERE step = 5")
def _(spark, sf):
    # read twice, so written once: the lines are annotated once
    h = checkpointed(on.name_hits(named_lines(spark, sf)))
    kept = on.name_merge(h, on.doc_tokens(cv(spark, sf))).filter(F.col("ord") >= on.FALLBACK * 10**9).select("doc_id", "name_key")
    return h.filter(F.col("step") == on.FALLBACK).withColumn("name_key", F.lower("name")).join(kept, ["doc_id", "name_key"]).select("doc_id", "idx", "name")


@query("name_merge", "SELECT doc_id, name, cast(round(score * 100) AS bigint) AS points, array_to_string(list_filter(sigs, lambda s, i: list_position(sigs, s) = i), ' | ') AS signals, why FROM names_merged")
def _(spark, sf):
    return on.name_merge(on.name_hits(named_lines(spark, sf)), on.doc_tokens(cv(spark, sf))).select("doc_id", "name", "points", "signals", "why")


@query("name_corroborate", "SELECT doc_id, name, cast(round(score * 100) AS bigint) AS points, why FROM names_scored")
def _(spark, sf):
    return on.name_candidates(on.doc_tokens(cv(spark, sf)), named_lines(spark, sf)).select("doc_id", "name", "points", "why")


def _name(spark, sf):
    return on.name_best(cv(spark, sf), on.name_candidates(on.doc_tokens(cv(spark, sf)), named_lines(spark, sf)))


@query("name_best", "SELECT doc_id, name, name_confidence, name_method, name_why FROM name_best")
def _(spark, sf):
    return _name(spark, sf).select("doc_id", "name", "name_confidence", "name_method", "name_why")


@query("name_ocr_fix", "SELECT doc_id, name FROM name_best WHERE name_corrected")
def _(spark, sf):
    return _name(spark, sf).filter("name_corrected").select("doc_id", "name")


@query("name_alternatives", "SELECT doc_id, name_alternatives FROM name_best WHERE name_alternatives <> ''")
def _(spark, sf):
    return _name(spark, sf).filter(F.size("name_alternatives") > 0).select("doc_id", "name_alternatives")


# ------------------------------------------------------------------ taxonomy and role
def titles(spark, sf) -> DataFrame:
    """Every phrase the extraction probes."""
    return orole.role_evidence(lines(spark, sf)).filter("raw is not null").select("doc_id", "seq", F.col("raw").alias("title"))


RAW_TITLES = "SELECT doc_id, tier, idx, sub, raw AS title FROM roles_hit WHERE NOT (tier = 3 OR (tier = 5 AND sub = 1))"
PROBES = {"probe_title": "SELECT raw AS title FROM roles_hit WHERE NOT (tier = 3 OR (tier = 5 AND sub = 1))"}


def _titles(spark, sf, *cols):
    return titles(spark, sf).select("doc_id", "title", *cols).distinct()


def distinct_titles(sel: str) -> str:
    return f"SELECT DISTINCT doc_id, title, {sel} FROM ({RAW_TITLES}) t"


@query("role_key", distinct_titles(f"{S.key('title')} AS key"))
def _(spark, sf):
    return _titles(spark, sf, ft.role_key(F.col("title")).alias("key"))


@query("role_tokens", distinct_titles(f"array_to_string({S.toks('title')}, ' | ') AS tokens"))
def _(spark, sf):
    return _titles(spark, sf, ft.role_tokens(F.col("title")).alias("tokens"))


@query("taxonomy_lookup")
def _(spark, sf):
    docs = view(spark, sf, "taxonomy_setting").filter("value is not null")
    flat = flatten_taxonomies(docs, "setting_id").withColumn("ord", (F.col("family_no").cast("long") * 2**20 + F.col("role_no")) * 2**20 + F.col("name_no"))
    return tx.taxonomy_lookup(flat, "setting_id")


_FLAT = """SELECT setting_id, f_no, r_no, n_no, json_extract_string(r, '$.canonical') AS canonical, json_extract_string(f, '$.family') AS family,
   CASE WHEN n_no = 0 THEN json_extract_string(r, '$.canonical') ELSE json_extract_string(r, '$.aliases[' || (n_no - 1) || ']') END AS surface
 FROM (SELECT *, unnest(range(1 + coalesce(json_array_length(r, '$.aliases'), 0)::bigint)) AS n_no FROM (
   SELECT *, unnest(range(json_array_length(f, '$.roles')::bigint)) AS r_no, unnest(json_extract(f, '$.roles[*]')) AS r FROM (
     SELECT setting_id, unnest(range(json_array_length(value, '$.families')::bigint)) AS f_no, unnest(json_extract(value, '$.families[*]')) AS f FROM taxonomy_setting WHERE value IS NOT NULL)))"""
ORACLE["taxonomy_lookup"] = S.sql(f"""SELECT setting_id, key, canonical, family, kind FROM (
  SELECT setting_id, {S.key('surface')} AS key, canonical, family, CASE WHEN n_no = 0 THEN 'canonical' ELSE 'alias' END AS kind,
    row_number() OVER (PARTITION BY setting_id, {S.key('surface')} ORDER BY CASE WHEN n_no = 0 THEN 0 ELSE 1 END,
      CASE WHEN n_no = 0 THEN -1 ELSE 1 END * (f_no * 10000 + r_no * 100 + n_no)) AS rn FROM ({_FLAT}) f) x WHERE rn = 1""")


@query("scan_taxonomy", f"SELECT setting_id, f_no AS family_no, r_no AS role_no, n_no AS name_no, family, canonical, surface, CASE WHEN n_no = 0 THEN 'canonical' ELSE 'alias' END AS kind FROM ({_FLAT}) f")
def _(spark, sf):
    return flatten_taxonomies(view(spark, sf, "taxonomy_setting").filter("value is not null"), "setting_id")


@query("role_generic", f"SELECT DISTINCT doc_id, title, {S.key('title')} IN (SELECT k FROM generic) AS m_generic FROM ({RAW_TITLES}) t")
def _(spark, sf):
    return tx.role_generic(_titles(spark, sf), "title", TAX)


@query("role_seniority", "SELECT DISTINCT doc_id, t.title, m.senior AS seniority, m.rest FROM (" + RAW_TITLES + ") t JOIN matched m ON m.title = t.title", **PROBES)
def _(spark, sf):
    return tx.role_seniority(_titles(spark, sf), "title", TAX)


@query("role_exact", f"""SELECT DISTINCT doc_id, t.title, coalesce(a.canonical, b.canonical) AS m_canonical, coalesce(a.kind, b.kind) AS m_kind, CASE coalesce(a.kind, b.kind) WHEN 'canonical' THEN 1000 WHEN 'alias' THEN 950 END AS m_strength
  FROM ({RAW_TITLES}) t JOIN probe p ON p.title = t.title LEFT JOIN lookup a ON a.k = p.k1 LEFT JOIN lookup b ON b.k = p.k2""", **PROBES)
def _(spark, sf):
    return tx.role_exact(_titles(spark, sf), "title", TAX).select("doc_id", "title", "m_canonical", "m_kind", "m_strength")


@query("role_overlap", f"SELECT DISTINCT doc_id, t.title, m.canonical AS m_canonical, m.strength AS m_strength FROM ({RAW_TITLES}) t JOIN matched m ON m.title = t.title WHERE m.kind = 'token_overlap'", **PROBES)
def _(spark, sf):
    m = tx.role_match(titles(spark, sf), ["doc_id", "seq"], "title", TAX)
    return m.filter("m_kind = 'token_overlap'").select("doc_id", "title", "m_canonical", "m_strength").distinct()


@query("role_match", f"SELECT DISTINCT doc_id, t.title, m.canonical AS m_canonical, m.family AS m_family, m.kind AS m_kind, m.strength AS m_strength, CASE WHEN m.canonical IS NOT NULL THEN m.senior END AS m_seniority FROM ({RAW_TITLES}) t JOIN matched m ON m.title = t.title", **PROBES)
def _(spark, sf):
    m = tx.role_match(titles(spark, sf), ["doc_id", "seq"], "title", TAX)
    return m.select("doc_id", "title", "m_canonical", "m_family", "m_kind", "m_strength", "m_seniority").distinct()


@query("surface_scan", "SELECT doc_id, idx, s.surface FROM windows w JOIN scanned s ON s.text = w.text WHERE NOT joined",
       scan_text="SELECT DISTINCT text FROM windows WHERE NOT joined")
def _(spark, sf):
    w = st.line_windows(lines(spark, sf)).filter("not joined").select("doc_id", "idx", "text")
    return tx.surface_scan(w, ["doc_id", "idx"], TAX).filter("surface is not null").select("doc_id", "idx", "surface")


@query("clean_title", f"SELECT DISTINCT doc_id, raw AS title, cleaned, {S.is_title('cleaned')} AS is_title FROM (SELECT doc_id, title AS raw, {S.clean_title('title')} AS cleaned FROM ({RAW_TITLES}) t) x")
def _(spark, sf):
    c = ft.clean_title(F.col("title"))
    return _titles(spark, sf, c.alias("cleaned")).withColumn("is_title", ft.is_title(F.col("cleaned")))


@query("title_shaped", distinct_titles(f"{S.has('title', V.TITLE_NOUN)} AS shaped"))
def _(spark, sf):
    return _titles(spark, sf, ft.title_shaped(F.col("title")).alias("shaped"))


@query("present_role", f"""SELECT DISTINCT doc_id, t.title, CASE WHEN m.canonical IS NULL THEN {S.title_case('t.title')} WHEN m.senior IS NULL OR regexp_matches(m.canonical || ' ', '(?i)^' || m.senior || '[^A-Za-z0-9_]') THEN m.canonical
  ELSE {S.title_case('m.senior')} || ' ' || m.canonical END AS shown FROM ({RAW_TITLES}) t JOIN matched m ON m.title = t.title""", **PROBES)
def _(spark, sf):
    m = tx.role_match(titles(spark, sf), ["doc_id", "seq"], "title", TAX)
    shown = F.when(F.col("m_canonical").isNotNull(), ft.present_role(F.col("m_canonical"), F.col("m_seniority"))).otherwise(ft.title_case(F.col("title")))
    return m.select("doc_id", "title", shown.alias("shown")).distinct()


def _tier(n: int):
    def run(spark, sf):
        c = orole.role_candidates(lines(spark, sf), TAX).filter(F.col("tier") == n)
        return c.groupBy("doc_id", "role").agg(F.max("points").alias("points"), F.count("*").alias("n"))
    return run


for _n in range(1, 6):
    query(f"role_tier{_n}", f"SELECT doc_id, role, cast(round(max(score) * 100000) AS bigint) AS points, count(*) AS n FROM cands_role WHERE tier = {_n} GROUP BY doc_id, role")(_tier(_n))


@query("role_admit", "SELECT doc_id, tier, idx % 1000000 AS idx, role, cast(round(score * 100000) AS bigint) AS points, why FROM cands_role")
def _(spark, sf):
    return orole.role_candidates(lines(spark, sf), TAX).select("doc_id", "tier", "idx", "role", "points", "why")


def _role(spark, sf):
    return orole.role_best(cv(spark, sf), orole.role_candidates(lines(spark, sf), TAX))


@query("role_best", "SELECT doc_id, role, role_confidence, role_method, role_why, role_tier FROM role_best")
def _(spark, sf):
    return _role(spark, sf).drop("role_alternatives")


@query("role_alternatives", "SELECT doc_id, role_alternatives FROM role_best WHERE role_alternatives <> ''")
def _(spark, sf):
    return _role(spark, sf).filter(F.size("role_alternatives") > 0).select("doc_id", "role_alternatives")


_LIM = """s.value IS NOT NULL AND length(json_extract_string(s.value, '$.version')) BETWEEN 1 AND 20 AND json_array_length(s.value, '$.families') BETWEEN 1 AND 100
  AND NOT EXISTS (SELECT 1 FROM flat x WHERE x.setting_id = s.setting_id AND (length(family) NOT BETWEEN 2 AND 60 OR (n_no = 0 AND length(canonical) NOT BETWEEN 2 AND 80) OR length(surface) NOT BETWEEN 1 AND 80))"""


@query("taxonomy_active", f"SELECT s.setting_id, CASE WHEN {_LIM} THEN 'override' ELSE 'default' END AS source, CASE WHEN {_LIM} THEN json_extract_string(s.value, '$.version') ELSE '1.0.0' END AS version FROM taxonomy_setting s", flat=_FLAT)
def _(spark, sf):
    a = tx.taxonomy_active(view(spark, sf, "taxonomy_setting"), TAX)
    return a.select("setting_id", "source", F.get_json_object("value", "$.version").alias("version"))


@query("taxonomy_status", f"""SELECT s.setting_id, CASE WHEN {_LIM} THEN 'override' ELSE 'default' END AS source, CASE WHEN {_LIM} THEN json_extract_string(s.value, '$.version') ELSE '1.0.0' END AS version,
  CASE WHEN {_LIM} THEN json_array_length(s.value, '$.families') ELSE (SELECT count(DISTINCT family) FROM surface) END AS families,
  CASE WHEN {_LIM} THEN (SELECT count(*) FROM flat x WHERE x.setting_id = s.setting_id AND n_no = 0) ELSE (SELECT count(DISTINCT role_ord) FROM surface) END AS roles FROM taxonomy_setting s""", flat=_FLAT)
def _(spark, sf):
    return tx.taxonomy_status(tx.taxonomy_active(view(spark, sf, "taxonomy_setting"), TAX), "setting_id")


# ------------------------------------------------------------------ assembly, validation, merge
@query("ocr_penalty", "SELECT doc_id, cast(nc AS double) AS name_confidence, cast(pc AS double) AS phone_confidence, cast(rc AS double) AS role_confidence FROM fields")
def _(spark, sf):
    return extract_fields(cv(spark, sf)).select("doc_id", "name_confidence", "phone_confidence", "role_confidence")


@query("assemble", f"""SELECT doc_id, name, phone, role, name_method, phone_method, role_method, name_why, phone_why, role_why, cast(nc AS double) AS name_confidence,
   cast(pc AS double) AS phone_confidence, cast(rc AS double) AS role_confidence, 'local' AS engine, '{V.ENGINE_VERSION}' AS engine_version FROM fields""")
def _(spark, sf):
    cols = [f"{f}{s}" for f in ("name", "phone", "role") for s in ("", "_confidence", "_method", "_why")]
    return extract_fields(cv(spark, sf)).select("doc_id", *cols, "engine", "engine_version")


@query("validate_row", """SELECT doc_id, candidate_name, phone_number, job_role_applied_for, cast(n1 AS double) AS name_confidence, cast(p1 AS double) AS phone_confidence, cast(r1 AS double) AS role_confidence,
  cast(overall AS double) AS overall_confidence, array_to_string(codes, ' | ') AS review_codes FROM validated""")
def _(spark, sf):
    model = document_model(cv(spark, sf))
    v = rv.validate_rows(fields_of(model), model.facts)
    return v.select("doc_id", "candidate_name", "phone_number", "job_role_applied_for", "name_confidence", "phone_confidence", "role_confidence", "overall_confidence", "review_codes")


@query("low_ocr_review", "SELECT doc_id, array_to_string(reasons, ' | ') AS review_reasons, len(reasons) > 0 AS needs_review FROM validated")
def _(spark, sf):
    return parse_documents(cv(spark, sf)).select("doc_id", "review_reasons", "needs_review")


@query("validate_name", f"SELECT doc_id, engine, {S.name_reason('got_name')} AS reason, CASE WHEN {S.name_reason('got_name')} IS NULL THEN {S.name_value('got_name')} ELSE 'Not Found' END AS value FROM field_value")
def _(spark, sf):
    d = fr.validate_name(view(spark, sf, "field_value"), "got_name", "n")
    return d.select("doc_id", "engine", F.col("n_reason").alias("reason"), F.col("n_value").alias("value"))


@query("validate_role", f"SELECT doc_id, engine, {S.role_reason('got_role')} AS reason, CASE WHEN {S.role_reason('got_role')} IS NULL THEN {S.role_value('got_role')} ELSE 'Not Found' END AS value FROM field_value")
def _(spark, sf):
    d = fr.validate_role(view(spark, sf, "field_value"), "got_role", "r")
    return d.select("doc_id", "engine", F.col("r_reason").alias("reason"), F.col("r_value").alias("value"))


@query("validate_phone", f"""SELECT n.doc_id, engine, CASE WHEN {S.missing('got_phone')} THEN 'Phone number not found' WHEN NOT {S.VALID} THEN 'Phone number invalid: "' || got_phone || '"' END AS reason,
  CASE WHEN {S.missing('got_phone')} OR NOT {S.VALID} THEN 'Not Found' ELSE phone END AS value,
  NOT {S.missing('got_phone')} AND {S.VALID} AND contains({S.rep('t.text', '[' + chr(92) + 's' + chr(92) + '-().]', '')}, right(regexp_replace(phone, '[^0-9]', '', 'g'), 8)) AS in_text FROM vp n JOIN cv_text t ON t.doc_id = n.doc_id""",
       vp=S.phone_cases("got_phone", "field_value"))
def _(spark, sf):
    v = view(spark, sf, "field_value").join(cv(spark, sf).select("doc_id", "text"), "doc_id")
    d = fr.validate_phone(v, "got_phone", "text", "p")
    return d.select("doc_id", "engine", F.col("p_reason").alias("reason"), F.col("p_value").alias("value"), F.col("p_in_text").alias("in_text"))


_MERGED = f"""SELECT v.doc_id AS cv_file_id, cf, CASE WHEN list_contains(cf, 'candidateName') THEN c.candidate_name ELSE v.candidate_name END AS candidate_name,
    CASE WHEN list_contains(cf, 'phoneNumber') THEN c.phone_number ELSE v.phone_number END AS phone_number, v.job_role_applied_for,
    CASE WHEN list_contains(cf, 'candidateName') THEN 1 ELSE n1 END AS n2, CASE WHEN list_contains(cf, 'phoneNumber') THEN 1 ELSE p1 END AS p2, r1 AS r2, overall,
    list_filter(reasons, lambda r: NOT (contains(lower(r), 'name') AND list_contains(cf, 'candidateName')) AND NOT (contains(lower(r), 'phone') AND list_contains(cf, 'phoneNumber'))) AS reasons,
    list_filter(codes, lambda k: NOT (k = 'NO_NAME_FOUND' AND list_contains(cf, 'candidateName')) AND NOT (k IN ('NO_PHONE_FOUND', 'PHONE_NOT_IN_TEXT') AND list_contains(cf, 'phoneNumber'))) AS codes
  FROM validated v LEFT JOIN candidate c ON c.cv_file_id = v.doc_id CROSS JOIN LATERAL (SELECT coalesce(c.corrected_fields, []) AS cf) z"""


def merged(spark, sf):
    new = parse_documents(cv(spark, sf)).withColumnRenamed("doc_id", "cv_file_id")
    return rv.merge_corrections(new, view(spark, sf, "candidate"))


@query("merge_corrections", """SELECT cv_file_id, candidate_name, phone_number, job_role_applied_for, cast(CASE WHEN len(cf) > 0 THEN round(n2 * 0.40 + p2 * 0.35 + r2 * 0.25, 3) ELSE overall END AS double) AS overall_confidence,
  array_to_string(cf, ' | ') AS corrected_fields, array_to_string(reasons, ' | ') AS review_reasons, array_to_string(codes, ' | ') AS review_codes FROM merged""", merged=_MERGED)
def _(spark, sf):
    return merged(spark, sf).select("cv_file_id", "candidate_name", "phone_number", "job_role_applied_for", "overall_confidence", "corrected_fields", "review_reasons", "review_codes")


@query("final_status", """SELECT cv_file_id, CASE WHEN len(reasons) > 0 THEN 'NEEDS_REVIEW' ELSE 'PROCESSED' END AS status, CASE WHEN len(reasons) > 0 THEN array_to_string(codes, ' | ') ELSE '' END AS review_codes,
  len(reasons) > 0 AS review_required FROM merged""", merged=_MERGED)
def _(spark, sf):
    return rv.final_status(merged(spark, sf)).select("cv_file_id", "status", "review_codes", "review_required")


@query("manual_correction", f"""SELECT cv_file_id, workspace_id, CASE WHEN err IS NULL AND status IN ('PROCESSED', 'NEEDS_REVIEW') THEN CASE WHEN len(left_) > 0 THEN 'NEEDS_REVIEW' ELSE 'PROCESSED' END ELSE status END AS status,
    CASE WHEN err IS NULL AND p_name IS NOT NULL THEN CASE WHEN lower(p_name) = 'not found' THEN 'Not Found' ELSE {S.name_value('p_name')} END ELSE coalesce(candidate_name, 'Not Found') END AS candidate_name,
    CASE WHEN err IS NULL AND p_phone IS NOT NULL THEN CASE WHEN lower(p_phone) = 'not found' THEN 'Not Found' ELSE phone END ELSE coalesce(phone_number, 'Not Found') END AS phone_number,
    CASE WHEN err IS NULL AND p_role IS NOT NULL THEN {S.role_value('p_role')} ELSE coalesce(job_role_applied_for, 'Not Found') END AS job_role_applied_for,
    CASE WHEN err IS NULL THEN cast(round(CASE WHEN p_name IS NOT NULL THEN 1 ELSE coalesce(name_c, 0) END * 0.40 + CASE WHEN p_phone IS NOT NULL THEN 1 ELSE coalesce(phone_c, 0) END * 0.35 + CASE WHEN p_role IS NOT NULL THEN 1 ELSE coalesce(role_c, 0) END * 0.25, 3) AS double)
      ELSE coalesce(overall_confidence, 0) END AS overall_confidence,
    array_to_string(cf, ' | ') AS corrected_fields, array_to_string(CASE WHEN err IS NULL THEN left_ ELSE coalesce(review_reasons, []) END, ' | ') AS review_reasons, err AS error
  FROM (SELECT *, list_filter(coalesce(review_reasons, []), lambda r: NOT ((contains(lower(r), 'name') AND list_contains(cf, 'candidateName')) OR (contains(lower(r), 'phone') AND list_contains(cf, 'phoneNumber')) OR (contains(lower(r), 'role') AND list_contains(cf, 'jobRoleAppliedFor')))) AS left_
    FROM (SELECT *, list_concat(coalesce(corrected_fields, []), list_filter(CASE WHEN err IS NULL THEN [CASE WHEN p_name IS NOT NULL THEN 'candidateName' END, CASE WHEN p_phone IS NOT NULL THEN 'phoneNumber' END, CASE WHEN p_role IS NOT NULL THEN 'jobRoleAppliedFor' END] ELSE [] END,
        lambda x: x IS NOT NULL AND NOT list_contains(coalesce(corrected_fields, []), x))) AS cf
      FROM (SELECT *, coalesce(CASE WHEN p_name IS NOT NULL AND lower(p_name) <> 'not found' THEN {S.name_reason('p_name')} END,
          CASE WHEN p_phone IS NOT NULL AND lower(p_phone) <> 'not found' AND NOT {S.VALID} THEN 'Invalid phone number: ' || p_phone END,
          CASE WHEN p_role IS NOT NULL THEN {S.role_reason('p_role')} END) AS err
        FROM edits e) a) b) c""",
       edits=S.phone_cases("p_phone", "edits0"),
       edits0="""SELECT f.cv_file_id, f.workspace_id, f.status, p.candidate_name AS p_name, p.phone_number AS p_phone, p.job_role_applied_for AS p_role, c.candidate_name, c.phone_number, c.job_role_applied_for,
         c.name_c, c.phone_c, c.role_c, c.overall_confidence, c.corrected_fields, c.review_reasons FROM cv_file f JOIN patch p ON p.cv_file_id = f.cv_file_id LEFT JOIN candidate c ON c.cv_file_id = f.cv_file_id""")
def _(spark, sf):
    m = rv.manual_correction(view(spark, sf, "cv_file"), view(spark, sf, "candidate"), view(spark, sf, "patch"))
    return m.select("cv_file_id", "workspace_id", "status", "candidate_name", "phone_number", "job_role_applied_for", "overall_confidence", "corrected_fields", "review_reasons", "error")


@query("job_failure", """SELECT job_id, t AS transient, t AND attempts < max_attempts AS will_retry, CASE WHEN t AND attempts < max_attempts THEN 'PENDING' ELSE 'FAILED' END AS status,
   CASE WHEN t AND attempts < max_attempts THEN 'RETRY_SCHEDULED' END AS stage, message AS error_message, CASE WHEN app_error THEN code ELSE 'PROCESSING_ERROR' END AS error_code
  FROM (SELECT *, CASE WHEN app_error THEN app_transient ELSE code = 'ECONNRESET' OR coalesce(error_name = 'AbortError', false) OR coalesce(http_status IN (429, 503), false) OR contains(lower(message), 'timed out') END AS t FROM failure) x""")
def _(spark, sf):
    return rv.job_failure(view(spark, sf, "failure"))


@query("provider_error_class", f"""SELECT doc_id, http_status, code, CASE code WHEN 'LLM_QUOTA' THEN 'LLM account has no available credit/quota: ' WHEN 'LLM_AUTH' THEN 'LLM API key rejected (HTTP ' || http_status || '): '
    WHEN 'LLM_MODEL_NOT_FOUND' THEN 'Model not found (HTTP 404): ' WHEN 'LLM_BAD_REQUEST' THEN 'LLM rejected the request (HTTP ' || http_status || '): ' WHEN 'LLM_RATE_LIMITED' THEN 'LLM rate limit hit (HTTP 429): '
    WHEN 'LLM_TRANSIENT' THEN 'LLM service error (HTTP ' || http_status || '): ' ELSE 'LLM API error (HTTP ' || http_status || '): ' END || trim(detail) AS message, code IN ('LLM_RATE_LIMITED', 'LLM_TRANSIENT') AS transient
  FROM (SELECT *, CASE WHEN {S.has('detail', V.QUOTA_WORDS)} OR {S.has("coalesce(kind, '')", V.QUOTA_WORDS)} THEN 'LLM_QUOTA' WHEN http_status IN (401, 403) THEN 'LLM_AUTH' WHEN http_status = 404 THEN 'LLM_MODEL_NOT_FOUND'
      WHEN http_status IN (400, 422) THEN 'LLM_BAD_REQUEST' WHEN http_status = 429 THEN 'LLM_RATE_LIMITED' WHEN http_status >= 500 THEN 'LLM_TRANSIENT' ELSE 'LLM_ERROR' END AS code
    FROM (SELECT doc_id, http_status, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.error.message'), body) ELSE body END AS detail,
      CASE WHEN json_valid(body) THEN concat_ws(' ', json_extract_string(body, '$.error.type'), json_extract_string(body, '$.error.code')) END AS kind FROM reply_log) a) b""")
def _(spark, sf):
    return rv.provider_error_class(view(spark, sf, "reply_log"))


_FIELDS3 = ["candidate_name", "phone_number", "job_role_applied_for"]


@query("parse_model_json", "SELECT doc_id, ok, " + ", ".join(f"CASE WHEN ok THEN coalesce(json_extract_string(j, '$.{f}'), 'Not Found') END AS {f}" for f in _FIELDS3) + ", "
       + ", ".join(f"CASE WHEN ok THEN coalesce(cast(json_extract(j, '$.confidence.{f}') AS double), 0) END AS {f}_confidence" for f in _FIELDS3)
       + " FROM (SELECT doc_id, j, j IS NOT NULL AND " + " AND ".join(f"coalesce(cast(json_extract(j, '$.confidence.{f}') AS double) BETWEEN 0 AND 1, true)" for f in _FIELDS3)
       + r" AS ok FROM (SELECT doc_id, CASE WHEN json_valid(s) THEN s END AS j FROM (SELECT doc_id, regexp_extract(reply, '(?s)\{.*\}', 0) AS s FROM reply_log) a) b) c")
def _(spark, sf):
    return rv.parse_model_json(view(spark, sf, "reply_log"))


def _engine(spark, sf, e):
    r = view(spark, sf, "result_row").filter(F.col("engine") == e)
    return r.select("doc_id", F.col("got_name").alias("name"), F.col("got_phone").alias("phone"), F.col("got_role").alias("role"))


@query("shadow_compare", """SELECT doc_id, n AS name_agrees, p AS phone_agrees, r AS role_agrees, n::bigint + p::bigint + r::bigint AS agreement_count FROM (
  SELECT a.doc_id, lower(trim(a.got_name)) = lower(trim(b.got_name)) AS n, regexp_replace(a.got_phone, '[^0-9]', '', 'g') = regexp_replace(b.got_phone, '[^0-9]', '', 'g') AS p, lower(trim(a.got_role)) = lower(trim(b.got_role)) AS r
  FROM result_row a JOIN result_row b ON a.doc_id = b.doc_id WHERE a.engine = 'local' AND b.engine = 'remote') x""")
def _(spark, sf):
    return rv.shadow_compare(_engine(spark, sf, "local"), _engine(spark, sf, "remote"))


@query("confidence_band", "SELECT cv_file_id, CASE WHEN overall_confidence < 0.7 THEN 'low' WHEN overall_confidence < 0.9 THEN 'medium' ELSE 'high' END AS band FROM candidate")
def _(spark, sf):
    return view(spark, sf, "candidate").select("cv_file_id", fr.confidence_band(F.col("overall_confidence")).alias("band"))
