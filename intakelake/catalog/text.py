"""Registered queries: text preparation over documents and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as ft
from ..operators import textprep as tp
from ..sources.views import raw, view
from . import sql as S
from .out import plain

QUERIES, ORACLE = {}, {}
B = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
STRIP = lambda c: S.rep(c, f"^[{B}]+|[{B}]+$", "")
MEAN = lambda c: f"length({S.rep(c, r'[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]', '')})"
SOLID = lambda c: f"length({S.rep(c, chr(92) + 's+', '')})"
USABLE = lambda c, p: f"({MEAN(c)} >= 150 AND {MEAN(c)} >= 0.5 * greatest({SOLID(c)}, 1) AND cast({MEAN(c)} AS double) / greatest({p}, 1) >= 120)"


def query(key, oracle=None, **override):
    def add(f):
        QUERIES[key] = lambda spark, sf: plain(f(spark, sf))
        if oracle:
            ORACLE[key] = S.sql(oracle, **override)
        return f
    return add


def docs(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", "text", "n_chars")


@query("meaningful_chars", f"SELECT doc_id, {MEAN('text')} AS meaningful FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", ft.meaningful_chars(F.col("text")).alias("meaningful"))


@query("text_usable", f"SELECT doc_id, {USABLE('text', '(n_chars // 900 + 1)')} AS usable FROM documents")
def _(spark, sf):
    pages = F.floor(F.col("n_chars") / 900) + 1
    return docs(spark, sf).select("doc_id", ft.text_usable(F.col("text"), pages).alias("usable"))


_PAGES = f"SELECT doc_id, coalesce(string_agg(nullif({STRIP('text')}, ''), chr(10) || chr(10) ORDER BY page_no), '') AS text, count(*) AS page_count FROM page_text GROUP BY doc_id"
_OCR = """SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS ocr_text, cast(sum(confidence_pct) AS double) / count(*) / 100 AS ocr_confidence, count(*) AS pages_processed
  FROM page_text GROUP BY doc_id"""
_ROUTE = f"""SELECT *, CASE mime_type WHEN 'application/pdf' THEN 'PDF_TEXT' WHEN 'image/png' THEN 'NONE' WHEN 'application/msword' THEN 'DOC' ELSE 'DOCX' END AS method,
  CASE WHEN mime_type = 'image/png' THEN 0 ELSE {MEAN('text')} END AS meaningful,
  CASE mime_type WHEN 'image/png' THEN true WHEN 'application/pdf' THEN NOT {USABLE('text', 'page_count')} ELSE {MEAN('text')} < 150 END AS needs_ocr
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/msword' ELSE '{V.EXTENSION_MIME['.docx']}' END AS mime_type FROM paged) p"""
X = {"paged": _PAGES, "ocred": _OCR, "routed": _ROUTE}


def routed(spark, sf):
    m = F.col("doc_id") % 4
    mime = F.when(m == 0, "application/pdf").when(m == 1, "image/png").when(m == 2, "application/msword").otherwise(V.EXTENSION_MIME[".docx"])
    return tp.text_route(tp.join_pages(view(spark, sf, "page_text")).withColumn("mime_type", mime))


@query("join_pages", "SELECT * FROM paged", **X)
def _(spark, sf):
    return tp.join_pages(view(spark, sf, "page_text"))


@query("ocr_pages", "SELECT * FROM ocred", **X)
def _(spark, sf):
    return tp.ocr_pages(view(spark, sf, "page_text"))


@query("text_route", "SELECT doc_id, method, meaningful, needs_ocr FROM routed", **X)
def _(spark, sf):
    return routed(spark, sf).select("doc_id", "method", "meaningful", "needs_ocr")


@query("prefer_ocr", f"""SELECT r.doc_id, w AS ocr_wins, CASE WHEN w THEN CASE WHEN mime_type = 'image/png' THEN 'OCR_IMAGE' ELSE 'OCR_PDF' END ELSE method END AS method, CASE WHEN w THEN ocr_text ELSE text END AS text
  FROM (SELECT r.*, o.ocr_text, needs_ocr AND {MEAN('coalesce(o.ocr_text, chr(32))')} > 1.2 * {MEAN('r.text')} AS w FROM routed r LEFT JOIN ocred o ON o.doc_id = r.doc_id) r""", **X)
def _(spark, sf):
    j = routed(spark, sf).join(tp.ocr_pages(view(spark, sf, "page_text")).select("doc_id", "ocr_text"), "doc_id", "left")
    return tp.prefer_ocr(j).select("doc_id", "ocr_wins", "method", "text")


FOLD = lambda c: S.chain(f"translate({''.join('replace(' for _ in V.LIGATURES)}{c}{''.join(f', {S.q(a)}, {S.q(b)})' for a, b in V.LIGATURES.items())}, {S.q(V.QUOTES_FROM)}, {S.q(V.QUOTES_TO)})",
                         (V.CONTROL_CHARS, ""), (r"[\x{2500}-\x{259f}]", " "), (r"[ \t]+", " "))


# None of the characters of these tables changes under NFKC (a test looks), so the check composes nothing but NFC.
@query("normalize_chars", f"SELECT doc_id, {FOLD('nfc_normalize(text)')} AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", ft.normalize_chars(F.col("text")).alias("text"))


@query("normalize_chars_plain", f"SELECT doc_id, {FOLD('text')} AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", ft.normalize_chars(F.col("text"), compose=False).alias("text"))


_NLINES = f"""SELECT doc_id, idx, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY idx) AS before, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS nth
  FROM (SELECT doc_id, idx, {STRIP('raw')} AS line FROM (SELECT doc_id, unnest(range(len(p))) AS idx, unnest(p) AS raw FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM folded) a) b) c) d
  WHERE NOT (line = '' AND coalesce(before, 'x') = '') AND NOT (length(line) > 25 AND nth > 1)"""
Y = {"folded": f"SELECT doc_id, {FOLD('text')} AS text FROM documents", "nlines": _NLINES}


@query("normalize_lines", "SELECT * FROM nlines", **Y)
def _(spark, sf):
    return tp.normalize_lines(docs(spark, sf).select("doc_id", ft.normalize_chars(F.col("text"), compose=False).alias("text")))


@query("truncate_middle", "SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 2400) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 600) ELSE text END AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", ft.truncate_middle(F.col("text"), 3000).alias("text"))


@query("normalize_text", f"SELECT doc_id, {STRIP('string_agg(line, chr(10) ORDER BY idx)')} AS text FROM nlines GROUP BY doc_id", **Y)
def _(spark, sf):
    return tp.normalize_text(docs(spark, sf), compose=False)


@query("no_text_gate", f"SELECT doc_id, {MEAN('text')} AS meaningful, CASE WHEN {MEAN('text')} < 20 THEN 'NO_TEXT' END AS error_code FROM (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations) t")
def _(spark, sf):
    turns = raw(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("doc_id"), "text")
    return tp.no_text_gate(docs(spark, sf).select("doc_id", "text").unionByName(turns)).select("doc_id", "meaningful", "error_code")


@query("extraction_method_counts", "SELECT extraction_method, ocr_used, count(*) AS n FROM candidate GROUP BY ALL")
def _(spark, sf):
    return tp.extraction_method_counts(view(spark, sf, "candidate"))


@query("word_wrap", r"""SELECT doc_id, idx, CASE WHEN length(text) <= 60 THEN text ELSE list_reduce(string_split(text, ' '), lambda a, w: CASE WHEN string_split(a, chr(10))[-1] = '' THEN a || w
   WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 60 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS text FROM (SELECT doc_id, unnest(range(len(p))) AS idx, unnest(p) AS text
     FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM cv_text) a) b""")
def _(spark, sf):
    lines = view(spark, sf, "cv_text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.select("doc_id", "idx", ft.word_wrap(F.col("text"), 60).alias("text"))


@query("slugify", r"SELECT DISTINCT name, left(regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug FROM (SELECT truth_name || ' & Co. ' || (doc_id % 7) AS name FROM cv_text UNION ALL SELECT c_name FROM customer) x")
def _(spark, sf):
    a = view(spark, sf, "cv_text").select(F.concat("truth_name", F.lit(" & Co. "), (F.col("doc_id") % 7).cast("string")).alias("name"))
    names = a.unionByName(raw(spark, sf, "customer").select(F.col("c_name").alias("name"))).distinct()
    return names.select("name", ft.slugify(F.col("name")).alias("slug"))
