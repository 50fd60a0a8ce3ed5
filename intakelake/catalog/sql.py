"""Independent SQL statements of the rules, for checking against another engine.

Tables are common table expressions; ``sql(final)`` prefixes a query with the ones it
needs. Fixed values (patterns, word lists) are shared with the library, logic is not.
"""

from __future__ import annotations

import re

from .. import values as V
from ..sources import views as W
from ..sources.taxonomy import built_in


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def rep(col: str, pattern: str, to: str) -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(to)}, 'g')"


def grp(col: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {n}), '')"


def chain(col: str, *steps) -> str:
    for pattern, to in steps:
        col = rep(col, pattern, to)
    return col


def squeeze(col: str) -> str:
    return f"trim({rep(col, chr(92) + 's+', ' ')})"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def cap(w: str) -> str:
    return f"replace(upper(substr({w}, 1, 1)), 'ẞ', 'SS') || lower(substr({w}, 2))"


def words_cap(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: {cap('w')}), ' ')"


def txt(col: str) -> str:
    return f"array_to_string({col}, ' | ')"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


CTE: dict[str, str] = dict(W.DUCK_VIEWS)
HEAVY = {"lines", "names_hit", "roles_hit", "phones_scored", "matched", "fields", "validated", "cv_text", "cands_role", "names_scored"}
CTE["txt"] = "SELECT doc_id, text FROM cv_text"

# ------------------------------------------------------------------ structure
CTE["lines_raw"] = """SELECT doc_id, len(p) AS n_lines, unnest(range(len(p))) AS idx, unnest(p) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM txt)"""
CTE["lines_kind"] = f"""SELECT *, CASE WHEN length(bare) = 0 OR length(bare) > {V.HEADING_CHARS} THEN NULL
  {' '.join(f"WHEN {has('bare', p)} THEN {q(k)}" for k, p in V.SECTIONS)} END AS kind
  FROM (SELECT *, trim({chain('text', (V.LEAD_MARKS, ''), (V.TRAIL_MARKS, ''), (V.LIST_NUMBER, ''))}) AS bare FROM lines_raw)"""
CTE["lines"] = f"""SELECT *, CASE WHEN kind IS NULL THEN trim(coalesce({grp('text', V.LABEL_LINE, 1)}, {grp('text', V.BARE_LABEL_LINE, 1)})) END AS label,
    CASE WHEN kind IS NULL THEN trim(coalesce({grp('text', V.LABEL_LINE, 2)}, {grp('text', V.BARE_LABEL_LINE, 2)})) END AS value,
    kind IS NOT NULL AS is_heading, regexp_extract_all(text, {q(V.EMAIL)}, 0) AS emails,
    coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 'header') AS section,
    least(coalesce(min(CASE WHEN kind IS NOT NULL THEN idx END) OVER (PARTITION BY doc_id), n_lines), {V.HEADER_LINES}) AS header_end,
    count(kind) OVER (PARTITION BY doc_id) > 0 AS has_headings,
    lag(text) OVER d AS prev_text, CASE WHEN lead(kind) OVER d IS NULL THEN lead(text) OVER d END AS next_text,
    coalesce({has('lag(text) OVER d', V.EMAIL)}, false) OR coalesce({has('lead(text) OVER d', V.EMAIL)}, false) AS beside_email
  FROM lines_kind WINDOW d AS (PARTITION BY doc_id ORDER BY idx)"""

# ------------------------------------------------------------------ phone


def phone_cases(raw: str, src: str, keep: str = "*") -> str:
    """Select that adds phone, phone_valid, phone_country, phone_reason for the number in ``raw``."""
    m = "regexp_matches"
    return f"""SELECT {keep}, CASE WHEN empty_ OR dg_all = '' THEN 'Not Found' WHEN {m}(dg, '^[6-9][0-9]{{9}}$') THEN '+91' || dg
      WHEN {m}(dg, '^0[6-9][0-9]{{9}}$') THEN '+91' || dg[2:] WHEN {m}(dg, '^91[6-9][0-9]{{9}}$') THEN '+' || dg
      WHEN {m}(dg, '^(091|910)[6-9][0-9]{{9}}$') THEN '+91' || dg[4:] WHEN length(dg) IN (10, 11) AND dg[1] = '0' THEN '+91' || dg[2:]
      WHEN length(dg) BETWEEN 8 AND 15 THEN CASE WHEN plus_ THEN '+' ELSE '' END || dg ELSE 'Not Found' END AS phone,
    CASE WHEN empty_ THEN 'empty' WHEN dg_all = '' THEN 'no digits' WHEN {m}(dg, '^(0|91|091|910)?[6-9][0-9]{{9}}$') THEN NULL
      WHEN length(dg) IN (10, 11) AND dg[1] = '0' THEN 'landline' WHEN length(dg) BETWEEN 8 AND 15 THEN CASE WHEN NOT plus_ THEN 'ambiguous format' END
      ELSE 'invalid length' END AS phone_reason
    FROM (SELECT *, CASE WHEN NOT plus_ AND dg_all[1:2] = '00' THEN dg_all[3:] ELSE dg_all END AS dg
      FROM (SELECT *, coalesce(regexp_matches(trim({raw}), '^\\s*\\(?\\+'), false) AS plus_, regexp_replace(trim({raw}), '[^0-9]', '', 'g') AS dg_all,
        {raw} IS NULL OR trim({raw}) = '' OR regexp_matches(trim({raw}), '(?i)^not\\s*found$|^n/?a$') AS empty_ FROM {src}) p0) p1"""


VALID = "(phone_reason IS NULL OR phone_reason = 'landline')"
COUNTRY = "CASE WHEN NOT {v} THEN 'UNKNOWN' WHEN phone[1:3] = '+91' AND length(dg) IN (10, 11, 12, 13) AND (phone_reason = 'landline' OR regexp_matches(dg, '^(0|91|091|910)?[6-9][0-9]{9}$')) THEN 'IN' ELSE 'INTL' END".replace("{v}", VALID)
CTE["phone_run"] = f"""SELECT l.*, unnest(r) AS raw, unnest(range(len(r))) AS pos
  FROM (SELECT *, regexp_extract_all(text, {q(V.PHONE_RUN)}, 0) AS r FROM lines) l"""
CTE["phone_norm"] = phone_cases("raw", "phone_run")
P = V.PHONE_POINTS
CTE["phone_ok"] = f"""SELECT * FROM (SELECT *, {COUNTRY} AS country, instr(text, raw) AS at_,
      substr(text, greatest(instr(text, raw) - 40, 1), least(40, instr(text, raw) - 1)) AS b40,
      substr(text, greatest(instr(text, raw) - 45, 1), least(45, instr(text, raw) - 1)) AS b45,
      substr(text, instr(text, raw) + length(raw), 20) AS a20 FROM phone_norm
      WHERE {VALID} AND length(dg_all) BETWEEN 8 AND 15 AND replace(dg_all, dg_all[1], '') <> '') x
  WHERE NOT ({has('text', V.NON_PHONE_CONTEXT)} AND ({has('b40', V.NON_PHONE_CONTEXT)} OR {has('a20', V.NON_PHONE_CONTEXT)}))
    AND NOT (length(dg_all) <= 8 AND {has('text', V.DATE_LIKE)})"""
CTE["phones_scored"] = f"""SELECT *, greatest(0, cast(0.35 AS decimal(9,6)) + CASE WHEN foreign_ THEN -0.30 WHEN own_ THEN 0.40 ELSE 0 END
      + CASE WHEN idx < header_end THEN 0.25 WHEN idx < header_end + 6 THEN 0.10 ELSE 0 END
      + CASE section WHEN 'personal_details' THEN 0.20 WHEN 'references' THEN -0.60 WHEN 'experience' THEN -0.25 WHEN 'education' THEN -0.25 ELSE 0 END
      + CASE WHEN third_ THEN -0.55 ELSE 0 END
      + CASE WHEN mobile_ THEN 0.15 WHEN country = 'IN' THEN -0.05 ELSE 0 END + CASE WHEN len(emails) > 0 THEN 0.12 ELSE 0 END) AS score,
    CASE WHEN own_ AND NOT foreign_ THEN 'explicit_label' WHEN idx < header_end OR section = 'personal_details' THEN 'contact_section' ELSE 'regex' END AS method,
    CASE WHEN own_ AND NOT foreign_ THEN 'explicit_label | regex' WHEN idx < header_end OR section = 'personal_details' THEN 'contact_section | regex' ELSE 'regex' END AS signals,
    coalesce(nullif(concat_ws('; ', CASE WHEN foreign_ THEN 'labelled as an alternate/third-party number' WHEN own_ THEN 'labelled as the candidate''s mobile/contact' END,
      CASE WHEN idx < header_end THEN 'in the header contact block' END, CASE WHEN section = 'personal_details' THEN 'in the personal details section' END,
      CASE WHEN section = 'references' THEN 'inside the references section' END, CASE WHEN third_ THEN 'attributed to a named third party' END,
      CASE WHEN section IN ('experience', 'education') THEN 'inside an employer/institute section' END,
      CASE WHEN mobile_ THEN 'valid Indian mobile format' WHEN country = 'IN' THEN 'Indian landline format' END,
      CASE WHEN len(emails) > 0 THEN 'on the same line as an email address' END), ''), 'matched a phone pattern') AS why
  FROM (SELECT *, {has('b45', V.OWN_PHONE_LABEL)} OR {has("coalesce(label, '')", V.OWN_PHONE_LABEL)} AS own_,
      {has('b45', V.FOREIGN_PHONE_LABEL)} OR {has("coalesce(label, '')", V.FOREIGN_PHONE_LABEL)} AS foreign_,
      {has('text', V.THIRD_PARTY_LINE)} OR {has("coalesce(nullif(prev_text, '') || ' ', '') || text", V.THIRD_PARTY_LINE)} AS third_,
      country = 'IN' AND regexp_matches(phone, '^\\+91[6-9][0-9]{{9}}$') AS mobile_ FROM phone_ok) y"""
CTE["phones_one"] = """SELECT doc_id, phone, arg_max(score, score) AS score, min(idx * 1000 + pos) AS first_at,
    arg_min(struct_pack(m := method, s := signals, w := why, i := idx), struct_pack(a := -score, b := idx * 1000 + pos)) AS h
  FROM phones_scored WHERE score > 0 GROUP BY doc_id, phone"""
CTE["phones_ranked"] = """SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS next_score FROM phones_one
  WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first_at)"""
CTE["phone_alts"] = """SELECT doc_id, string_agg(phone || '=' || cast(cast(least(score, 0.99) AS double) AS varchar), ' | ' ORDER BY rk) AS alts FROM phones_ranked WHERE rk BETWEEN 2 AND 4 GROUP BY doc_id"""
CTE["phone_best"] = """SELECT t.doc_id, CASE WHEN score >= 0.32 THEN phone ELSE 'Not Found' END AS phone,
    CASE WHEN score >= 0.32 THEN cast(least(score, 0.99, CASE WHEN score - next_score < 0.15 THEN 0.72 WHEN score - next_score < 0.30 THEN 0.85 ELSE 0.99 END) AS double) ELSE 0 END AS phone_confidence,
    CASE WHEN score >= 0.32 THEN h.m ELSE 'none' END AS phone_method,
    CASE WHEN score >= 0.32 THEN h.w WHEN score IS NULL THEN 'no digit run in the document passed phone validation'
      ELSE 'the only numbers found are attributed to someone else (best: ' || h.w || ')' END AS phone_why,
    CASE WHEN score >= 0.32 THEN h.i END AS phone_line, CASE WHEN score >= 0.32 THEN coalesce(alts, '') END AS phone_alternatives
  FROM txt t LEFT JOIN (SELECT * FROM phones_ranked WHERE rk = 1) r ON t.doc_id = r.doc_id LEFT JOIN phone_alts a ON a.doc_id = t.doc_id"""
CTE["mention_raw"] = f"SELECT doc_id, unnest(regexp_extract_all(text, {q(V.PHONE_MENTION)}, 0)) AS raw FROM txt"
CTE["mention"] = f"SELECT DISTINCT doc_id, phone FROM ({phone_cases('raw', 'mention_raw')}) z WHERE {VALID}"

# ------------------------------------------------------------------ name
TITLE_WORD = f"""CASE WHEN regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}') THEN w ELSE array_to_string(list_transform(string_split(w, '-'),
  lambda p: array_to_string(list_transform(string_split(p, ''''), lambda x: {cap('x')}), '''')), '-') END"""


def clean_name(raw: str) -> str:
    s = f"trim({chain(squeeze(rep(raw, V.NAME_JOINERS, ' ')), (V.NAME_HONORIFIC, ''), (V.NAME_SUFFIX, ''))})"
    return f"""(SELECT CASE WHEN len(tw) BETWEEN 1 AND 5 AND len(list_filter(tw, lambda w: NOT {has('w', V.NAME_TOKEN)})) = 0 THEN array_to_string(tw, ' ') END
      FROM (SELECT list_transform(list_filter(string_split(s, ' '), lambda w: w <> ''), lambda w: {TITLE_WORD}) AS tw
        FROM (SELECT {s} AS s) s0 WHERE length(s) BETWEEN 3 AND 60 AND NOT {has('s', V.NOT_A_NAME)}) s1)"""


STRIPPED = f"trim({chain('text', (V.EMAIL, ' '), (V.CONTACT_DIGITS, ' '), (V.CONTACT_URL, ' '), (chr(92) + 's{2,}', ' '))})"
N = V.NAME_POINTS
CTE["names_place"] = f"""SELECT doc_id, idx, 1 AS step, value AS raw, 0.62 AS score, 'explicit_label' AS signal, 'explicit "' || label || '" label' AS why FROM lines WHERE {has('label', V.NAME_LABEL)}
  UNION ALL SELECT doc_id, idx, 2, {STRIPPED}, greatest(0.12, 0.42 - 0.05 * idx), 'header_detection', 'name-shaped line ' || idx || ' of the header'
    FROM lines WHERE NOT is_heading AND idx < CASE WHEN has_headings THEN header_end ELSE 6 END
  UNION ALL SELECT doc_id, idx, 3, CASE WHEN {has('label', V.NAME_LABEL)} THEN value ELSE text END, 0.30, 'contact_section', 'in the personal details section'
    FROM lines WHERE NOT is_heading AND section = 'personal_details'
  UNION ALL SELECT doc_id, idx, 4, {STRIPPED}, 0.22, 'contact_section', 'adjacent to the contact line' FROM lines WHERE NOT is_heading AND beside_email
  UNION ALL SELECT doc_id, idx, 5, trim(text), 0.20, 'heuristic', 'isolated name-shaped line ' || idx || ', corroborated (header window found nothing)'
    FROM lines WHERE NOT is_heading AND section <> 'references' AND length(trim(text)) BETWEEN 1 AND 40"""
CTE["names_clean"] = f"""SELECT r.*, m.name FROM names_place r JOIN (SELECT raw, {clean_name('raw')} AS name FROM (SELECT DISTINCT raw FROM names_place)) m ON r.raw = m.raw WHERE name IS NOT NULL"""
CTE["doc_tokens"] = f"""SELECT t.doc_id, ocr_confidence, list_distinct(list_filter(regexp_split_to_array(lower({rep('file_name', '(?i)[.][a-z0-9]+$', '')}), {q(V.FILE_TOKEN_SPLIT)}),
      lambda x: length(x) >= 3 AND NOT list_contains({lst(V.FILE_TOKEN_STOP)}, x))) AS ft,
    coalesce(e.et, []) AS et
  FROM cv_text t LEFT JOIN (SELECT doc_id, list(DISTINCT tok) AS et FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(split_part(m, '@', 1)), {q(V.EMAIL_TOKEN_SPLIT)})) AS tok
    FROM (SELECT doc_id, unnest(emails) AS m FROM lines)) WHERE length(tok) >= 3 GROUP BY doc_id) e ON e.doc_id = t.doc_id"""
CTE["names_hit"] = """SELECT c.*, k.ft, k.et, k.ocr_confidence FROM names_clean c JOIN doc_tokens k ON k.doc_id = c.doc_id
  WHERE step < 5 OR (NOT EXISTS (SELECT 1 FROM names_clean o WHERE o.doc_id = c.doc_id AND o.step < 5) AND len(string_split(name, ' ')) BETWEEN 2 AND 4
    AND len(list_filter(string_split(lower(name), ' '), lambda w: list_contains(k.et, w) OR list_contains(k.ft, w))) > 0)"""
CTE["names_merged"] = """SELECT doc_id, lower(name) AS name_key, arg_min(name, struct_pack(s := step, i := idx)) AS name, max(score) AS score, min(struct_pack(s := step, i := idx)) AS first_at,
    list(signal ORDER BY step, idx) AS sigs, string_agg(why, '; ' ORDER BY step, idx) AS why, any_value(ft) AS ft, any_value(et) AS et, any_value(ocr_confidence) AS ocr
  FROM names_hit GROUP BY doc_id, lower(name)"""
CTE["names_scored"] = """SELECT *, CASE WHEN nl = 0 THEN base ELSE base + CASE WHEN eh >= 2 THEN 0.30 WHEN eh = 1 THEN 0.18 ELSE 0 END + CASE WHEN fh >= 2 THEN 0.24 WHEN fh = 1 THEN 0.14 ELSE 0 END
      - CASE WHEN lone THEN 0.25 ELSE 0 END + CASE WHEN nw IN (2, 3) THEN 0.08 ELSE 0 END END AS score,
    why0 || CASE WHEN eh > 0 THEN '; ' || eh || ' token(s) match the email address' ELSE '' END || CASE WHEN fh > 0 THEN '; ' || fh || ' token(s) match the file name' ELSE '' END
      || CASE WHEN nl > 0 AND lone THEN '; single word with no corroboration' ELSE '' END AS why
  FROM (SELECT * EXCLUDE (score, why), cast(score AS decimal(9,6)) AS base, why AS why0, len(string_split(name_key, ' ')) AS nw, len(list_filter(string_split(name_key, ' '), lambda w: length(w) >= 3)) AS nl,
      len(list_filter(string_split(name_key, ' '), lambda w: length(w) >= 3 AND list_contains(et, w))) AS eh, len(list_filter(string_split(name_key, ' '), lambda w: length(w) >= 3 AND list_contains(ft, w))) AS fh,
      len(string_split(name_key, ' ')) = 1 AND len(list_filter([name_key], lambda w: length(w) >= 3 AND (list_contains(et, w) OR list_contains(ft, w)))) = 0 AND NOT list_contains(sigs, 'explicit_label') AS lone
    FROM names_merged) n0"""
CTE["names_ranked"] = """SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS next_score FROM names_scored WHERE score > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first_at)"""
CTE["name_alts"] = """SELECT doc_id, string_agg(name || '=' || cast(cast(least(score, 0.99) AS double) AS varchar), ' | ' ORDER BY rk) AS alts FROM names_ranked WHERE rk BETWEEN 2 AND 4 GROUP BY doc_id"""
CTE["name_fixed"] = """SELECT doc_id, string_agg(coalesce(fixed, w), ' ' ORDER BY k) AS fixed FROM (
    SELECT doc_id, k, w, CASE WHEN length(w) >= 4 AND NOT list_contains(ft, lower(w)) AND len(near) = 1 THEN upper(near[1][1]) || near[1][2:] END AS fixed
    FROM (SELECT doc_id, ft, k, w, list_filter(ft, lambda t: length(t) >= 4 AND levenshtein(lower(w), t) = 1) AS near
      FROM (SELECT doc_id, ft, unnest(string_split(name, ' ')) AS w, unnest(range(len(string_split(name, ' ')))) AS k FROM names_ranked WHERE rk = 1 AND ocr IS NOT NULL AND len(ft) > 0))) GROUP BY doc_id"""
CTE["name_best"] = """SELECT t.doc_id, coalesce(f.fixed, r.name, 'Not Found') AS name,
    CASE WHEN r.doc_id IS NULL THEN 0 ELSE cast(least(score, 0.99, CASE WHEN score - next_score < 0.10 THEN 0.70 ELSE 0.99 END) AS double) END AS name_confidence,
    CASE WHEN r.doc_id IS NULL THEN 'none' WHEN list_contains(sigs, 'explicit_label') THEN 'explicit_label' WHEN nl > 0 AND eh > 0 THEN 'email_local_part' ELSE sigs[1] END AS name_method,
    CASE WHEN r.doc_id IS NULL THEN CASE WHEN s.doc_id IS NULL THEN 'no line in the document matched a person-name shape' ELSE 'all name candidates were rejected during scoring' END
      ELSE why || CASE WHEN f.fixed <> r.name THEN '; spelling corrected from the file name (OCR glyph confusion)' ELSE '' END END AS name_why,
    coalesce(f.fixed <> r.name, false) AS name_corrected, CASE WHEN r.doc_id IS NOT NULL THEN coalesce(alts, '') END AS name_alternatives
  FROM txt t LEFT JOIN (SELECT * FROM names_ranked WHERE rk = 1) r ON r.doc_id = t.doc_id LEFT JOIN name_fixed f ON f.doc_id = t.doc_id
    LEFT JOIN name_alts a ON a.doc_id = t.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM names_scored) s ON s.doc_id = t.doc_id"""

# ------------------------------------------------------------------ taxonomy and role
TAX = built_in()
CTE["surface"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(s.family)}, {q(s.canonical)}, {q(s.surface)}, {q(s.kind)}, {s.role_ord}, {s.ord})" for s in TAX.surfaces()) + ") v(family, canonical, surface, kind, role_ord, ord)"


def key(t: str) -> str:
    return squeeze(chain(f"lower({t})", (r"[._/\\|,]+", " "), (r"[^\p{L}\p{N}+#\s-]", " "), (r"\s*-\s*", " ")))


def toks(t: str) -> str:
    return f"list_filter(string_split({key(t)}, ' '), lambda x: x <> '' AND NOT list_contains({lst(V.ROLE_STOP_TOKENS)}, x))"


SENIOR = sorted(V.SENIORITY_PREFIXES, key=len, reverse=True)
SENIOR_RE = "(?i)^(" + "|".join(p.replace(".", r"\.") for p in SENIOR) + r")\b[\s.-]*"
SPELLED = "MAP {" + ", ".join(f"{q(p.lower())}: {q(p.rstrip('.'))}" for p in SENIOR) + "}"
CTE["surface_key"] = f"SELECT *, {key('surface')} AS k FROM surface"
CTE["lookup"] = """SELECT k, coalesce(max(canonical) FILTER (ord = lastc), max(canonical) FILTER (ord = firsta)) AS canonical,
    coalesce(max(family) FILTER (ord = lastc), max(family) FILTER (ord = firsta)) AS family, CASE WHEN any_value(lastc) IS NULL THEN 'alias' ELSE 'canonical' END AS kind
  FROM (SELECT *, max(CASE WHEN kind = 'canonical' THEN ord END) OVER (PARTITION BY k) AS lastc, min(CASE WHEN kind = 'alias' THEN ord END) OVER (PARTITION BY k) AS firsta FROM surface_key) x GROUP BY k"""
CTE["generic"] = f"SELECT DISTINCT {key('g')} AS k FROM (SELECT unnest({lst(V.GENERIC_TITLES)}) AS g)"
CTE["role_token"] = f"SELECT DISTINCT role_ord, canonical, family, unnest({toks('surface')}) AS tok FROM surface"
# every distinct title any query probes
CTE["matched"] = f"""SELECT p.title, p.senior, p.rest, g.k IS NOT NULL AS generic, CASE WHEN g.k IS NULL THEN coalesce(a.canonical, b.canonical, o.canonical) END AS canonical,
    CASE WHEN g.k IS NULL THEN coalesce(a.family, b.family, o.family) END AS family,
    CASE WHEN g.k IS NULL THEN coalesce(a.kind, b.kind, CASE WHEN o.canonical IS NOT NULL THEN 'token_overlap' END) END AS kind,
    CASE WHEN g.k IS NOT NULL THEN NULL WHEN coalesce(a.kind, b.kind) = 'canonical' THEN 1000 WHEN coalesce(a.kind, b.kind) = 'alias' THEN 950 ELSE o.strength END AS strength
  FROM probe p LEFT JOIN generic g ON g.k = p.k1 LEFT JOIN lookup a ON a.k = p.k1 LEFT JOIN lookup b ON b.k = p.k2
  LEFT JOIN (SELECT title, canonical, family, cast(ceil(cast(shared * 850 AS decimal(12,4)) / n - 0.5) AS bigint) AS strength FROM (
      SELECT title, n, r.role_ord, any_value(canonical) AS canonical, any_value(family) AS family, count(*) AS shared,
        row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, r.role_ord) AS rn
      FROM (SELECT title, len(t) AS n, unnest(t) AS tok FROM (SELECT title, {toks("coalesce(nullif(rest, ''), title)")} AS t FROM probe)) u JOIN role_token r ON r.tok = u.tok
      GROUP BY title, n, r.role_ord HAVING count(*) >= 2 AND count(*) * 10 >= n * 6) s WHERE rn = 1) o ON o.title = p.title"""
CTE["probe"] = f"""SELECT title, {SPELLED}[lower(nullif(regexp_extract(trim(title), {q(SENIOR_RE)}, 1), ''))] AS senior,
    trim({rep('trim(title)', SENIOR_RE, '')}) AS rest, {key('title')} AS k1, {key(f"trim({rep('trim(title)', SENIOR_RE, '')})")} AS k2
  FROM (SELECT DISTINCT title FROM probe_title) d"""


def clean_title(raw: str) -> str:
    s = chain(squeeze(rep(raw, "[•·*|]+", " ")), (r"^[-–—:\s]+", ""), (r"[.,;:]+$", ""), (V.TITLE_QUALIFIER, ""), (V.TITLE_RELATIVE, ""), (V.TITLE_HEAD_NOUN, ""), (V.TITLE_ARTICLE, ""))
    return f"trim({s})"


def is_title(s: str) -> str:
    letters = f"length({rep(s, r'[^' + chr(92) + r'p{L}]', '')})"
    return f"""length({s}) BETWEEN 3 AND 60 AND len(list_filter(string_split({s}, ' '), lambda w: w <> '')) <= 6 AND NOT {has(s, '(?i)@|https?:|[0-9]{4,}')}
      AND {letters} >= 0.75 * length({rep(s, chr(92) + 's', '')})"""


def title_case(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: CASE WHEN length(w) <= 4 AND regexp_matches(w, '^[A-Z./]+$') THEN w ELSE {cap('w')} END), ' ')"


CTE["windows"] = """SELECT doc_id, idx, section, header_end, text, false AS joined FROM lines WHERE NOT is_heading
  UNION ALL SELECT doc_id, idx, section, header_end, text || ' ' || next_text, true FROM lines WHERE NOT is_heading AND next_text IS NOT NULL"""
CTE["scan_text"] = """SELECT DISTINCT text FROM (SELECT text FROM windows WHERE section IN ('objective', 'summary') UNION ALL SELECT text FROM first_exp)"""
CTE["first_exp"] = """SELECT doc_id, idx, text FROM (SELECT doc_id, idx, text, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM lines
  WHERE section = 'experience' AND NOT is_heading AND trim(text) <> '') x WHERE rn = 1"""
CTE["scanned"] = """SELECT text, arg_min(surface, struct_pack(a := -length(surface), b := ord)) AS surface FROM scan_text s JOIN surface f ON length(surface) >= 3
  AND (contains(' ' || lower(text) || ' ', ' ' || lower(surface) || ' ') OR contains(' ' || lower(text) || ' ', ' ' || lower(surface) || '.') OR contains(' ' || lower(text) || ' ', ' ' || lower(surface) || ','))
  GROUP BY text"""
R = V.ROLE_POINTS
CTE["roles_hit"] = f"""SELECT doc_id, idx, 1 AS tier, 0 AS sub, 0.72 AS base, 'explicit_label' AS signal, value AS raw, 'explicit "' || label || '" label' AS why FROM lines WHERE {has('label', V.APPLIED_LABEL)}
  {' '.join(f'''UNION ALL SELECT doc_id, idx, 2, CASE WHEN joined THEN 10 ELSE 0 END + {i}, 0.58 + CASE WHEN section IN ('objective', 'summary', 'header') THEN 0.08 ELSE 0 END - CASE WHEN joined THEN 0.02 ELSE 0 END,
    'keyword_match', regexp_extract(text, {q(p)}, 1), 'intent phrase in the ' || section || ' section' || CASE WHEN joined THEN ' (spanning wrapped lines)' ELSE '' END FROM windows WHERE {has('text', p)}''' for i, p in enumerate(V.INTENT_PATTERNS))}
  UNION ALL SELECT doc_id, idx, 3, CASE WHEN joined THEN 1 ELSE 0 END, 0.50 - CASE WHEN joined THEN 0.02 ELSE 0 END, 'taxonomy_match', surface,
    'known job title inside the ' || section || ' block' || CASE WHEN joined THEN ' (spanning wrapped lines)' ELSE '' END FROM windows w JOIN scanned s ON s.text = w.text WHERE section IN ('objective', 'summary')
  UNION ALL SELECT doc_id, idx, 4, 0, 0.46, 'header_detection', trim(text), 'standalone job title in the header' FROM header_title
  UNION ALL SELECT doc_id, idx, 5, 0, 0.30, 'explicit_label', value, 'current-designation label "' || label || '" (history, not intent)' FROM lines WHERE {has('label', V.CURRENT_LABEL)}
  UNION ALL SELECT doc_id, 1000000 + idx, 5, 1, 0.26, 'keyword_match', surface, 'most recent experience entry (history, not intent)' FROM first_exp e JOIN scanned s ON s.text = e.text"""
CTE["header_title"] = """SELECT * FROM lines WHERE NOT is_heading AND idx < header_end AND length(trim(text)) BETWEEN 1 AND 50 AND NOT regexp_matches(text, '(?i)@|[0-9]{4,}|https?:')"""
CTE["roles_title"] = f"SELECT * FROM (SELECT *, {clean_title('raw')} AS title FROM roles_hit) x WHERE {is_title('title')}"
CTE["probe_title"] = "SELECT title FROM roles_title UNION ALL SELECT trim(text) FROM header_title"
CTE["cands_role"] = f"""SELECT r.doc_id, r.idx, r.tier, r.sub, r.title, cast(r.base + coalesce(m.strength, 0) * 0.00012 AS decimal(9,6)) AS score, r.signal, m.canonical, m.family,
    CASE WHEN m.canonical IS NULL THEN {title_case('r.title')} WHEN m.senior IS NULL OR regexp_matches(m.canonical || ' ', '(?i)^' || m.senior || '[^A-Za-z0-9_]') THEN m.canonical ELSE {title_case('m.senior')} || ' ' || m.canonical END AS role,
    r.why || CASE WHEN m.canonical IS NULL THEN '; no taxonomy entry, kept as written' ELSE '; resolved to taxonomy entry "' || m.canonical || '" (' || m.kind || ')' END AS why
  FROM roles_title r JOIN matched m ON m.title = r.title LEFT JOIN matched h ON r.tier = 4 AND h.title = r.raw
  WHERE NOT m.generic AND (r.tier <> 4 OR h.canonical IS NOT NULL) AND (m.canonical IS NOT NULL OR {has('r.title', V.TITLE_NOUN)})"""
CTE["roles_ranked"] = """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, idx, sub) AS rk,
    CASE tier WHEN 1 THEN 0.97 WHEN 2 THEN 0.90 WHEN 3 THEN 0.82 WHEN 4 THEN 0.78 ELSE 0.55 END AS ceiling FROM cands_role"""
CTE["role_top"] = "SELECT * FROM roles_ranked WHERE rk = 1"
CTE["role_other"] = """SELECT b.doc_id, count(*) FILTER (lower(c.role) = lower(b.role) AND c.tier <> b.tier) > 0 AS second_tier,
    max(c.score) FILTER (lower(c.role) <> lower(b.role) AND c.tier = b.tier) AS rival FROM role_top b JOIN roles_ranked c ON c.doc_id = b.doc_id GROUP BY b.doc_id"""
CTE["role_alts"] = """SELECT doc_id, string_agg(role || '=' || cast(cast(round(least(score, ceiling), 3) AS double) AS varchar), ' | ' ORDER BY rk) AS alts FROM (
    SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.rk) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(role) ORDER BY rk) AS again FROM roles_ranked) r
    JOIN role_top b ON b.doc_id = r.doc_id WHERE again = 1 AND lower(r.role) <> lower(b.role)) x WHERE n <= 3 GROUP BY doc_id"""
CTE["role_best"] = """SELECT t.doc_id, coalesce(b.role, 'Not Found') AS role,
    CASE WHEN b.role IS NULL THEN 0 ELSE cast(round(least(CASE WHEN second_tier THEN least(ceiling, least(score, ceiling) + 0.06) ELSE least(score, ceiling) END,
      CASE WHEN abs(rival - score) < 0.08 THEN 0.70 ELSE 1 END), 3) AS double) END AS role_confidence,
    CASE WHEN b.role IS NULL THEN 'none' WHEN signal IN ('explicit_label', 'keyword_match') THEN signal WHEN canonical IS NOT NULL THEN 'taxonomy_match' ELSE signal END AS role_method,
    coalesce('tier ' || b.tier || ': ' || b.why, 'no applied-role statement, intent phrase or recognised job title was found') AS role_why, b.tier AS role_tier,
    CASE WHEN b.role IS NOT NULL THEN coalesce(alts, '') END AS role_alternatives
  FROM txt t LEFT JOIN role_top b ON b.doc_id = t.doc_id LEFT JOIN role_other o ON o.doc_id = t.doc_id LEFT JOIN role_alts a ON a.doc_id = t.doc_id"""

# ------------------------------------------------------------------ assembly and validation
CTE["fields"] = """SELECT c.doc_id, c.ocr_confidence, n.name, n.name_method, n.name_why, p.phone, p.phone_method, p.phone_why, r.role, r.role_method, r.role_why,
    round(cast(n.name_confidence AS decimal(9,6)) * pen, 3) AS nc, round(cast(p.phone_confidence AS decimal(9,6)) * pen, 3) AS pc, round(cast(r.role_confidence AS decimal(9,6)) * pen, 3) AS rc
  FROM (SELECT doc_id, ocr_confidence, cast(CASE WHEN ocr_confidence IS NULL OR ocr_confidence >= 0.9 THEN 1 WHEN ocr_confidence >= 0.75 THEN 0.94 WHEN ocr_confidence >= 0.6 THEN 0.85 ELSE 0.7 END AS decimal(4,2)) AS pen FROM cv_text) c
  JOIN name_best n ON n.doc_id = c.doc_id JOIN phone_best p ON p.doc_id = c.doc_id JOIN role_best r ON r.doc_id = c.doc_id"""


def missing(v: str) -> str:
    return f"({v} IS NULL OR trim({v}) = '' OR {has(f'trim({v})', V.MISSING_VALUE)})"


def name_reason(raw: str) -> str:
    n = f"trim({rep(squeeze(raw), V.VALID_HONORIFIC, '')})"
    return f"""CASE WHEN {missing(raw)} THEN 'Candidate name not found' WHEN length({n}) < 2 OR length({n}) > 80 THEN 'Candidate name has implausible length'
      WHEN {' OR '.join(has(n, p) for p in V.NAME_REJECTS)} THEN 'Candidate name rejected (looks like an organisation, label or non-candidate): "' || {n} || '"'
      WHEN len(string_split({n}, ' ')) > 6 THEN 'Candidate name has too many words' WHEN NOT {has(n, V.VALID_NAME)} THEN 'Candidate name contains invalid characters' END"""


def name_value(raw: str) -> str:
    n = f"trim({rep(squeeze(raw), V.VALID_HONORIFIC, '')})"
    return f"CASE WHEN {n} = upper({n}) OR {n} = lower({n}) THEN {words_cap(n)} ELSE {n} END"


def role_value(raw: str) -> str:
    return rep(squeeze(raw), "[.:;,]+$", "")


def role_reason(raw: str) -> str:
    r = role_value(raw)
    return f"""CASE WHEN {missing(raw)} THEN 'Job role not found' WHEN length({r}) < 2 OR length({r}) > 100 THEN 'Job role has implausible length'
      WHEN {' OR '.join(has(r, p) for p in V.ROLE_REJECTS)} THEN 'Job role rejected as generic: "' || {r} || '"' WHEN {has(r, V.ROLE_BAD_CHARS)} THEN 'Job role contains invalid characters' END"""


CTE["checked"] = f"""SELECT f.*, {name_reason('name')} AS name_reason, {name_value('name')} AS name_v, {role_reason('role')} AS role_reason, {role_value('role')} AS role_v,
    CASE WHEN {missing('f.phone')} THEN 'Phone number not found' END AS phone_reason,
    contains({rep('x.text', '[' + chr(92) + 's' + chr(92) + '-().]', '')}, right(regexp_replace(f.phone, '[^0-9]', '', 'g'), 8)) AS in_text, coalesce(k.n, 0) AS n_numbers
  FROM fields f JOIN cv_text x ON x.doc_id = f.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM mention GROUP BY doc_id) k ON k.doc_id = f.doc_id"""
CTE["weighed"] = """SELECT *, CASE WHEN name_reason IS NULL THEN nc ELSE 0 END AS n1, CASE WHEN role_reason IS NULL THEN rc ELSE 0 END AS r1,
    CASE WHEN phone_reason IS NOT NULL THEN 0 WHEN NOT in_text THEN least(pc, 0.4) WHEN n_numbers > 1 THEN least(pc, 0.9) ELSE pc END AS p1 FROM checked"""


def two(c: str) -> str:
    return f"cast(cast(round({c}, 2) AS decimal(4,2)) AS varchar)"


CTE["validated"] = f"""SELECT *, list_filter([name_reason, phone_reason, CASE WHEN phone_reason IS NULL AND NOT in_text THEN 'Phone number could not be verified against CV text' END, role_reason,
      'Below confidence threshold 0.75: ' || nullif(below, ''), CASE WHEN ocr_confidence < 0.6 THEN 'Low OCR confidence (' || {two('cast(ocr_confidence AS decimal(9,6))')} || ')' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter([CASE WHEN name_reason IS NOT NULL THEN 'NO_NAME_FOUND' END, CASE WHEN phone_reason IS NOT NULL THEN 'NO_PHONE_FOUND' WHEN NOT in_text THEN 'PHONE_NOT_IN_TEXT' END,
      CASE WHEN role_reason IS NOT NULL THEN 'NO_ROLE_FOUND' END, CASE WHEN below <> '' THEN 'LOW_CONFIDENCE' END], lambda x: x IS NOT NULL) AS codes,
    CASE WHEN name_reason IS NULL THEN name_v ELSE 'Not Found' END AS candidate_name, CASE WHEN phone_reason IS NULL THEN phone ELSE 'Not Found' END AS phone_number,
    CASE WHEN role_reason IS NULL THEN role_v ELSE 'Not Found' END AS job_role_applied_for, round(n1 * 0.40 + p1 * 0.35 + r1 * 0.25, 3) AS overall
  FROM (SELECT *, concat_ws(', ', CASE WHEN name_reason IS NULL AND n1 < 0.75 THEN 'name confidence ' || {two('n1')} END,
      CASE WHEN phone_reason IS NULL AND p1 < 0.75 THEN 'phone confidence ' || {two('p1')} END, CASE WHEN role_reason IS NULL AND r1 < 0.75 THEN 'job role confidence ' || {two('r1')} END) AS below FROM weighed) w"""


def sql(final: str, **override: str) -> str:
    """``final`` with the table expressions it reads, in dependency order."""
    tables = {**CTE, **override}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)\b", text):
            if name in tables and name not in order:
                need(tables[name])
                if name not in order:
                    order.append(name)

    need(final)
    if not order:
        return final
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}({tables[n]})" for n in order)
    return f"WITH {body}\n{final}"
