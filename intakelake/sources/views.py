"""Input tables derived from the test data.

Each view is stated once as portable SQL expressions; ``Dialect`` covers the few
spellings on which Spark SQL and the checking engine differ, so both read the
same rows. The views hold inputs only, never an operator's logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import values as V
from ..session import tuned


@dataclass(frozen=True)
class Dialect:
    sha256: Callable[[str], str]
    pick: Callable[[list, str], str]
    add_seconds: Callable[[str, str], str]
    to_ts: Callable[[str], str]
    join_lines: Callable[[list], str]
    texts: Callable[[list], str]
    day: Callable[[str], str]
    table: Callable[[str], str]
    intdiv: Callable[[str, int], str]
    first_a_to_o: Callable[[str], str]
    squeeze_dots: Callable[[str], str]
    lines_of: Callable[[str, int, int], str]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sq(s: str) -> str:
    return '"' + s.replace('"', '\\"') + '"'


SPARK = Dialect(
    sha256=lambda x: f"sha2({x}, 256)",
    pick=lambda xs, i: f"element_at(array({', '.join(map(_sq, xs))}), cast(({i}) % {len(xs)} + 1 as int))",
    add_seconds=lambda ts, n: f"timestampadd(SECOND, cast({n} as int), {ts})",
    to_ts=lambda c: f"cast({c} as timestamp)",
    join_lines=lambda xs: f"array_join(array({', '.join(xs)}), '\\n')",
    texts=lambda xs: f"array_compact(array({', '.join(xs)}))" if xs else "cast(array() as array<string>)",
    day=lambda c: f"date_format({c}, 'yyyyMMdd')",
    table=lambda t: t,
    intdiv=lambda a, b: f"({a} div {b})",
    first_a_to_o=lambda c: f"regexp_replace({c}, '^([^a]*)a', '$1o')",
    squeeze_dots=lambda c: f"regexp_replace(lower({c}), '[^a-z]+', '.')",
    lines_of=lambda c, a, b: f"array_join(slice(split({c}, '\\n'), {a}, {b} - {a} + 1), '\\n')",
)
DUCK = Dialect(
    sha256=lambda x: f"sha256({x})",
    pick=lambda xs, i: f"([{', '.join(map(_q, xs))}])[({i}) % {len(xs)} + 1]",
    add_seconds=lambda ts, n: f"({ts} + to_seconds({n}))",
    to_ts=lambda c: f"cast({c} as timestamp)",
    join_lines=lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x is not null), chr(10))",
    texts=lambda xs: f"list_filter([{', '.join(xs)}]::varchar[], lambda x: x is not null)",
    day=lambda c: f"strftime({c}, '%Y%m%d')",
    table=lambda t: t,
    intdiv=lambda a, b: f"({a} // {b})",
    first_a_to_o=lambda c: rf"regexp_replace({c}, '^([^a]*)a', '\1o')",
    squeeze_dots=lambda c: f"regexp_replace(lower({c}), '[^a-z]+', '.', 'g')",
    lines_of=lambda c, a, b: f"array_to_string(string_split({c}, chr(10))[{a}:{b}], chr(10))",
)

NAMES = [
    "Asha Verghese", "Tomas Oliveira", "Leela Banerjee", "Marcus D'Costa", "Nadia Rahimi", "Jean-Luc Moreau",
    "Ishaan Tripathi", "Carmen Vidal", "Oluwaseun Adeyemi", "Harini Venkatesan", "Peter McAllister", "Zara Siddiqui",
    "Kunal Deshpande", "Mei Lin Zhao", "Fatima Al Hashimi", "Ravi K. Subbarao", "Greta Lindholm", "Devika Nambiar",
    "Samuel Osei", "Bhavna Chawla", "Lucía Romero", "Anton Petrov", "Sunita Rawat", "Omar Farouk Haddad",
    "Ingrid Solberg", "Chetan Barua", "Noor Jahan", "Mohit Sabharwal", "Élodie Garnier", "Vasudha Hegde",
]
ROLES = [  # stated on the CV, expected answer
    ("Data Analyst", "Data Analyst"), ("Software Engineer", "Software Developer"), ("Accountant", "Accountant"),
    ("DBA", "Database Administrator"), ("Senior Civil Engineer", "Senior Civil Engineer"),
    ("Website Developer", "Web Developer"), ("Mechanical Engineer", "Mechanical Engineer"), ("Sr. Accountant", "Sr Accountant"),
    ("Public Relations Officer", "Public Relations Officer"), ("Press Officer", "Public Relations Officer"),
    ("C++ Programmer", "Applications Programmer"), ("Staff Nurse", "Nurse"), ("Cloud Network Engineer", "Network Engineer"),
    ("Brand Strategist", "Brand Strategist"), ("Buyer", "Buyer"), ("Computer Systems Analyst", "Systems Analyst"),
    ("Secondary School Teacher", "Secondary School Teacher"), ("Lead Software Developer", "Lead Software Developer"),
]
CITIES = ["Pune", "Lagos", "Chennai", "Lisbon", "Kochi", "Dubai", "Jaipur", "Oslo", "Surat", "Accra"]
COMPANIES = ["Northgate Foods", "Bluepeak Retail", "Orchid Textiles", "Harbour Freight Lines", "Sterling Motors", "Maple Airways", "Quill Press"]

# A résumé is put together from named parts. Each part is one line or null; a layout is an order of parts.
# What a résumé shows follows from rolls: numbers below a bound, each from its own digits of a scrambled key.
ROLLS = {"layout": 4, "says": 8, "mark": 6, "form": 7, "mail": 12, "tail": 10, "look": 16, "spare": 9}
PARTS = {
    "banner": "CASE mark WHEN 0 THEN 'CURRICULUM VITAE' WHEN 1 THEN '=== RESUME ===' END",
    "name": "shown_name",
    "details_head": "CASE WHEN mark < 4 THEN 'Personal Details' ELSE '# PERSONAL INFORMATION' END",
    "name_row": "CASE WHEN mark < 3 THEN 'Full Name: ' WHEN mark = 3 THEN 'Candidate Name - ' ELSE 'Name ' END || shown_name",
    "headline": "CASE WHEN says = 3 THEN role_stated END",
    "place": "city || ', near the old market'",
    "phone": "phone",
    "phone_row": "CASE tail % 3 WHEN 0 THEN 'Mobile No: ' WHEN 1 THEN 'Phone ' ELSE 'WhatsApp / Cell - ' END || phone",
    "mail": "email",
    "mail_row": "'E-mail: ' || email",
    "strip": "email || coalesce(' | ' || phone, '') || ' | ' || city",
    "applied": "CASE WHEN says = 0 THEN 'Applied For: ' || role_stated WHEN says = 1 THEN 'Position Applied For - ' || role_stated WHEN says = 2 THEN 'Job Title: ' || role_stated END",
    "born": "'Date of Birth: 1' || cast(tail as string) || '/08/1990'",
    "home": "'Address: Flat ' || cast(spare + 1 as string) || ', ' || city || ' 4110' || lpad(cast(i % 100 as string), 2, '0')",
    "other_phone": "CASE WHEN look = 2 THEN 'Emergency contact (father): 022-2765 43' || lpad(cast(i % 100 as string), 2, '0') WHEN look = 3 THEN '97' || lpad(cast((i * 53 + 9) % 100000000 as string), 8, '0') END",
    "codes": "CASE look WHEN 4 THEN 'Pincode: 4110' || lpad(cast(i % 100 as string), 2, '0') WHEN 5 THEN 'Employee ID 2004' || lpad(cast(i % 1000000 as string), 6, '0') WHEN 6 THEN 'Aadhaar: 6543 2109 ' || cast(1000 + i % 9000 as string) WHEN 7 THEN 'Roll Number 98' || lpad(cast(i % 100000000 as string), 8, '0') END",
    "aim_head": "CASE WHEN says IN (4, 5) THEN CASE WHEN mark < 2 THEN 'Objective' ELSE '** CAREER OBJECTIVE **' END WHEN says = 7 THEN 'Profile Summary:' END",
    "aim": "CASE says WHEN 4 THEN CASE tail % 3 WHEN 0 THEN 'I wish to work as a ' || role_stated || ' with people who share what they know.' WHEN 1 THEN 'Looking for a suitable position as a ' || role_stated || ' in a growing firm.' ELSE 'Applying for the position of ' || role_stated || ', free from next month.' END WHEN 5 THEN 'Seeking a suitable role as a ' || split_part(role_stated, ' ', 1) WHEN 7 THEN CASE WHEN tail < 5 THEN role_stated || ' who has kept ' || cast(spare + 2 as string) || ' teams on time.' ELSE 'Has kept ' || cast(spare + 2 as string) || ' teams on time.' END END",
    "aim_rest": "CASE WHEN says = 5 THEN coalesce(nullif(trim(substr(role_stated, length(split_part(role_stated, ' ', 1)) + 1)), '') || ' ', '') || 'with a leading house where I can learn.' END",
    "work_head": "CASE WHEN mark % 2 = 0 THEN 'Employment History' ELSE '> PROFESSIONAL EXPERIENCE' END",
    "work_now": "CASE WHEN says = 6 THEN 'Present Position: ' || role_stated WHEN tail = 7 THEN role_stated || ', ' || company || ' (2017 - Present)' ELSE 'Associate at ' || company || ', 2018 to 2022' END",
    "work_note": "'- Kept the ledgers of ' || company || ' in order.'",
    "front_desk": "CASE WHEN look = 8 THEN company || ' front desk 044 2811 30' || lpad(cast(i % 100 as string), 2, '0') END",
    "school_head": "'EDUCATION'",
    "school": "'B.A. (Hons), ' || city || ' College, 2012 - 2015'",
    "skill_head": "CASE WHEN mark = 5 THEN 'Key Skills' ELSE 'SKILLS' END",
    "skill": "'Negotiation, filing, first aid, cycling'",
    "link": "CASE WHEN look = 9 THEN 'Samples: https://pieces.example/u/' || cast(i as string) || ' and www.pages.example' END",
    "people_head": "CASE WHEN spare < 3 THEN 'Referees' END",
    "people_one": "CASE WHEN spare < 3 THEN 'Prof. Hana Kimura, Dean, ' || company || ' - 96' || lpad(cast((i * 29 + 3) % 100000000 as string), 8, '0') END",
    "people_two": "CASE WHEN spare = 1 THEN 'Ms. Ada Obi, Director - +234 803 555 ' || cast(1000 + i % 9000 as string) END",
    "oath_head": "CASE WHEN tail < 6 THEN 'Declaration' END",
    "oath": "CASE WHEN tail < 6 THEN 'All of this is true to my knowledge. ' || name END",
}
_BODY = ["aim_head", "aim", "aim_rest", "work_head", "work_now", "work_note", "front_desk"]
_END = ["link", "people_head", "people_one", "people_two", "oath_head", "oath"]
LAYOUTS = {
    "letter": ["banner", "name", "headline", "place", "phone", "mail", "applied", "codes", "other_phone", *_BODY, "school_head", "school", "skill_head", "skill", *_END],
    "form": ["banner", "applied", "details_head", "name_row", "born", "phone_row", "other_phone", "mail_row", "home", "codes", "headline", "school_head", "school", *_BODY, *_END],
    "sidebar": ["skill_head", "skill", "school_head", "school", "name", "headline", "phone", "mail", "applied", "other_phone", *_BODY, "codes", *_END],
    "strip": ["name", "strip", "headline", "applied", *_BODY, "other_phone", "codes", "skill_head", "skill", "school_head", "school", "banner", *_END],
}


def _rolls(d: Dialect) -> str:
    """Each roll from its own digits of a scrambled key, in whole numbers both engines agree on."""
    out, step = [], 1
    for name, sides in ROLLS.items():
        out.append(f"{d.intdiv('key', step)} % {sides} AS {name}")
        step *= sides
    return ", ".join(out)


def _cv_text(d: Dialect) -> str:
    text = "CASE layout " + " ".join(f"WHEN {n} THEN {d.join_lines([PARTS[p] for p in parts])}" for n, parts in enumerate(LAYOUTS.values())) + " END"
    forms = ["digits", "'+91 ' || digits", "'0' || digits", "'+91-' || digits", "'0091 ' || digits", "'+91 ' || substr(digits, 1, 5) || ' ' || substr(digits, 6)", "'(+91) ' || substr(digits, 1, 5) || '-' || substr(digits, 6)"]
    traits = {"scanned": "scanned", "referees": "spare < 3", "second_number": "look IN (2, 3)", "codes": "look BETWEEN 4 AND 7", "titled": "look = 10",
              "no_phone": "digits IS NULL", "no_role": "says = 7 AND tail >= 5", "current_role_only": "says = 6"}
    return f"""
    SELECT i AS doc_id, workspace_id,
           CASE WHEN tail < 3 THEN 'scan_' || cast(i as string) || '_Resume.pdf' ELSE replace(name, ' ', '_') || '_' || cast(i as string) || '_Resume.pdf' END AS file_name,
           {text} AS text,
           CASE WHEN scanned THEN cast(55 + i % 45 as double) / 100 END AS ocr_confidence,
           name AS truth_name, '+91' || digits AS truth_phone, CASE WHEN NOT (says = 7 AND tail >= 5) THEN role_expected END AS truth_role,
           {d.texts(["'style:' || cast(says as string)", *[f"CASE WHEN {when} THEN '{trait}' END" for trait, when in traits.items()]])} AS traits
    FROM (SELECT *,
            CASE WHEN look = 10 THEN 'Ms. ' ELSE '' END || CASE WHEN look = 11 THEN {d.first_a_to_o('name')} WHEN look = 12 THEN upper(name) ELSE name END AS shown_name,
            CASE form {' '.join(f'WHEN {n} THEN {x}' for n, x in enumerate(forms))} END AS phone,
            CASE WHEN mail = 0 THEN 'hello.there' ELSE {d.squeeze_dots('name')} END || cast(i % 90 + 10 as string) || '@post.example' AS email
          FROM (SELECT *, {_rolls(d)}, key % 11 = 5 AS scanned,
                  CASE WHEN key % 19 <> 3 THEN cast(6 + key % 4 as string) || lpad(cast((key * 31 + 271828183) % 1000000000 as string), 9, '0') END AS digits,
                  {d.pick(NAMES, d.intdiv('key', 7))} AS name, {d.pick([r[0] for r in ROLES], d.intdiv('key', 11))} AS role_stated, {d.pick([r[1] for r in ROLES], d.intdiv('key', 11))} AS role_expected,
                  {d.pick(CITIES, d.intdiv('key', 13))} AS city, {d.pick(COMPANIES, d.intdiv('key', 17))} AS company
                FROM (SELECT o_orderkey AS i, c_nationkey AS workspace_id, (o_orderkey * 1640531527 + 97) % 2147483647 AS key FROM orders JOIN customer ON o_custkey = c_custkey) k) a) b"""


def _view_sql(d: Dialect) -> dict[str, str]:
    ts = d.to_ts
    sql = {}
    sql["workspace"] = f"""
    SELECT n_nationkey AS workspace_id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug, n_regionkey <> 4 AS is_active,
           {d.add_seconds("timestamp '1995-01-01 00:00:00'", 'n_nationkey * 86400')} AS created_at
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
    sql["app_user"] = f"""
    SELECT s_suppkey AS user_id, s_nationkey AS workspace_id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'ADMIN' ELSE 'RECRUITER' END AS role,
           {d.add_seconds("timestamp '1995-02-01 00:00:00'", '((s_suppkey * 37) % 1000) * 3600')} AS created_at
    FROM supplier"""
    sql["cv_file"] = f"""
    SELECT o_orderkey AS cv_file_id, c_nationkey AS workspace_id,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'GOOGLE_DRIVE' ELSE 'MANUAL' END AS source_type,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'd' || cast(o_orderkey as string) END AS source_file_id,
           'cv_' || cast(o_orderkey as string) || '_Resume.' || CASE o_orderkey % 5 WHEN 2 THEN 'docx' WHEN 3 THEN 'png' ELSE 'pdf' END AS file_name,
           CASE o_orderstatus WHEN 'P' THEN 'SKIPPED'
             WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'PROCESSING' END
             ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' WHEN o_orderkey % 10 <= 3 THEN 'NEEDS_REVIEW' ELSE 'PROCESSED' END END AS status,
           {d.add_seconds(ts('o_orderdate'), '(o_orderkey * 7919) % 86400')} AS created_at,
           {d.sha256("cast(o_custkey as string) || ':' || cast(o_orderkey % 3 as string)")} AS file_hash,
           cast(round(o_totalprice) as bigint) AS file_size, o_custkey % 1000 AS uploaded_by
    FROM orders JOIN customer ON o_custkey = c_custkey"""
    sql["processing_job"] = f"""
    SELECT cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string)
             || '-' || {d.day('l_shipdate')} AS job_id,
           l_orderkey AS cv_file_id, 'batch_' || cast(l_suppkey as string) AS batch_id,
           CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN CASE WHEN l_partkey % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'PROCESSED' END
             ELSE CASE WHEN l_linestatus = 'F' THEN 'PROCESSED' WHEN l_partkey % 5 = 0 THEN 'PROCESSING' ELSE 'PENDING' END END AS status,
           CASE WHEN l_returnflag = 'R' THEN CASE l_partkey % 4 WHEN 0 THEN 'NO_TEXT' WHEN 1 THEN 'LLM_AUTH' WHEN 2 THEN 'INTERRUPTED' END END AS error_code,
           1 + l_partkey % 3 AS attempts, cast(3 as bigint) AS max_attempts, {ts('l_shipdate')} AS created_at
    FROM lineitem"""
    sql["cv_text"] = _cv_text(d)
    sql["candidate"] = f"""
    SELECT *, cast(round(name_c * 0.4 + phone_c * 0.35 + role_c * 0.25, 3) as double) AS overall_confidence,
           cast(name_c as double) AS name_confidence, cast(phone_c as double) AS phone_confidence, cast(role_c as double) AS role_confidence
    FROM (SELECT o_orderkey AS cv_file_id,
        {d.pick(NAMES, 'o_orderkey * 11 + o_custkey')} AS candidate_name,
        CASE WHEN o_orderkey % 10 = 2 THEN '{V.NOT_FOUND}' ELSE '+91' || lpad(cast(6000000000 + (o_custkey * 48271) % 3999999999 as string), 10, '0') END AS phone_number,
        CASE WHEN o_orderkey % 10 = 3 THEN '{V.NOT_FOUND}' ELSE {d.pick([r[1] for r in ROLES], 'o_orderkey * 5 + 2')} END AS job_role_applied_for,
        cast(cast(60 + o_orderkey % 40 as decimal(9,3)) / 100 as decimal(6,3)) AS name_c,
        cast(CASE WHEN o_orderkey % 10 = 2 THEN 0 ELSE cast(70 + o_orderkey % 30 as decimal(9,3)) / 100 END as decimal(6,3)) AS phone_c,
        cast(CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE cast(50 + o_orderkey % 48 as decimal(9,3)) / 100 END as decimal(6,3)) AS role_c,
        o_orderkey % 29 = 1 AS is_manually_corrected,
        {d.texts(["CASE WHEN o_orderkey % 29 = 1 THEN 'candidateName' END", "CASE WHEN o_orderkey % 58 = 1 THEN 'phoneNumber' END"])} AS corrected_fields,
        {d.texts(["CASE WHEN o_orderkey % 10 = 2 THEN 'Phone number not found' END", "CASE WHEN o_orderkey % 10 = 3 THEN 'Job role not found' END",
                  "CASE WHEN o_orderkey % 10 IN (1, 3) THEN 'Below confidence threshold 0.75: name confidence 0.61, phone confidence 0.71' END"])} AS review_reasons,
        {d.texts(["CASE WHEN o_orderkey % 10 = 2 THEN 'NO_PHONE_FOUND' END", "CASE WHEN o_orderkey % 10 = 3 THEN 'NO_ROLE_FOUND' END",
                  "CASE WHEN o_orderkey % 10 IN (1, 3) THEN 'LOW_CONFIDENCE' END"])} AS review_codes,
        CASE o_orderkey % 5 WHEN 2 THEN 'DOCX' WHEN 3 THEN 'OCR_IMAGE' WHEN 4 THEN 'OCR_PDF' ELSE 'PDF_TEXT' END AS extraction_method,
        CASE WHEN o_orderkey % 12 = 5 THEN 'llm' ELSE 'local' END AS extraction_engine,
        CASE WHEN o_orderkey % 12 = 5 THEN 'v1' ELSE '{V.ENGINE_VERSION}' END AS extraction_version,
        cast(CASE WHEN o_orderkey % 12 = 5 THEN 1200 + o_orderkey % 900 ELSE o_orderkey % 4 END as bigint) AS extraction_ms,
        o_orderkey % 5 IN (3, 4) AS ocr_used,
        {d.add_seconds(ts('o_orderdate'), '90000 + (o_orderkey * 7919) % 86400')} AS processed_at
      FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0) c"""
    sql["page_text"] = """
    SELECT conv_id AS doc_id, turn AS page_no, text, cast((conv_id + turn) % 50 + 50 as bigint) AS confidence_pct FROM conversations"""
    # Two decoded pages of each résumé: what the file's text layer holds, and what OCR reads. One file in 37 holds nothing.
    sql["cv_page"] = f"""
    SELECT doc_id, page_no, file_name, mime_type, CASE WHEN hidden THEN '' ELSE page END AS text, CASE WHEN hidden AND doc_id % 37 <> 5 THEN page ELSE '' END AS ocr_text,
        cast(round(coalesce(ocr_confidence, 0.9) * 100) as bigint) AS confidence_pct
      FROM (SELECT *, CASE page_no WHEN 0 THEN {d.lines_of('text', 1, 9)} ELSE {d.lines_of('text', 10, 99)} END AS page, ocr_confidence IS NOT NULL OR mime_type = 'image/png' OR doc_id % 37 = 5 AS hidden
        FROM (SELECT *, 0 AS page_no, CASE doc_id % 5 WHEN 2 THEN '{V.EXTENSION_MIME['.docx']}' WHEN 3 THEN 'image/png' ELSE 'application/pdf' END AS mime_type FROM cv_text
          UNION ALL SELECT *, 1 AS page_no, CASE doc_id % 5 WHEN 2 THEN '{V.EXTENSION_MIME['.docx']}' WHEN 3 THEN 'image/png' ELSE 'application/pdf' END AS mime_type FROM cv_text) p0) p1"""
    sql["ignore_list"] = """
    SELECT workspace_id, source_file_id AS file_id, cv_file_id AS seq FROM cv_file WHERE source_type = 'GOOGLE_DRIVE' AND cv_file_id % 13 = 0"""
    sql["source_connection"] = f"""
    SELECT s_suppkey AS connection_id, s_nationkey AS workspace_id, s_suppkey % 9 <> 4 AS is_active,
           CASE WHEN s_suppkey % 7 <> 3 THEN 'folder_' || cast(s_nationkey as string) END AS folder_id,
           CASE WHEN s_suppkey % 4 <> 1 THEN {d.add_seconds(f"timestamp '{V.AS_OF}'", '-60 * (s_suppkey % 12)')} END AS last_sync_at,
           s_suppkey % 6 <> 2 AS has_page_token
    FROM supplier"""
    sql["feed"] = f"""
    SELECT CASE WHEN cv_file_id % 3 = 2 THEN 'n' || cast(cv_file_id as string) ELSE source_file_id END AS file_id, workspace_id,
           file_name AS name,
           CASE cv_file_id % 11 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN '{V.FOLDER_MIME}' WHEN 2 THEN '{V.HOSTED_DOC_MIME}'
             WHEN 3 THEN 'image/png' WHEN 4 THEN 'text/plain' ELSE 'application/pdf' END AS mime_type,
           {d.texts(["'folder_' || cast(workspace_id as string)", "CASE WHEN cv_file_id % 5 = 0 THEN 'shared' END"])} AS parents_in,
           {d.texts(["'elsewhere'"])} AS parents_out,
           cv_file_id % 8 = 1 AS moved, cv_file_id % 17 = 4 AS trashed, cv_file_id % 19 = 7 AS removed,
           CASE WHEN cv_file_id % 23 <> 9 THEN {d.add_seconds('created_at', '86400 * CASE WHEN cv_file_id % 3 = 1 THEN 1 ELSE 0 END')} END AS modified_at
    FROM cv_file WHERE source_type = 'GOOGLE_DRIVE'"""
    sql["job_event"] = f"""
    SELECT event_id, user_id AS cv_file_id, {ts('ts')} AS ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING'
             WHEN 'click' THEN 'PROCESSED' WHEN 'purchase' THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS status,
           CASE WHEN event_id % 2 = 0 THEN 'MANUAL' ELSE 'GOOGLE_DRIVE' END AS source_type, 1 + event_id % 3 AS attempts, cast(3 as bigint) AS max_attempts
    FROM events"""
    sql["heartbeat"] = f"SELECT user_id AS worker_id, event_id, {ts('ts')} AS ts FROM events"
    sql["request"] = f"SELECT user_id AS key, event_id, {ts('ts')} AS ts FROM events"
    sql["signup_request"] = f"""
    SELECT c_custkey AS request_id, c_name AS name, {d.add_seconds(f"timestamp '{V.AS_OF}'", '-3600 * (c_custkey % 400)')} AS created_at,
           c_custkey % 4 = 0 AS consumed, c_custkey % 5 AS attempts FROM customer"""
    sql["setting"] = """
    SELECT s_suppkey AS setting_id, CASE WHEN s_suppkey % 10 = 9 THEN '{}'
        ELSE '{"confidenceThreshold": ' || cast(s_suppkey % 13 as string) || '.0e-1, "maxRetries": ' || cast(s_suppkey % 12 as string)
          || ', "ocrMaxPages": ' || cast(s_suppkey % 6 as string) || CASE WHEN s_suppkey % 3 = 0 THEN ', "extractionEngine": "shadow"' ELSE '' END
          || CASE WHEN s_suppkey % 4 = 0 THEN ', "driveFolderId": "folder_' || cast(s_suppkey as string) || '"' ELSE '' END || '}' END AS value
    FROM supplier"""
    sql["taxonomy_setting"] = """
    SELECT s_suppkey AS setting_id, CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE
        '{"version": "' || CASE WHEN s_suppkey % 6 = 4 THEN '' ELSE '2.' || cast(s_suppkey as string) END || '", "families": ['
        || CASE WHEN s_suppkey % 7 = 6 THEN '' ELSE '{"family": "Group ' || cast(s_nationkey as string) || '", "roles": [{"canonical": "Role '
        || cast(s_suppkey as string) || '", "aliases": ["R' || cast(s_suppkey as string) || '", "Alias ' || cast(s_suppkey % 9 as string) || '"]}'
        || CASE WHEN s_suppkey % 2 = 0 THEN ', {"canonical": "' || CASE WHEN s_suppkey % 8 = 2 THEN 'X' ELSE 'Extra Role' END || '", "aliases": []}' ELSE '' END
        || ']}' || CASE WHEN s_suppkey % 3 = 0 THEN ', {"family": "Second", "roles": [{"canonical": "Helper", "aliases": ["Aide"]}]}' ELSE '' END END
        || '], "seniorityPrefixes": ["Senior", "Sr."], "genericRejects": ["Any"]}' END AS value
    FROM supplier"""
    sql["reply_log"] = """
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 404 WHEN 4 THEN 400 WHEN 5 THEN 503 WHEN 6 THEN 429 ELSE 418 END AS http_status,
        CASE doc_id % 8 WHEN 6 THEN '{"error": {"type": "insufficient_quota", "message": "You exceeded your current quota"}}'
          WHEN 4 THEN '{"error": {"message": "bad input ' || cast(doc_id as string) || '", "code": "invalid"}}'
          WHEN 5 THEN 'upstream down' ELSE '{"error": {"message": "note ' || source || '"}}' END AS body,
        CASE doc_id % 6
          WHEN 0 THEN '```json' || chr(10) || '{"candidate_name": "Person ' || cast(doc_id as string) || '", "phone_number": "+919812345678", "confidence": {"candidate_name": 0.9, "phone_number": 0.8}}' || chr(10) || '```'
          WHEN 1 THEN 'Here you go: {"job_role_applied_for": "Nurse", "confidence": {"job_role_applied_for": 0.5}} thanks'
          WHEN 2 THEN '{}' WHEN 3 THEN 'no object here' WHEN 4 THEN '{"confidence": {"candidate_name": 1.5}}'
          ELSE '{"candidate_name": "Ada ' || lang || '", "phone_number": "n/a", "job_role_applied_for": "Teacher", "confidence": {"candidate_name": 1, "phone_number": 0, "job_role_applied_for": 0.25}}' END AS reply
    FROM documents"""
    sql["all_text"] = """
    SELECT doc_id, text FROM cv_text UNION ALL SELECT -1 - doc_id AS doc_id, text FROM documents"""
    # Results of two runs over the same corpus: the truth with known damage.
    sql["result_row"] = f"""
    SELECT doc_id, engine, traits, truth_name, truth_phone, truth_role,
        CASE WHEN doc_id % (7 + 2 * e) = 1 THEN '{V.NOT_FOUND}' WHEN doc_id % (9 + e) = 4 THEN 'Someone Else' WHEN doc_id % 2 = 0 THEN upper(truth_name) ELSE truth_name END AS got_name,
        CASE WHEN truth_phone IS NULL THEN CASE WHEN doc_id % (4 + e) = 1 THEN '+919000000000' ELSE '{V.NOT_FOUND}' END
             WHEN doc_id % (11 + e) = 2 THEN '+919111111111' WHEN doc_id % 2 = 0 THEN replace(truth_phone, '+91', '+91 ') ELSE truth_phone END AS got_phone,
        CASE WHEN truth_role IS NULL THEN CASE WHEN doc_id % (5 + e) = 2 THEN 'Clerk' ELSE '{V.NOT_FOUND}' END
             WHEN doc_id % (13 - e) = 3 THEN '{V.NOT_FOUND}' WHEN doc_id % 10 = 3 THEN 'Lead ' || truth_role WHEN truth_role = 'Software Developer' THEN 'Software Programmer'
             WHEN doc_id % (8 + e) = 5 THEN 'Plumber' ELSE truth_role END AS got_role,
        1 + (doc_id * 7919) % 500 + e * 2000 AS total_ms, (doc_id * 104729) % 40 + e * 1500 AS extract_ms,
        doc_id % (3 + e) = 0 AS needs_review, doc_id % (101 + e) = 0 AS failed
    FROM (SELECT *, 'local' AS engine, 0 AS e FROM cv_text UNION ALL SELECT *, 'remote' AS engine, 1 AS e FROM cv_text) r"""
    # Field values of every kind, for the validators.
    sql["field_value"] = """
    SELECT doc_id, engine, CASE doc_id % 9 WHEN 1 THEN 'Apex Solutions Pvt' WHEN 2 THEN 'mr. ' || lower(truth_name) WHEN 3 THEN truth_name || ' 1234' WHEN 4 THEN 'Resume' WHEN 5 THEN 'n/a'
             WHEN 6 THEN 'A B C D E F ' || truth_name WHEN 7 THEN 'x' ELSE got_name END AS got_name,
        CASE doc_id % 8 WHEN 1 THEN '12345' WHEN 2 THEN '1234567890' WHEN 3 THEN '011-2345' || cast(doc_id % 9000 + 1000 as string) WHEN 4 THEN 'none' WHEN 5 THEN '00' || substr(truth_phone, 2) ELSE got_phone END AS got_phone,
        CASE doc_id % 10 WHEN 1 THEN 'Any suitable role' WHEN 2 THEN 'Challenging position in sales' WHEN 3 THEN truth_role || ' #1' WHEN 4 THEN ' ' WHEN 5 THEN truth_role || ';' WHEN 6 THEN 'position' ELSE got_role END AS got_role
    FROM result_row"""
    sql["patch"] = """
    SELECT o_orderkey AS cv_file_id, CASE o_orderkey % 4 WHEN 0 THEN 'asha pillai' WHEN 1 THEN 'Globex Ltd' WHEN 2 THEN 'Not Found' END AS candidate_name,
        CASE o_orderkey % 5 WHEN 0 THEN '98765 43210' WHEN 1 THEN '123' WHEN 2 THEN 'not found' END AS phone_number,
        CASE o_orderkey % 6 WHEN 0 THEN 'Nurse.' WHEN 1 THEN 'any' END AS job_role_applied_for
    FROM orders WHERE o_orderkey % 4 <> 3 OR o_orderkey % 5 < 3 OR o_orderkey % 6 < 2"""
    sql["failure"] = """
    SELECT job_id, attempts, max_attempts, CASE attempts WHEN 1 THEN 'LLM_RATE_LIMITED' WHEN 2 THEN 'NO_TEXT' ELSE 'ECONNRESET' END AS code,
        cv_file_id % 3 = 0 AS app_error, attempts = 1 AND cv_file_id % 3 = 0 AS app_transient, CASE WHEN cv_file_id % 7 = 1 THEN 'AbortError' END AS error_name,
        CASE cv_file_id % 5 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 503 END AS http_status,
        CASE cv_file_id % 4 WHEN 0 THEN 'Request timed out after a while' WHEN 1 THEN 'bad input' ELSE repeat('long message ', 100) END AS message
    FROM processing_job WHERE status = 'FAILED'"""
    return sql


RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SPARK_VIEWS = _view_sql(SPARK)
DUCK_VIEWS = _view_sql(DUCK)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named input table over the parquet files of ``sf_dir``.

    ``given`` replaces tables it reads, for instance by one micro-batch of a stream.
    """
    tuned(spark)
    given, frames, sql = given or {}, {}, SPARK_VIEWS[name]
    for dep in RAW + list(SPARK_VIEWS):
        if dep != name and re.search(rf"\b(?:FROM|JOIN)\s+{dep}\b", sql):
            frames[dep] = given[dep] if dep in given else view(spark, sf_dir, dep, given) if dep in SPARK_VIEWS else raw(spark, sf_dir, dep)
    if name == "cv_text":
        # texts are composed after a narrow shuffle on their key, in as many tasks as the jobs that read them
        frames["orders"] = frames["orders"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    sql = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}} AS {m[2]}" if m[2] in frames else m[0], sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(sql, **frames)
