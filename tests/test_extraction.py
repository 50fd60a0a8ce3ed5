"""Behaviour of the extractors on small texts, and brute-force checks of the similarity joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from intakelake.functions.titles import role_tokens
from intakelake.operators import structure as st, taxonomy as tx
from intakelake.plans.extraction import extract_fields, parse_documents
from intakelake.session import tuned
from intakelake.sources.taxonomy import Taxonomy, built_in

MOBILE_FORMS = ["9812345670", "+91 9812345670", "+91-9812345670", "+91 98123 45670", "09812345670", "0091 9812345670", "(+91) 98123-45670"]
CASES = {
    "own": "Asha Rao\nMobile: +91 98123 45670\nAlternate Contact (Office): 011-23456789\nasha@mail.example",
    "referee": "Asha Rao\nMobile: +91 98123 45670\nREFERENCES\nMr. Dev Anand, Manager, Quill - 9899988877",
    "only_referee": "Asha Rao\nasha@mail.example\nMr. Dev Anand, Manager, Quill - 9899988877",
    "decoys": "Asha Rao\nasha@mail.example\nPIN Code: 560001\nEmployee ID: 100233445\nAadhaar: 1234 5678 9012\nCurrent CTC: 1200000 per annum",
    "years": "Asha Rao\nasha@mail.example\nQuill, Pune (2018 - 2021)",
    "zeros": "Asha Rao\nMobile: 0000000000",
    "intl": "Asha Rao\nPhone: +1 (415) 555-0123\nasha@mail.example",
    "two": "Asha Rao\n9812345670\n9123456780\nasha@mail.example",
    "heading": "CURRICULUM VITAE\nAsha Rao\nasha.rao@mail.example",
    "sidebar": "SKILLS\nsql, charts\nEDUCATION\nB.Sc 2016\nAsha Rao\nasha.rao@mail.example",
    "wrapped": "Asha Rao\nCAREER OBJECTIVE\nSeeking a challenging position as a Digital\nMarketing Executive in a reputed organisation.",
    "history": "Asha Rao\nWORK EXPERIENCE\nData Analyst, Quill (2019 - Present)",
    "generic": "Asha Rao\nApplied For: Any Position",
    "senior": "Asha Rao\nPosition: Sr. Accountant",
    "ocr": "Meera Lyer\nmail@mail.example\nPhone 9812345670",
    "empty": "",
} | {f"form{i}": f"Asha Rao\nMobile: {m}\nasha@mail.example" for i, m in enumerate(MOBILE_FORMS)}


def texts(spark, cases):
    rows = [(i, k, v, "Meera_Iyer_Resume.pdf" if k == "ocr" else "cv.pdf", 0.7 if k == "ocr" else None) for i, (k, v) in enumerate(cases.items())]
    return spark.createDataFrame(rows, "doc_id long, k string, text string, file_name string, ocr_confidence double")


@pytest.fixture(scope="module")
def found(spark):
    tuned(spark)
    t = texts(spark, CASES)
    return {r["k"]: r for r in extract_fields(t).join(t.select("doc_id", "k"), "doc_id").collect()}


def test_mobile_forms(found):
    for i in range(len(MOBILE_FORMS)):
        assert found[f"form{i}"].phone == "+919812345670" and found[f"form{i}"].phone_confidence > 0.75


@pytest.mark.parametrize("case,phone", [("own", "+919812345670"), ("referee", "+919812345670"), ("only_referee", "Not Found"), ("decoys", "Not Found"),
                                        ("years", "Not Found"), ("zeros", "Not Found"), ("intl", "+14155550123"), ("empty", "Not Found")])
def test_phone(found, case, phone):
    assert found[case].phone == phone


def test_phone_evidence(found):
    assert found["own"].phone_method == "explicit_label" and found["own"].phone_line == 1
    assert found["two"].phone_confidence < found["own"].phone_confidence
    assert found["only_referee"].phone_why.startswith("the only numbers found")


def test_names(found):
    assert found["heading"].name == "Asha Rao" and found["heading"].name_method == "email_local_part"
    assert found["sidebar"].name == "Asha Rao"
    assert found["ocr"].name == "Meera Iyer" and found["ocr"].name_corrected
    assert found["empty"].name == "Not Found"


def test_roles(found):
    assert found["wrapped"].role == "Digital Marketing Executive"
    assert found["history"].role == "Data Analyst" and found["history"].role_confidence <= 0.55
    assert found["generic"].role == "Not Found"
    assert found["senior"].role == "Sr Accountant"


def test_row_order_and_partitions_do_not_matter(spark):
    t = texts(spark, CASES)
    a = {tuple(r) for r in parse_documents(t).select("doc_id", "candidate_name", "phone_number", "job_role_applied_for", "overall_confidence").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = {tuple(r) for r in parse_documents(t.orderBy(F.desc("doc_id")).coalesce(2)).select(
        "doc_id", "candidate_name", "phone_number", "job_role_applied_for", "overall_confidence").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.catalog.clearCache()
    assert a == b


TITLES = ["Cloud Data Engineer", "Data Analyst", "Senior Backend Ninja Developer", "Node.js Developer", "Big Data", "developer developer", "UX Designer lead",
          "Key Account Person Manager", "x", "Any", "Sr.Accountant", "C# Developer", "Lead Java Developer", "Technical support writer content"]


def test_overlap_equals_nested_loops(spark):
    tax = built_in()
    rows = [(i, 0, t) for i, t in enumerate(TITLES)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, title string")
    got = {r.title: (r.m_canonical, r.m_strength) for r in tx.role_match(df, ["doc_id", "seq"], "title", tax).filter("m_kind = 'token_overlap'").collect()}
    names = [s.surface for s in tax.surfaces()]
    toks = {r.s: r.t for r in spark.createDataFrame([(s,) for s in {*TITLES, *names}], "s string").select("s", role_tokens(F.col("s")).alias("t")).collect()}
    sets: dict = {}
    for s in tax.surfaces():
        sets.setdefault(s.canonical, set()).update(toks[s.surface])
    for title, (canonical, strength) in got.items():
        probe = toks[title] if not title.startswith(("Senior", "Lead")) else toks[title][1:]
        cover = [(sum(t in ts for t in probe), c) for c, ts in sets.items()]
        best = max(n for n, _ in cover)
        assert canonical == next(c for n, c in cover if n == best) and best >= 2 and best / len(probe) >= 0.6
        assert abs(strength - 850 * best / len(probe)) <= 0.5


def test_overlap_asks_few_roles(spark):
    """Rare tokens are asked first: many roles share common ones, few are candidates, and none that fits is missing."""
    kinds = [f"Kind{i}" for i in range(60)]
    roles = [{"canonical": f"{k} {common} Developer", "aliases": []} for k in kinds for common in ("Web", "Data")] + [{"canonical": "Web Developer", "aliases": ["Site Developer"]}]
    tax = Taxonomy("1", [{"family": "All", "roles": roles}])
    titles = ["Kind7 Web Developer", "Kind7 Developer", "Web Developer", "Developer", "Other Web Thing Developer Person", "Kind1 Kind2 Kind3 Data", "Nothing known here", "Kind5 Web Kind5 Developer", "", "Senior Site Web Developer"]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumn("rest", F.col("title"))
    sets = tx.role_sets(tx.surface_frame(spark, tax))
    size = tx.index_size(spark, tax)
    assert size == sum(len(r.tokens) for r in sets.collect()) and size <= tx.BROADCAST_ROWS
    probe = tx._packed(df.withColumn("_t", role_tokens(F.col("title"))), ["id"])
    asked: dict = {}
    for r in tx.overlap_candidates(probe, ["id"], sets, size).where("role_ord is not null").collect():
        asked.setdefault(r.id, set()).add(r.role_ord)
    by_role = {r.role_ord: set(r.tokens) for r in sets.collect()}
    tokens = {r.id: r.t for r in df.select("id", role_tokens(F.col("title")).alias("t")).collect()}
    for i, t in tokens.items():
        fits = {o for o, ts in by_role.items() if sum(x in ts for x in t) >= max(2, 0.6 * len(t))}
        assert fits <= asked.get(i, set())
    assert len(asked[0]) <= 2 + 61 and len(asked[1]) <= 2 and len(asked.get(3, ())) == 0 and 6 not in asked
    out = {r.id: r.o_canonical for r in tx.role_overlap(df, ["id"], "title", tax, F.lit(True)).collect()}
    for i, t in tokens.items():
        cover = sorted(((-sum(x in ts for x in t), o) for o, ts in by_role.items() if sum(x in ts for x in t) >= max(2, 0.6 * len(t))))
        assert out[i] == (roles[cover[0][1]]["canonical"] if cover else None)


LINES = ["looking for a data analyst.", "node.js developer, remote", "senior accountant", "an sre or dba", "xdata analyst", "data analystx", "ba", "c# developer",
         ".net developer", "work as data  analyst", "Full Stack Developer with data analyst, and more", "developer", ""]


def test_scan_equals_nested_loops(spark):
    tax = built_in()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "id long, text string")
    got = {r.id: r.surface for r in tx.surface_scan(df, ["id"], tax).collect()}
    forms = sorted((s for s in tax.surfaces() if len(s.surface) >= 3), key=lambda s: (-len(s.surface), s.ord))
    for i, line in enumerate(LINES):
        hay = f" {line.lower()} "
        want = next((s.surface for s in forms if any(f" {s.surface.lower()}{e}" in hay for e in " .,")), None)
        assert got[i] == want, line


def test_forms_stand_on_their_rarest_word(spark):
    names = [f"Senior Data {x} Lead" for x in ("Zeta", "Eta", "Theta", "Iota")] + [f"Senior {i} Analyst" for i in range(100, 160)] + ["Senior", "Data Lead", ".Net Data Lead"]
    tax = Taxonomy("1", [{"family": "All", "roles": [{"canonical": n, "aliases": []} for n in names]}])
    forms = tx.anchored(tx.surface_frame(spark, tax))
    words = [r.word for r in forms.collect()]
    assert len(words) == len(names) and max(words.count(w) for w in set(words)) <= 2  # first words would put 65 of 67 on one
    lines = ["a senior data eta lead.", "senior 120 analyst, or senior 121", "data lead", "work on .net data lead", "senior data", "xsenior datax leads", "senior  120 analyst"]
    got = {r.id: r.surface for r in tx.surface_scan(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), ["id"], tax).collect()}
    order = sorted(enumerate(names), key=lambda x: (-len(x[1]), x[0]))
    for i, line in enumerate(lines):
        assert got[i] == next((n for _, n in order if any(f" {n.lower()}{e}" in f" {line} " for e in " .,")), None), line


def test_custom_taxonomy(spark):
    tax = Taxonomy.from_json('{"version": "2", "families": [{"family": "Sea", "roles": [{"canonical": "Deck Officer", "aliases": ["Mate"]}]}], "seniorityPrefixes": ["Chief"], "genericRejects": []}')
    t = texts(spark, {"a": "Asha Rao\nApplied For: Chief Mate"})
    assert extract_fields(t, tax).first().role == "Chief Deck Officer"


def test_each_text_is_scanned_and_shuffled_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("a.pdf").alias("file_name"), F.lit(None).cast("double").alias("ocr_confidence"))
    plan = st.annotate_lines(t.select("doc_id", "text", F.struct("file_name").alias("facts")), keep=["facts"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    rest = parse_documents(t)._jdf.queryExecution()
    assert "documents.parquet" not in rest.toString()  # what follows reads the written lines
    plan = rest.executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sections(spark):
    t = spark.createDataFrame([(1, "Asha\n*** EDUCATION ***\nB.Sc\n1. Experience\nExperience in teams of many people across several cities")], "doc_id long, text string")
    rows = st.annotate_lines(t).orderBy("idx").collect()
    assert [r.section for r in rows] == ["header", "education", "education", "experience", "experience"]
    assert [r.is_heading for r in rows] == [False, True, False, True, False]
    assert rows[0].header_end == 1


HEADINGS = """Career Objective|Objectives|Career Goal|Professional Objective|Job Objective|Professional Summary|Summary|Profile|About Me|Profile Summary|Executive Summary|Career Summary|Synopsis|Overview
Resume Headline|Headline|Personal Details|Personal Information|Bio Data|Bio-data|Candidate Details|Work Experience|Employment History|Professional Experience|Work History|Career History|職務|Internships
Education|Educational Qualifications|Academic Record|Academic Details|Qualifications|Technical Skills|Key Skills|Core Competencies|Professional Skills|IT Skills|Expertise|Technologies|Tech Stack|Competency
Projects|Academic Projects|Major Project|Project Details|Certifications|Courses|Training|Achievements|Awards|Accomplishments|References|Referee|Reference Details|Declaration|I hereby declare|Address|Hobbies"""


def test_cheap_test_lets_every_heading_through(spark):
    from intakelake import values as V
    from intakelake.functions.regex import matches

    df = spark.createDataFrame([(h.strip(),) for h in HEADINGS.replace("\n", "|").split("|")], "bare string")
    slow = F.coalesce(*[F.when(matches(F.col("bare"), p), name) for name, p in V.SECTIONS])
    rows = df.select("bare", st.detect_section(F.col("bare")).alias("got"), slow.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(r.want is None for r in rows) == 2


def test_fixed_values():
    from intakelake import values as V

    assert (V.OCR_MIN_CHARS, V.MIN_TEXT_CHARS, V.REPEAT_LINE_CHARS, V.PHONE_FLOOR, V.THRESHOLD, V.EXPORT_CHUNK) == (150, 20, 25, 32, 750, 2000)
    assert {k: v[-1] for k, *v in V.SETTINGS if k in ("ocrMaxPages", "maxCvTextChars", "confidenceThreshold")} == {"confidenceThreshold": 0.75, "maxCvTextChars": 20000, "ocrMaxPages": 5}
