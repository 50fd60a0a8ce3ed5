"""The role applied for: evidence in five tiers, intent before history.

Points are 1/100000, because a taxonomy match adds 0.12 x a three-digit strength.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions.regex import group, matches
from ..functions.stage import once
from ..functions.titles import clean_title, is_title, present_role, title_case, title_shaped
from ..sources.taxonomy import Taxonomy
from ..session import checkpointed
from .taxonomy import role_match, surface_scan

P = V.ROLE_POINTS
UNIT = 1000  # per hundredth
WRAPPED = " (spanning wrapped lines)"
#: Letters that words of intent begin with are told first, as the test is made at every character.
INTENT_WORD = r"(?i)(?=[slwtapr])(?:se(?:eking|arching)|looking|to\s+work|w(?:ish|ant)\s|a(?:spire|pply|s\s+an?\s)|(?:po(?:sition|st)|role)\s+of)"


def role_evidence(lines: DataFrame) -> DataFrame:
    """Candidate phrases of every tier in one pass; rows with ``scan`` still need a title found in them.

    Only the kind of evidence is exploded, and nulls leave next: what it says is worked out for the few rows that stay.
    """
    text, label, section = F.col("text"), F.coalesce("label", F.lit("")), F.col("section")
    body, trimmed, n = ~F.col("is_heading"), F.trim("text"), len(V.INTENT_PATTERNS)
    df = once(lines, _joined=F.concat_ws(" ", "text", "next_text"))
    df = once(df.withColumn("_intent", body & matches(F.col("_joined"), INTENT_WORD)), _phrases=_intent_phrases())
    stated = section.isin("objective", "summary")
    in_header = body & (F.col("idx") < F.col("header_end")) & F.length(trimmed).between(1, 50) & ~trimmed.rlike(r"(?i)@|\d{4,}|https?:")
    kinds = {10: matches(label, V.APPLIED_LABEL), 30: body & stated, 31: body & stated & F.col("next_text").isNotNull(), 40: in_header,
             50: matches(label, V.CURRENT_LABEL), 60: F.col("idx") == F.col("first_entry"), **{200 + k: F.get("_phrases", F.lit(k)).isNotNull() for k in range(2 * n)}}
    found = df.select("doc_id", "idx", "text", "label", "value", "section", "_joined", "_phrases", F.explode(F.array(*[F.when(c, k) for k, c in kinds.items()])).alias("kind"))
    kind, k = F.col("kind"), F.col("kind") - 200
    wrapped = (kind == 31) | (k >= n)
    boost = F.when(section.isin("objective", "summary", "header"), P["intent_boost"]).otherwise(0)
    step = F.when(k >= 0, 2).otherwise((kind / 10).cast("int"))
    sub = F.when(k >= n, k + 10 - n).when(k >= 0, k).when(wrapped, 10).otherwise(0)
    quoted = lambda before, after: F.concat(F.lit(before + '"'), label, F.lit('"' + after))
    rest = F.when(wrapped, WRAPPED).otherwise("")
    return found.filter("kind is not null").select(
        "doc_id", "idx",
        (step.cast("long") * 10**12 + F.col("idx") * 100 + sub).alias("seq"),
        F.least(step, F.lit(5)).alias("tier"),
        (F.when(step == 1, P["tier1"]).when(step == 2, P["tier2"] + boost).when(step == 3, P["tier3"]).when(step == 4, P["tier4"]).when(step == 5, P["tier5_label"])
         .otherwise(P["tier5_first"]) + F.when(wrapped, P["joined"]).otherwise(0)).cast("int").alias("points"),
        F.when(step.isin(1, 5), "explicit_label").when(step == 3, "taxonomy_match").when(step == 4, "header_detection").otherwise("keyword_match").alias("signal"),
        F.when(step.isin(1, 5), F.col("value")).when(step == 2, F.get("_phrases", k)).when(step == 4, trimmed).alias("raw"),
        F.when(kind == 31, F.col("_joined")).when(step.isin(3, 6), text).alias("scan"),
        F.when(step == 1, quoted("explicit ", " label")).when(step == 2, F.concat(F.lit("intent phrase in the "), section, F.lit(" section"), rest))
        .when(step == 3, F.concat(F.lit("known job title inside the "), section, F.lit(" block"), rest)).when(step == 4, "standalone job title in the header")
        .when(step == 5, quoted("current-designation label ", " (history, not intent)")).otherwise("most recent experience entry (history, not intent)").alias("why"),
    )


def _intent_phrases() -> Column:
    """First match of each intent pattern on the line, then on the line joined with the next."""
    alone = [group(F.col("text"), p) for p in V.INTENT_PATTERNS]
    wrapped = [F.when(F.col("next_text").isNotNull(), group(F.col("_joined"), p)) for p in V.INTENT_PATTERNS]
    return F.when(F.col("_intent"), F.array(*alone, *wrapped))


def role_candidates(lines: DataFrame, tax: Taxonomy) -> DataFrame:
    """Admitted candidates with their taxonomy match, displayed value and points.

    Scanned rows take the title found in them.
    """
    rows = surface_scan(role_evidence(lines), ["doc_id", "seq"], tax, "scan")
    rows = rows.withColumn("raw", F.coalesce("raw", "surface")).drop("scan", "surface").filter(F.col("raw").isNotNull())
    return role_admit(rows, tax)


def resolved_phrases(phrases: DataFrame, tax: Taxonomy) -> DataFrame:
    """raw, header, role, m_* and match strength of each distinct phrase that resolves or reads like a job title.

    People write the same titles over and over, so phrases are cleaned and matched once each, not once a place.
    A header line is probed both as written (it must resolve to a role) and cleaned.
    """
    c = once(phrases.select("raw", (F.col("tier") == 4).alias("header")).distinct(), title=clean_title(F.col("raw"))).filter(is_title(F.col("title")))
    as_written = F.when(F.col("header") & (F.col("raw") != F.col("title")), F.col("raw"))
    probes = F.when(as_written.isNull(), F.array(F.col("title"))).otherwise(F.array(F.col("title"), as_written))
    m = role_match(c.select("*", F.posexplode(probes).alias("probe_no", "probe")), ["raw", "header", "probe_no"], "probe", tax)
    cols = [x for x in m.columns if x not in ("raw", "header", "probe_no", "probe")]
    both = m.groupBy("raw", "header").agg(
        F.min_by(F.struct(*cols), "probe_no").alias("_m"), F.min(F.col("m_canonical").isNotNull()).alias("_all")).select("raw", "header", "_m.*", "_all")
    hit = F.col("m_canonical").isNotNull()
    kept = both.filter(~F.col("m_generic") & (hit | title_shaped(F.col("title"))) & (~F.col("header") | F.col("_all")))
    role = F.when(hit, present_role(F.col("m_canonical"), F.col("m_seniority"))).otherwise(title_case(F.col("title")))
    return kept.select("raw", "header", role.alias("role"), "m_canonical", "m_family", "m_kind", "m_strength")


def role_admit(phrases: DataFrame, tax: Taxonomy) -> DataFrame:
    """Clean, reject placeholders, resolve to the taxonomy; keep what resolves or reads like a job title.

    The phrases are written once and read twice: for what they say, and to be joined with it.
    """
    given = checkpointed(phrases)
    both = given.withColumn("header", F.col("tier") == 4).join(resolved_phrases(given, tax), ["raw", "header"])
    hit = F.col("m_canonical").isNotNull()
    return (
        both.withColumn("points", F.col("points") * UNIT + F.coalesce(F.col("m_strength") * P["match"], F.lit(0)))
        .withColumn("signals", F.when(hit, F.array("signal", F.lit("taxonomy_match"))).otherwise(F.array("signal")))
        .withColumn("why", F.when(hit, F.concat("why", F.lit('; resolved to taxonomy entry "'), "m_canonical", F.lit('" ('), "m_kind", F.lit(")")))
                    .otherwise(F.concat("why", F.lit("; no taxonomy entry, kept as written"))))
        .select("doc_id", "idx", "seq", "tier", "points", "role", "signals", "why", "m_canonical", "m_family")
    )


def _ceiling(tier: Column) -> Column:
    cap = F.lit(50)
    for t, c in V.TIER_CEILING.items():
        cap = F.when(tier == t, c).otherwise(cap)
    return cap * UNIT


def role_best(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Lowest tier, then points; bounded by the tier, raised by a second tier, lowered by a close rival."""
    in_order = Window.partitionBy("doc_id").orderBy("tier", F.desc("points"), "seq")
    pair = F.struct("role", "tier", "points", "signals", "why", "idx")
    df = (
        cands.withColumn("rank", F.row_number().over(in_order)).withColumn("_best", F.first(pair).over(in_order))
        .withColumn("_same", F.lower("role") == F.lower("_best.role")).withColumn("_rival", (F.col("tier") == F.col("_best.tier")) & ~F.col("_same"))
        .withColumn("_new", F.row_number().over(Window.partitionBy("doc_id", F.lower("role")).orderBy("rank")) == 1)
    )
    # of the roles that differ, only the three that are shown are gathered
    df = df.withColumn("_nth", F.sum((F.col("_new") & ~F.col("_same")).cast("int")).over(Window.partitionBy("doc_id").orderBy("rank")))
    capped = F.least("points", _ceiling(F.col("tier")))
    alt = F.when(F.col("_new") & ~F.col("_same") & (F.col("_nth") <= 3), F.struct("rank", F.col("role").alias("value"), _to3(capped).alias("confidence")))
    per_doc = df.groupBy("doc_id").agg(
        F.first("_best").alias("b"),
        F.max(F.col("_same") & (F.col("tier") != F.col("_best.tier"))).alias("second_tier"),
        F.max(F.when(F.col("_rival"), F.col("points"))).alias("rival"),
        F.sort_array(F.collect_list(alt)).alias("_alts"),
    )
    ceiling = _ceiling(F.col("b.tier"))
    conf = F.least("b.points", ceiling)
    conf = F.when(F.col("second_tier"), F.least(ceiling, conf + 6 * UNIT)).otherwise(conf)
    conf = F.when(F.abs(F.col("rival") - F.col("b.points")) < 8 * UNIT, F.least(conf, F.lit(70 * UNIT))).otherwise(conf)
    j = docs.select("doc_id").join(per_doc.withColumn("_conf", _to3(conf)), "doc_id", "left")
    has = lambda s: F.array_contains("b.signals", s)
    return j.select(
        "doc_id", F.coalesce("b.role", F.lit(V.NOT_FOUND)).alias("role"), F.coalesce("_conf", F.lit(0.0)).alias("role_confidence"),
        F.when(F.col("b").isNull(), "none").when(has("explicit_label"), "explicit_label").when(has("keyword_match"), "keyword_match")
        .when(has("taxonomy_match"), "taxonomy_match").otherwise(F.element_at("b.signals", 1)).alias("role_method"),
        F.coalesce(F.concat(F.lit("tier "), F.col("b.tier").cast("string"), F.lit(": "), F.col("b.why")),
                   F.lit("no applied-role statement, intent phrase or recognised job title was found")).alias("role_why"),
        F.col("b.tier").alias("role_tier"),
        F.transform("_alts", lambda a: F.struct(a["value"].alias("value"), a["confidence"].alias("confidence"))).alias("role_alternatives"),
    )


def _to3(points: Column) -> Column:
    """1/100000 points -> a three-decimal double."""
    return F.floor((points + 50) / 100).cast("double") / 1000
