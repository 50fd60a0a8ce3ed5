"""Resolving free-text titles to a role taxonomy.

A taxonomy is one settings document, bounded by the shape limits of
``values.TAXONOMY_LIMITS``; its flat tables are broadcast only when the row count,
known where the plan is built, is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import values as V
from ..functions.stage import once
from ..functions.titles import role_key, role_tokens, seniority_of, without_seniority
from ..sources.taxonomy import TAXONOMY_SCHEMA, Taxonomy, local_frame, surface_frame

BROADCAST_ROWS = 50_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of known row count; larger ones are left to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def taxonomy_lookup(surfaces: DataFrame, group: str | None = None) -> DataFrame:
    """Title key -> role. A canonical title beats any alias (the last canonical wins), else the first alias."""
    keys = [group] if group else []
    canon = F.col("kind") == "canonical"
    order = F.when(canon, F.struct(F.lit(1).alias("c"), F.col("ord").alias("o"))).otherwise(F.struct(F.lit(0).alias("c"), (-F.col("ord")).alias("o")))
    return (
        surfaces.withColumn("key", role_key(F.col("surface"))).withColumn("_o", order)
        .groupBy(*keys, "key").agg(*[F.max_by(c, "_o").alias(c) for c in ("canonical", "family", "kind")])
    )


def role_sets(surfaces: DataFrame) -> DataFrame:
    """role_ord, canonical, family and the tokens of all names of each role."""
    tokens = surfaces.select("role_ord", "canonical", "family", F.explode(role_tokens(F.col("surface"))).alias("token"))
    return tokens.groupBy("role_ord", "canonical", "family").agg(F.collect_set("token").alias("tokens"))


def role_generic(df: DataFrame, title: str, tax: Taxonomy) -> DataFrame:
    """Add ``m_generic``: the title's key is one of the taxonomy's placeholders."""
    spark = df.sparkSession
    keys = local_frame(spark, [(g,) for g in tax.generics], "title string").select(role_key(F.col("title")).alias("_gk"), F.lit(True).alias("_hit")).distinct()
    return once(df, _gk=role_key(F.col(title))).join(sized(keys, len(tax.generics)), "_gk", "left").withColumn(
        "m_generic", F.col("_hit").isNotNull()).drop("_gk", "_hit")


def role_seniority(df: DataFrame, title: str, tax: Taxonomy) -> DataFrame:
    return once(df, seniority=seniority_of(F.col(title), tax.seniority), rest=without_seniority(F.col(title), tax.seniority))


def role_exact(df: DataFrame, title: str, tax: Taxonomy) -> DataFrame:
    """Add ``m_*`` columns from the raw key, else from the key without seniority (strength in thousandths)."""
    spark = df.sparkSession
    surfaces = surface_frame(spark, tax)
    look = sized(taxonomy_lookup(surfaces), len(tax.surfaces()))
    one = look.select(F.col("key").alias("_k1"), F.struct("canonical", "family", "kind").alias("_m1"))
    two = look.select(F.col("key").alias("_k2"), F.struct("canonical", "family", "kind").alias("_m2"))
    df = once(role_seniority(df, title, tax), _k1=role_key(F.col(title)), _k2=role_key(F.col("rest")))
    m = F.coalesce("_m1", "_m2")
    return (
        df.join(one, "_k1", "left").join(two, "_k2", "left").withColumn("_m", m)
        .withColumn("m_canonical", F.col("_m.canonical")).withColumn("m_family", F.col("_m.family")).withColumn("m_kind", F.col("_m.kind"))
        .withColumn("m_strength", F.when(F.col("m_kind") == "canonical", 1000).when(F.col("m_kind") == "alias", 950))
        .drop("_k1", "_k2", "_m1", "_m2", "_m")
    )


def _packed(df: DataFrame, ids: list[str]) -> DataFrame:
    """Carry all other columns as one value, so a row can pass through an explode and come back whole."""
    return df.select(*ids, F.struct(*[c for c in df.columns if c not in ids]).alias("_row"))


def overlap_candidates(probe: DataFrame, ids: list[str], sets: DataFrame, size: int) -> DataFrame:
    """``probe`` (with tokens ``_t``, carried in ``_row``) and, where there is one, a role of ``sets`` that may share enough of them.

    Of n tokens a role must hold m, two or 60 %, so it holds at least one of any n - m + 1. These are taken
    from the rarest on (by the number of roles that hold them), and only they meet the index. ``size`` is the
    counted number of tokens of all roles.
    """
    held = sets.select("role_ord", F.explode("tokens").alias("token"))
    spread = sized(held.groupBy("token").agg(F.count("*").alias("spread")), size)
    n = F.size("_row._t")
    tokens = probe.select("*", F.explode_outer("_row._t").alias("token")).join(spread, "token", "left")
    ordered = tokens.groupBy(*ids).agg(F.first("_row").alias("_row"), F.sort_array(F.collect_list(F.struct(F.coalesce("spread", F.lit(0)).alias("spread"), "token"))).alias("_o"))
    least = F.greatest(F.lit(2), F.ceil(n * 3 / 5)).cast("int")
    front = F.array_distinct(F.transform(F.slice("_o", 1, F.greatest(n - least + 1, F.lit(0))), lambda x: x["token"]))
    met = ordered.select(*ids, "_row", F.explode_outer(front).alias("token")).join(sized(held, size), "token", "left")
    return met.groupBy(*ids, "role_ord").agg(F.first("_row").alias("_row"))


def role_overlap(df: DataFrame, ids: list[str], title: str, tax: Taxonomy, when: Column) -> DataFrame:
    """Titles that share at least two tokens and 60 % of their tokens with a role: best coverage, first role.

    Rows for which ``when`` is false pass through unmatched.
    """
    sets = role_sets(surface_frame(df.sparkSession, tax))
    size = index_size(df.sparkSession, tax)
    probe = once(df, _t=F.when(when, role_tokens(F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col(title)))))
    rows = overlap_candidates(_packed(probe, ids), ids, sets, size).join(sized(sets, size), "role_ord", "left")
    n, shared = F.size("_row._t"), F.size(F.filter("_row._t", lambda t: F.array_contains("tokens", t)))
    fits = F.col("role_ord").isNotNull() & (F.col("shared") >= 2) & (F.col("shared") * 5 >= n * 3)
    # 0.85 x coverage, in thousandths; exact halves go down, as they do in binary floating point
    strength = F.ceil((F.col("shared") * 1700 - n) / (n * 2)).cast("int")
    hit = F.when(fits, F.struct("shared", (-F.col("role_ord")).alias("first"), "canonical", "family", strength.alias("strength")))
    best = rows.withColumn("shared", shared).groupBy(*ids).agg(F.first("_row").alias("_row"), F.max(hit).alias("_o"))
    return best.select(*ids, "_row.*", *[F.col(f"_o.{c}").alias(f"o_{c}") for c in ("canonical", "family", "strength")]).drop("_t")


_SIZES: dict[str, int] = {}


def index_size(spark: SparkSession, tax: Taxonomy) -> int:
    """Tokens of all roles of a taxonomy, counted once."""
    text = tax.to_json()
    if text not in _SIZES:
        if len(_SIZES) >= 64:
            _SIZES.clear()
        _SIZES[text] = role_sets(surface_frame(spark, tax)).agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    return _SIZES[text]


def role_match(df: DataFrame, ids: list[str], title: str, tax: Taxonomy) -> DataFrame:
    """Generic titles match nothing; else an exact key; else token overlap. Null titles pass through."""
    df = role_exact(role_generic(df, title, tax), title, tax)
    live = ~F.col("m_generic") & (F.trim(title) != "")
    out = role_overlap(df, ids, title, tax, live & F.col("m_canonical").isNull())
    use = F.col("o_canonical").isNotNull()
    for name, value in (("canonical", F.col("o_canonical")), ("family", F.col("o_family")), ("kind", F.lit("token_overlap")), ("strength", F.col("o_strength"))):
        out = out.withColumn(f"m_{name}", F.when(live, F.coalesce(F.col(f"m_{name}"), F.when(use, value))))
    return out.withColumn("m_seniority", F.when(F.col("m_canonical").isNotNull(), F.col("seniority"))).drop(
        "o_canonical", "o_family", "o_strength", "seniority", "rest")


def _cut(word: Column) -> Column:
    return F.regexp_replace(word, r"[.,].*$", "")


def anchored(surfaces: DataFrame) -> DataFrame:
    """Forms of three characters and more with ``low`` and ``word``, the one of their words that the fewest forms have."""
    low = surfaces.where(F.length("surface") >= 3).withColumn("low", F.lower("surface"))
    words = low.select("ord", F.explode(F.array_distinct(F.transform(F.filter(F.split("low", " "), lambda w: w != ""), _cut))).alias("word"))
    spread = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = words.join(spread, "word").groupBy("ord").agg(F.min(F.struct("n", "word")).alias("r")).select("ord", "r.word")
    return low.join(rarest, "ord").select("word", "surface", "low", "ord")


def surface_scan(windows: DataFrame, ids: list[str], tax: Taxonomy, text: str = "text") -> DataFrame:
    """Add ``surface``: the longest known form (3+ characters) standing in the text as whole words, also before a dot or comma.

    Words of the text are equi-joined to the rarest word of each form, then the whole form is verified.
    """
    forms = sized(anchored(surface_frame(windows.sparkSession, tax)), len(tax.surfaces()))
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(text), " "), lambda w: w != ""), _cut))
    hay = F.concat(F.lit(" "), F.lower(f"_row.{text}"), F.lit(" "))
    # a row goes on once as itself, and beside it only the forms that stand in it
    each = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_row._w", F.array().cast("array<string>")))
    rows = _packed(once(windows, _w=words), ids).select("*", F.explode(each).alias("word")).join(forms, "word", "left")
    stands = F.lit(False)
    for end in (" ", ".", ","):
        stands = stands | F.contains(hay, F.concat(F.lit(" "), F.col("low"), F.lit(end)))
    own = F.col("word").isNull()
    hit = F.when(~own, F.struct(F.length("surface").alias("n"), (-F.col("ord")).alias("o"), "surface"))
    met = rows.where(own | F.coalesce(stands, F.lit(False))).select(*ids, F.when(own, F.col("_row")).alias("_row"), hit.alias("_h"))
    return met.groupBy(*ids).agg(F.first("_row", ignorenulls=True).alias("_row"), F.max("_h").alias("_h")).select(
        *ids, "_row.*", F.col("_h.surface").alias("surface")).drop("_w")


def taxonomy_status(docs: DataFrame, id_col: str) -> DataFrame:
    """Version, families and roles of each taxonomy document."""
    t = docs.select(id_col, "source", F.from_json("value", TAXONOMY_SCHEMA).alias("t"))
    roles = F.aggregate(F.col("t.families"), F.lit(0), lambda n, f: n + F.size(f["roles"]))
    return t.select(id_col, "source", F.col("t.version").alias("version"), F.size("t.families").alias("families"), roles.alias("roles"))


def taxonomy_valid(t: Column) -> Column:
    """Shape and size limits a custom taxonomy must meet."""
    lim = V.TAXONOMY_LIMITS

    def text(c, k):
        return F.coalesce(F.length(F.trim(c)).between(*lim[k]), F.lit(False))

    def listed(c, k, each, default=False):
        ok = F.size(c).between(*lim[k]) & F.forall(c, each)
        return F.coalesce(ok, F.lit(default))

    role = lambda r: text(r["canonical"], "canonical") & listed(r["aliases"], "aliases", lambda a: text(a, "alias"), True)
    family = lambda f: text(f["family"], "family") & listed(f["roles"], "roles", role)
    return F.coalesce(
        text(t["version"], "version") & listed(t["families"], "families", family)
        & listed(t["seniorityPrefixes"], "seniorityPrefixes", lambda p: text(p, "prefix"), True)
        & listed(t["genericRejects"], "genericRejects", lambda p: text(p, "reject"), True), F.lit(False))


def taxonomy_active(settings: DataFrame, default: Taxonomy) -> DataFrame:
    """Per settings row: the override when it is valid, else the default document."""
    ok = taxonomy_valid(F.from_json("value", TAXONOMY_SCHEMA))
    return settings.withColumn("source", F.when(ok, "override").otherwise("default")).withColumn(
        "value", F.when(ok, F.col("value")).otherwise(F.lit(default.to_json())))


