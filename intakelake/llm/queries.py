"""The registered queries of this subpackage, one for each operator, and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, conversation_repair, fingerprint, html_text, lm, mixing, periodic_runs, quality_cnn, repeated_windows, rules, simhash, toxicity
from .common import LABEL_FOLDS, held_out, labelled_sample, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, labels = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.PER_CLASS, toxicity.MAX_BYTES)
    return toxicity.scored(docs, toxicity.fit([x.decode() for x in texts], labels)).select(
        "doc_id", held_out(F.col("doc_id"), LABEL_FOLDS).alias("held_out"), "score", "predicted", "offending")


#: A conversation of nothing but control strings, formatted with all others.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.examples(given.unionByName(spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string"))))


OP2_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
f AS (
  SELECT *, length(role) + length(text) + 16 + (length(role || '|') - length(replace(role || '|', chr(16), '')))
    + (length(text) - length(replace(text, chr(16), ''))) + (length(text) - length(replace(text, '<|', '<'))) AS size FROM c),
r AS (
  SELECT *, sum((role = 'assistant')::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS replies FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size * greatest(replies, 1))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant')::BIGINT AS n_examples
FROM r GROUP BY conv_id
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality_cnn.PER_CLASS, quality_cnn.MAX_BYTES)
    return quality_cnn.scored(docs, quality_cnn.fit(*sample)).select("doc_id", held_out(F.col("doc_id"), LABEL_FOLDS).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.placed(docs).select("doc_id", "source", *mixing.PLACE)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).drop("n_lines")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (SELECT *, n_lines - n_own_lines AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
m AS (
  SELECT *, 100 * word_chars // greatest(n_words, 1) AS word_length, 10000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
    10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share, 10000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM f),
tall AS (
  SELECT lang, source, measure, x FROM (SELECT * FROM m WHERE NOT base_failed)
  UNPIVOT (x FOR measure IN (word_length, symbol_share, dup_line_share, repeat_share))),
k AS (SELECT *, greatest(length(bin(x)) - 5, 0)::INT AS low FROM tall),
b AS (SELECT lang, source, measure, (x >> low) << low AS bucket FROM k),
levels AS (
  SELECT 0 AS level, lang, source, measure, bucket FROM b UNION ALL SELECT 1, lang, NULL, measure, bucket FROM b
  UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS r, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM levels),
q AS (
  SELECT level, lang, source, measure, max(n) AS n, min(CASE WHEN 100 * r >= 25 * n THEN bucket END) AS q25, min(CASE WHEN 100 * r >= 75 * n THEN bucket END) AS q75
  FROM ranked GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT lang, source FROM f), (VALUES ('word_length', 50), ('symbol_share', 100), ('dup_line_share', 500), ('repeat_share', 500)) AS x(measure, floor)),
pick AS (
  SELECT g.lang, g.source, g.measure, g.floor, q.q25, q.q75 FROM g JOIN q ON g.measure = q.measure AND (q.level = 2
    OR (q.lang IS NOT DISTINCT FROM g.lang AND q.n >= 200 AND (q.level = 1 OR q.source IS NOT DISTINCT FROM g.source)))
  QUALIFY row_number() OVER (PARTITION BY g.lang, g.source, g.measure ORDER BY q.level) = 1),
lim AS (
  SELECT lang, source, max(CASE WHEN measure = 'word_length' THEN q25 - 4 * greatest(q75 - q25, floor) END) AS short,
    max(CASE WHEN measure = 'word_length' THEN q75 + 4 * greatest(q75 - q25, floor) END) AS long,
    max(CASE WHEN measure = 'symbol_share' THEN q75 + 4 * greatest(q75 - q25, floor) END) AS symbols,
    max(CASE WHEN measure = 'dup_line_share' THEN q75 + 4 * greatest(q75 - q25, floor) END) AS lines,
    max(CASE WHEN measure = 'repeat_share' THEN q75 + 4 * greatest(q75 - q25, floor) END) AS repeats
  FROM pick GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_length BETWEEN short AND long AND symbol_share <= symbols AND dup_line_share <= lines AND repeat_share <= repeats, false) AS kept
FROM m LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by crc32 of conversation and turn: dropped, emptied, cut, repeated and renamed rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    audits = written(conversation_repair.audited(rows), "audits")
    read = conversation_repair.digests(conversation_repair.repaired(rows, audits)).withColumnRenamed("conv_id", "c")
    said = audits.drop("audit").join(read, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("conv_id", "id")
    every = given.select("conv_id").distinct().join(said, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) x(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
kinds AS (
  SELECT s, xor(4294967295, list_reduce(list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 20 AS kind
  FROM (SELECT DISTINCT s FROM keyed), tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN kinds USING (s), (VALUES (1), (2)) AS v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt)),
judged AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS k, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
near AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY i) || k AS pair FROM judged),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM near GROUP BY conv_id),
moves(a, role, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(a, b, c, s) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
acts AS (
  SELECT DISTINCT k, fault, a, a AS b, 3 AS c, 'D' AS s FROM judged, (VALUES (0), (1), (2), (3)) AS v(a)
  UNION ALL SELECT DISTINCT k, fault, a, b, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K' FROM judged JOIN moves ON judged.role[1] = moves.role WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT DISTINCT k, fault, a, b, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R' FROM judged, moves WHERE moves.role <> 's' AND (fault IS NULL OR fault = 'truncated')),
steps AS (SELECT k, fault, ins.a, acts.b, ins.c + acts.c AS c, ins.s || acts.s AS s FROM ins JOIN acts ON ins.b = acts.a),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS b, {'c': 0, 's': ''} AS w FROM stats
  UNION ALL SELECT ways.conv_id, judged.i, steps.b, min({'c': w.c + steps.c, 's': w.s || steps.s}) FROM ways JOIN judged ON judged.conv_id = ways.conv_id AND judged.i = ways.i + 1
    JOIN steps ON steps.k = judged.k AND steps.fault IS NOT DISTINCT FROM judged.fault AND steps.a = ways.b GROUP BY ways.conv_id, judged.i, steps.b),
best AS (
  SELECT stats.conv_id, min({'c': w.c + ins.c, 's': w.s || ins.s}) AS w FROM stats JOIN ways ON ways.conv_id = stats.conv_id AND ways.i = stats.n JOIN ins ON ins.a = ways.b WHERE ins.b IN (0, 3) GROUP BY 1),
edits AS (SELECT conv_id, pos, w.s[pos] AS edit FROM (SELECT *, unnest(range(1, length(w.s) + 1)) AS pos FROM best)),
counted AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM edits),
said AS (
  SELECT c.conv_id, pos, o, edit, j.role, CASE WHEN edit = 'I' THEN '' ELSE j.text END AS text, max(CASE WHEN o = 1 AND edit = 'K' AND j.k = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS s
  FROM counted c LEFT JOIN judged j ON j.conv_id = c.conv_id AND j.i = c.i WHERE edit <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS t FROM said GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.w.c, 0)::BIGINT AS cost, coalesce(best.w.s, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN stats USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN told USING (conv_id)
"""


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_windows.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM pos),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
near AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again),
cut AS (
  SELECT r, i, coalesce(before + 35, 1) AS a, i - 1 AS b, least(35, i - coalesce(before, i - 35)) AS gone FROM near
  UNION ALL SELECT r, max(i) + 1, max(i) + 35, 2147483647, 0 FROM again GROUP BY r),
left_over AS (SELECT cut.r, sum(gone)::BIGINT AS n, array_to_string(flatten(list(CASE WHEN a <= b THEN w[a:b] ELSE [] END ORDER BY i)), ' ') AS kept FROM cut JOIN d USING (r) GROUP BY cut.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic end for the documents that crc32(doc_id as text) picks; a null id picks none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("picked"), F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    # a text without words is never changed, but its numbers are worked out all the same
    rows = rows.withColumn("a", F.col("g") % F.greatest("n", F.lit(1))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("picked") & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.collapsed(planted_runs(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    said = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "collapsed", F.array_join(said, "").alias("said"), first.alias("top")).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.col1")).alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * -top.col1 div top.period").alias("exponent_milli"), F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_chat": op2_chat, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_mixing": op5_mixing, "op6_html": op6_html, "op7_lm": op7_lm, "op8_rules": op8_rules, "op9_fingerprints": op9_fingerprints, "op10_simhash": op10_simhash,
           "op11_repair": op11_repair, "op12_windows": op12_windows, "op13_runs": op13_runs}
ORACLE: dict[str, str] = {"op2_chat": OP2_SQL, "op8_rules": OP8_SQL, "op11_repair": OP11_SQL, "op12_windows": OP12_SQL}
