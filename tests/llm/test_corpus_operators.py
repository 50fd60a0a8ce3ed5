"""Operators on whole tables: near-duplicates, language model, mixing, classifiers, the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from intakelake.llm import common, lm, mixing, quality_cnn, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, mark long, n long, row int, block int, _kept_id int"
EDGE = [(1, None, "a"), (2, "", "a"), (9, "one two three four five", None), (9, "one two three four five", None), (4, "Ab cé 12 " * 20_000, "b"), (None, "one two three four five", "a"), (None, None, None), (5, "tok", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5) for i, t, s in EDGE], DOCS)


def linked_by_hand(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= simhash.BUDGET:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("split_over", [200_000, 3])
def test_tries_link_what_three_bits_link(spark, split_over):
    rng = random.Random(5)
    values = {0, 1, 2**63, 2**64 - 1}
    for base in [rng.getrandbits(64) for _ in range(60)] + [7 << 48 | rng.getrandbits(48) for _ in range(60)]:
        for _ in range(5):
            values.add(base ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))))
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "mark long")
    groups = defaultdict(set)
    for mark, root in simhash.connect(simhash.links(df, split_over)).collect():
        groups[root] |= {mark, root}
    assert {frozenset(x % 2**64 for x in g) for g in groups.values()} == linked_by_hand(values)


def test_dense_group_goes_through_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(1)
    value = np.unique(rng.integers(0, 2**9, 300).astype(np.uint64) | np.uint64(2**40))
    label = simhash.join_tries(np.zeros(len(value), int), value, 48, 3)
    assert (label == 0).all()


def test_simhash_by_hand():
    words = "A b c d b c d".split()
    grams = [" ".join(words[i : i + 3]).lower().encode() for i in range(5)]
    import xxhash

    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    assert simhash.simhash(" A\tb c d\nb c  d ".encode()) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > 5)
    assert simhash.simhash(b"") == 0 and simhash.simhash(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_of_documents(spark, edge):
    rows = queries.op10_simhash(spark, LARGER).collect()
    mark = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    by = defaultdict(list)
    for i, v in mark.items():
        by[v].append(i)
    want = {i: min(by[v]) for i, v in mark.items()}
    for g in linked_by_hand(sorted(by)):
        least = min(min(by[v]) for v in g)
        want |= {i: least for v in g for i in by[v]}
    assert {r.doc_id: r.component_id for r in rows} == want and len(set(want.values())) < len(want)
    got = Counter((r.doc_id, r.component_id) for r in simhash.components(edge).collect())
    assert got == Counter([(1, 1), (2, 1), (9, 9), (9, 9), (4, 4), (None, 9), (None, 1), (5, 5)])
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 9, 4, 5])
    assert simhash.components(edge.limit(0)).count() == simhash.one_of_each(edge.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("wind and rain on the old road to the hill farm at night", "seven blue boxes stand beside a door nobody opens any more today", "quite another text that none of these is like in any way at all")
    rows = [(7, a), (7, b), (7, b), (8, a), (None, b), (None, c), (None, c), (5, None), (6, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5) for i, t in rows], DOCS).repartition(3)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, a), (7, b), (None, c), (5, None)])


def test_sample_looks_for_rows_that_fit(spark):
    texts = [(i, "long " * 10_000 if i % 10 else f"short {i}") for i in range(600)] + [(0, f"again {k}") for k in range(50)] + [(10, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(700)] + [(0, 1)] * 5, "doc_id long, toxic int")
    learnt = [i for i in range(0, 600, 10) if zlib.crc32(str(i).encode()) % 5]
    got, y = common.labelled_sample(docs, labels, "toxic", {0: 9, 1: 1000}, 1000)
    assert y.count(0) == 9 and y.count(1) == sum(i % 20 == 0 for i in learnt)
    assert len(set(got)) == len(got) and all(len(x) < 1000 for x in got)


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_pipeline_on_edges(spark, rows, tmp_path):
    good = "The house by the lake was sold last year, and since then nobody has seen the old owner in town. " * 6
    docs = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in EDGE] + [(20 + k, good + f"Number {k}.", None, None, None) for k in range(3)] + [(None, good, "en", "a", 3), (30, good, "en", "a", 3), (30, good, "en", "a", 3)]
    frame = spark.createDataFrame(docs if rows == "edge" else [], "doc_id long, text string, lang string, source string, n_chars long")
    frame.withColumn("mix_file", F.lit(1)).withColumn("ids", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (30, 1), (None, 1), (20, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len({r.doc_id for r in out}) and all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id for r in out} <= {d[0] for d in docs} and (rows == "edge" or not out)


def base_by_hand(docs):
    tokens = {k: [w.decode() for w in (t or "").encode().lower().split()] + [" "] for k, (_, t) in enumerate(docs)}
    seen = Counter()
    for k, (i, _) in enumerate(docs):
        if i is None or zlib.crc32(str(i).encode()) % 10:
            seen.update(tokens[k])
    n, mass = sum(seen.values()), sum(seen.values()) + 0.1 * (len(seen) + 1)
    for k, (i, _) in enumerate(docs):
        yield str(i), len(tokens[k]), sum(w in seen for w in tokens[k]), n, round(sum(math.log10((seen[w] + 0.1) / mass) for w in tokens[k]), 5)


@pytest.mark.parametrize("head", [500_000, 50])
def test_language_model(spark, edge, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), edge):
        docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        rows = lm.scored(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == sorted(base_by_hand(docs))
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.scored(edge.limit(0)).count() == 0


def test_language_model_learns(spark):
    rows = queries.op7_lm(spark, LARGER).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert rows.score > rows.base


def test_bloom_levels():
    rng = np.random.default_rng(3)
    key, level = rng.integers(0, 2**63, 4000, dtype=np.uint64), rng.integers(1, 12, 4000)
    size = -(-int(level.sum()) * lm.BITS // (64 * lm.SHARDS))
    shard = (key >> np.uint64(32)) % np.uint64(lm.SHARDS)
    words = np.concatenate([lm.LogBloom.part(key[shard == s], level[shard == s], size) for s in range(lm.SHARDS)])
    model = lm.LogBloom(words, size)
    assert (model.levels(key) >= level).all() and (model.levels(key) == level).mean() > 0.97
    assert (model.levels(rng.integers(0, 2**63, 4000, dtype=np.uint64)) == 0).mean() > 0.97


def test_filter_keeps_its_bound(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_BYTES", 4096)
    counted = spark.range(5000).select(F.lit(True).alias("pair"), F.xxhash64("id").alias("key"), F.when(F.col("id") < 100, 100).otherwise(2).cast("long").alias("n"))
    model = lm.bloom(counted)
    assert model.words.nbytes <= 4096 + 8 * lm.SHARDS
    often = np.array([r.key for r in counted.where("n = 100").collect()], np.int64).view(np.uint64)
    assert (model.levels(often) >= 7).all()


def score_by_hand(docs):
    """The scores in row order, with each pair's and context's count as the filter would tell it without false positives."""
    words = [[b" "] + (t or "").encode().lower().split() + [b" "] for _, t in docs]
    train = [w for (i, _), w in zip(docs, words) if i is None or zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(x for w in train for x in w[1:]), Counter(x for w in train for x in zip(w, w[1:]))
    mass = sum(one.values()) + 0.1 * (len(one) + 1)
    pair = lambda x: 1 << two[x].bit_length() - 1 if two[x] else 0
    p = lambda v, w: (pair((v, w)) + lm.KAPPA * (one[w] + 0.1) / mass) / ((1 << one[v].bit_length()) - 1 + lm.KAPPA)
    return [sum(math.log10(p(v, w)) for v, w in zip(ws, ws[1:])) for ws in words]


@pytest.mark.parametrize(("head", "room"), [(500_000, 0), (50, 0), (50, 4096)])
def test_pairs_without_room_in_the_filter_are_scored(spark, head, room, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "MAX_BYTES", room)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionAll(docs)  # no pair is seen once
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.score for r in lm.scored(docs).collect()}
    want = dict(zip((i for i, _ in rows), score_by_hand(rows)))
    assert got.keys() == want.keys()
    if room:  # false positives only raise a pair
        assert all(got[i] >= want[i] - 1e-5 for i in want) and sum(got.values()) - sum(want.values()) < 0.1 * abs(sum(want.values()))
    else:
        assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_pairs_seen_once_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_BYTES", 0)  # all from the join, without false positives
    rows = [(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, None)]
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(abs(got[i] - x) < 1e-9 for (i, _), x in zip(rows, score_by_hand(rows)))
    monkeypatch.undo()
    model = lm.bloom(lm.counts(spark.createDataFrame(rows, "doc_id long, text string")))
    alpha, beta, gamma = lm.word_keys([b"alpha", b"beta", b"gamma"])
    assert model.levels(lm.pair_keys(np.array([alpha, beta]), np.array([beta, gamma]))).tolist() == [2, 1]


def test_schedules_meet_their_windows():
    rng = random.Random(2)
    for _ in range(60):
        parts = {i: rng.randrange(1, 40) for i in range(rng.randrange(1, 12))}
        period, got = sum(parts.values()), Counter()
        for slot, s, k in mixing.schedule(parts):
            assert k * period // parts[s] <= slot < -(-(k + 1) * period // parts[s])
            got[s] += 1
            assert all(abs(got[i] - Fraction(p * (slot + 1), period)) < 1 for i, p in parts.items())


def walked(parts, blocks):
    """(source, block) by slot, one slot after another."""
    left, begun, out = list(blocks), [0] * len(blocks), []
    while any(left):
        live = {i: parts[i] for i in range(len(parts)) if left[i]}
        had, over = Counter(), False
        while not over:
            whole = dict(had)
            for _, s, _ in mixing.schedule(live):
                out.append((s, begun[s] + had[s]))
                had[s] += 1
                if had[s] == left[s]:
                    over = True
                    break
            assert over or all(had[i] - whole.get(i, 0) == p for i, p in live.items())
        for i, n in had.items():
            left[i] -= n
            begun[i] += n
    return out


@pytest.mark.parametrize("pieces", [20_000, 7])
def test_mixture(spark, edge, pieces, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", pieces)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.placed(docs, block=5000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.release <= r.slot < r.due for r in rows)
    sizes, last, run = Counter(), defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.source, r.before)):
        assert r.before == run[r.source] and r.block == r.before // 5000
        run[r.source] += len(r.row.text)
        sizes[r.source] += len(r.row.text)
        last[r.source] = max(last[r.source], r.block)
    names = sorted(sizes)
    want = {(names[s], k): slot for slot, (s, k) in enumerate(walked(mixing.parts_of([sizes[s] for s in names]), [last[s] + 1 for s in names]))}
    assert all(r.slot == want[r.source, r.block] for r in rows)
    ordered = mixing.in_order(edge, block=10)
    assert ordered.columns == edge.columns and Counter(r.doc_id for r in ordered.collect()) == Counter(i for i, *_ in EDGE)
    assert mixing.in_order(edge.limit(0)).count() == 0
    given = mixing.placed(edge, weights={"a": 3.0, None: 1.0}, block=10).collect()
    assert len(given) == len(EDGE) and all(r.release <= r.slot < r.due for r in given)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_mixture_moves_texts_twice_at_any_size(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        plan = mixing.in_order(docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved = [x for x in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", x) and re.search(r"Input \[\d+\]: \[.*row#", x)]
    assert len(moved) == 2 and (threshold != "-1" or "SortMergeJoin" in plan)


def test_mixture_of_many_sources(spark):
    docs = spark.range(5_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5_000).alias("source"), F.repeat(F.lit("x"), 1 + (F.col("id") % 7).cast("int")).alias("text"))
    rows = mixing.placed(docs, block=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5_500)) and all(r.release <= r.slot < r.due for r in rows)
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.slot].add(r.block)
    assert all(len(b) == 1 for b in blocks.values())
    docs, names = mixing.lanes(docs, F.length("text"))
    assert len(names) == mixing.MAX_SOURCES and docs.select("lane").distinct().count() == mixing.MAX_SOURCES
    assert docs.groupBy("source").agg(F.countDistinct("lane").alias("n")).where("n > 1").count() == 0


def accuracy(spark, query, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("want"))
    rows = query(spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r.want for r in rows) / len(rows)


def test_classifiers_on_held_out_labels(spark):
    assert accuracy(spark, queries.op1_toxicity, "toxic") >= 0.93
    assert accuracy(spark, queries.op3_quality, "quality") >= 0.95


def test_toxicity_locates_sentences():
    words = "apple stone river cloud table chair paper glass bread water horse tiger eagle whale shark plant grass flower forest desert".split()
    weights = toxicity.fit([t for w in words for t in (f"Good day. You vile {w}! Bye.", f"Good day. You {w}. Bye now.")], [1, 0] * 20)
    score, found = toxicity.judge("All is well. So vile\nBye.", toxicity.WordScores(weights))
    assert score >= 0.5 and ["All is well. So vile\nBye."[x["start"] : x["end"]].strip() for x in found] == ["So vile"]
    assert toxicity.fit(["a"], [1]) == {} and toxicity.judge("", toxicity.WordScores({}))[0] == 0
    assert toxicity.judge("Fine words. " * 20_000, toxicity.WordScores(weights))[0] < 0.9


def test_quiet_sentences_do_not_add_up(spark):
    weights = {toxicity.features("vile")[0]: 30.0, toxicity.features("poor")[0]: 0.1}
    texts = [(1, "Fine words. " * 20_000), (2, "Poor words. " * 20_000), (3, "Fine words. " * 20_000 + "So vile!")]
    rows = toxicity.scored(spark.createDataFrame(texts, "doc_id long, text string"), weights).orderBy("doc_id").collect()
    assert [(r.predicted, len(r.offending)) for r in rows] == [(0, 0), (0, 0), (1, 1)] and rows[0].score < 0.001


def test_network_gives_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 300, 40_000)]
    net = quality_cnn.fit([t for t in texts[1:] for _ in range(4)], [0, 1] * 12)
    whole = net.score(texts)
    alone = np.concatenate([net.score([t]) for t in texts])
    monkeypatch.setattr(quality_cnn, "PIECE", 1 << 12)
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, net.score(texts), atol=1e-5)
    one_class = quality_cnn.fit([b"a"], [1])
    assert np.allclose(one_class.score([b"", b"x"]), 0.99)


def test_gradients_by_difference():
    net = quality_cnn.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(5)
    net.p["dense"] += rng.normal(0, 0.5, net.p["dense"].shape)
    texts, y = [bytes(rng.integers(60, 90, n).astype(np.uint8)) for n in (90, 400)], np.array([0.0, 1.0])
    loss = lambda: -float(np.mean(np.log(np.where(y == 1, p := net.score(texts), 1 - p))))
    g = net.gradients(texts, y)
    for k, at in (("dense", 3), ("rest", 0), ("bias", 2), ("filter", (1, 2, 3)), ("vector", (70, 1))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at]), k


def test_classifiers_on_edges(spark, edge):
    for scored in (toxicity.scored(edge, {}), quality_cnn.scored(edge, quality_cnn.Net())):
        assert Counter(r.doc_id for r in scored.collect()) == Counter(i for i, *_ in EDGE)
    assert toxicity.scored(edge.limit(0), {}).count() == quality_cnn.scored(edge.limit(0), quality_cnn.Net()).count() == 0
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    texts, y = common.labelled_sample(edge, labels, "toxic", toxicity.PER_CLASS, toxicity.MAX_BYTES)
    assert len(texts) == len(y) <= 2
    assert common.labelled_sample(edge.limit(0), labels, "toxic", toxicity.PER_CLASS, toxicity.MAX_BYTES) == ([], [])


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    held, good = [], {r.doc_id for r in spark.read.parquet(f"{LARGER}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, LARGER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held.append([r.doc_id for r in docs.select("doc_id").collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    first, second, third, fourth, last = held
    everything = {r.doc_id for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id").collect()}
    assert set(first) < everything and len(good - set(first)) <= 0.02 * len(good)
    assert set(second) < set(first) and set(third) < set(second)
    assert sorted(third) == sorted(fourth) == sorted(last)
    groups = {r.doc_id: r.component_id for r in simhash.components(spark.read.parquet(f"{tmp_path}/1")).collect()}
    assert sorted(third) == sorted(set(groups.values()))
    order = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/4").orderBy("mix_file", "mix_row").collect()]
    mixed = mixing.placed(spark.read.parquet(f"{tmp_path}/2")).orderBy("slot", "before", "doc_id").collect()
    assert order == [r.doc_id for r in mixed]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
