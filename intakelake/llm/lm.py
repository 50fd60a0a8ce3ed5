"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from all training texts. Of a pair's count c the filter holds
the key at levels 1 .. 1 + floor(log2 c); probing level after level until one is missing gives c up to a
factor of two, with one-sided error. The filter is broadcast. With v the token before w,

    p(w | v) = (pair(v, w) + KAPPA * base(w)) / (count(v) + KAPPA)

where ``pair`` is the lower end of the pair's level and ``count`` the upper end of the context's, so
that the probabilities of a context do not add up to more than one but for false positives, and
``base(w) = (c + 0.1) / (N + 0.1 * (V + 1))`` is exact.

What is broadcast is bounded: the filter by MAX_BYTES, the exact counts of frequent words by HEAD words.
What has no room there is not lost: counts of all other words meet the texts' rare words in a join, and
pairs below the least level held meet the texts' pairs that the filter lacks in another. So a score is the
same whatever the filter has room for, but for its false positives. Words are not in the filter: a text's
contexts are the words it has anyway. Shuffled are 64-bit hashes of words and pairs, not their strings.

Defined cases: a null text is empty; an empty text has one token, its end; a row without doc_id is a
training row; repeated rows each count and are each scored; with no training rows N and V are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import CORPUS_FOLDS, arrow_pass, held_out, plus, utf8, written
from .rules import bucket

KAPPA = 1000.0
MAX_BYTES, BITS, SHARDS = 64 << 20, 12, 64
HEAD = 500_000
#: Keys a task sums up before it passes them on.
GATHER = 2_000_000
END = b" "  # no word holds a space
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different tokens of the texts, the texts' tokens as positions there with an end before the first
    and after each, and each text's number of tokens."""
    known: dict[bytes, int] = {END: 0}
    parts, sizes = [np.zeros(1, np.int32)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # A-Z; at 0x20 and 0x09-0x0D
        sizes[i] = len(words) + 1
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    return list(known), np.concatenate(parts), sizes


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + word)


class LogBloom:
    """The filter: SHARDS parts of ``size`` words; a key at a level sets six bits of one word of the key's part.

    Keys of fewer than ``least`` levels are not in it.
    """

    def __init__(self, words: np.ndarray, size: int, least: int = 1):
        self.words, self.size, self.least = words, size, least

    @staticmethod
    def place(key: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(key ^ U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        at, y, mask = x % U(size), mix(x), np.zeros(len(key), np.uint64)
        for k in range(6):
            mask |= U(1) << (y >> U(6 * k) & U(63))
        return at.astype(np.int64), mask

    @classmethod
    def part(cls, key: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
        """The words of one part that holds these keys at levels 1 .. ``levels``."""
        words = np.zeros(size, np.uint64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            at, mask = cls.place(key[levels >= level], level, size)
            np.bitwise_or.at(words, at, mask)
        return words

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Levels found before the first that is missing."""
        found, live = np.zeros(len(key), np.int64), np.arange(len(key))
        shard = ((key >> U(32)) % U(SHARDS)).astype(np.int64) * self.size
        level = 0
        while len(live) and level < 63:
            level += 1
            at, mask = self.place(key[live], level, self.size)
            live = live[(self.words[shard[live] + at] & mask) == mask]
            found[live] = level
        return found


def counts(docs: DataFrame) -> DataFrame:
    """pair (boolean), key, n over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}

        def drain(pair: bool) -> Iterator[pa.RecordBatch]:
            keys, n = (np.concatenate(x) for x in zip(*held[pair]))
            keys, back = np.unique(keys, return_inverse=True)
            total = np.bincount(back, n, len(keys)).astype(np.int64)
            held[pair].clear()
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), pair)), pa.array(keys[part].view(np.int64)), pa.array(total[part])], ["pair", "key", "n"])

        for b in batches:
            words, flat, _ = tokens(utf8(b.column("text")))
            keys = word_keys(words)
            held[False].append((keys, np.bincount(flat[1:], minlength=len(words))))
            two, n = np.unique(flat[:-1].astype(np.int64) * len(words) + flat[1:], return_counts=True)
            held[True].append((pair_keys(keys[two // len(words)], keys[two % len(words)]), n))
            for pair, x in held.items():
                if sum(len(k) for k, _ in x) >= GATHER:
                    yield from drain(pair)
        for pair, x in held.items():
            if x:
                yield from drain(pair)

    texts = docs.where(~held_out(F.col("doc_id"), CORPUS_FOLDS)).select("text")
    summed = arrow_pass(texts, run, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    return summed.where("n > 0")


def bloom(counted: DataFrame) -> LogBloom:
    """The filter over the counted pairs of the most levels, as many as MAX_BYTES has room for."""
    counted = counted.where("pair")
    level = F.length(F.bin("n"))
    held = {r.level: r["count"] for r in counted.groupBy(level.alias("level")).count().collect()}
    room, least = MAX_BYTES * 8 // BITS, 1
    while (need := sum(n * lv for lv, n in held.items() if lv >= least)) > room:
        least += 1
    size = max(1, -(-need * BITS // (64 * SHARDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            shard, key, lv = (b.column(i).to_numpy() for i in range(3))
            for s in np.unique(shard).tolist():
                pick = shard == s
                own = LogBloom.part(key[pick].view(np.uint64), lv[pick], size)
                parts[s] = own | parts[s] if s in parts else own
        for s, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["shard", "words"])

    shard = F.pmod(F.shiftrightunsigned("key", 32), F.lit(SHARDS)).cast("int")
    rows = counted.where(level >= least).select(shard.alias("shard"), "key", level.cast("long").alias("level"))
    counted.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    words = np.zeros(SHARDS * size, np.uint64)
    for r in rows.repartition(SHARDS, "shard").mapInArrow(run, "shard int, words binary").toLocalIterator():
        words[r.shard * size : (r.shard + 1) * size] = np.frombuffer(r.words, np.uint64)
    return LogBloom(words, size, least)


def head(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Keys and counts of the most frequent words, at most HEAD of them; the least count there; N and V."""
    words = counted.where("not pair")
    sizes = words.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("bucket")).collect()
    least, v = 2**62, 0
    for r in sizes:
        if (v := v + r.v) > HEAD:
            break
        least = r.bucket
    top = words.where(F.col("n") >= least).select("key", "n").toArrow()
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order], least, sum(r.n for r in sizes), sum(r.v for r in sizes)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    docs = docs.select("doc_id", "text")
    counted = written(counts(docs), "ngrams")
    top_key, top_n, least, total, distinct = head(counted)
    model = bloom(counted)
    shared = docs.sparkSession.sparkContext.broadcast((top_key, top_n, model.words, model.size))
    mass, held = total + 0.1 * (distinct + 1), model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_top, n_top, words_top, size = shared.value
        probe = LogBloom(words_top, size).levels
        for b in batches:
            words, flat, sizes = tokens(utf8(b.column("text")))
            keys = word_keys(words)
            at = np.minimum(np.searchsorted(keys_top, keys), max(len(keys_top) - 1, 0))
            top = keys_top[at] == keys if len(keys_top) else np.zeros(len(keys), bool)
            c = np.where(top, n_top[at] if len(n_top) else 0, 0)
            base = (c + 0.1) / mass
            below = np.exp2(np.frexp(c.astype(float))[1]) - 1 + KAPPA  # with the upper end of the level
            word, before = flat[1:], flat[:-1]
            two, back = np.unique(before.astype(np.int64) * len(words) + word, return_inverse=True)
            pairs = pair_keys(keys[two // len(words)], keys[two % len(words)])
            level = probe(pairs)
            second = two % len(words)
            rare, left = ~top[second], (level < held) & (held > 1)  # what is held has that many levels; if all is, the rest is unseen
            pair = np.where((level > 0) & ~left, np.exp2(level - 1.0), 0.0)
            begin = np.r_[0, np.cumsum(sizes)]
            add = lambda x: np.add.reduceat(x, begin[:-1])
            over_words = lambda x: add(np.where(top, x, 0)[word])  # noqa: E731  a text's contexts are its words in another order
            score = add(np.where(rare | left, 0.0, np.log10(pair + KAPPA * base[second]))[back]) - over_words(np.log10(below))
            # each text's other pairs, and how often it has them
            some = np.flatnonzero((rare | left)[back])
            found, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[some] * len(two) + back[some], return_counts=True)
            text, found = found // len(two), found % len(two)
            # a training text's pair is counted at least as often as the text has it, and has no more than held - 1 levels
            sure = left[found] & ~b.column("held_out").to_numpy(zero_copy_only=False)[text] & (np.frexp(times.astype(float))[1] >= held - 1)
            pair, open_, of_rare = np.where(sure, np.exp2(held - 2.0), pair[found]), left[found] & ~sure, rare[found]
            score += np.bincount(text, np.where(open_ | of_rare, 0.0, times * np.log10(pair + KAPPA * base[second[found]])), len(sizes))
            word_key = np.where(of_rare, keys[second[found]].view(np.int64), 0)

            def lists(pick: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
                ends = pa.array(np.searchsorted(text[pick], np.arange(len(sizes) + 1)).astype(np.int32))
                return [pa.ListArray.from_arrays(ends, pa.array(x[pick])) for x in columns]

            yield pa.RecordBatch.from_arrays([
                *b.columns[:-1], pa.array(sizes), pa.array(over_words((c > 0).astype(np.int64))), pa.array(over_words(np.log10(base))), pa.array(score),
                *lists(of_rare & ~open_, word_key, pair, times), *lists(open_, pairs.view(np.int64)[found], word_key, np.where(of_rare, -1, c[second[found]]), times)], names)

    source = docs.select("doc_id", held_out(F.col("doc_id"), CORPUS_FOLDS).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    schema = plus(
        source.drop("text"), n_tokens="long", n_known="long", base_score="double", score="double", word="array<long>", pair="array<double>", times="array<long>",
        left_pair="array<long>", left_word="array<long>", left_n="array<long>", left_times="array<long>")
    names = schema.names
    each = written(arrow_pass(source, run, schema), "scores")
    # the rare words' counts; n is -1 where the word is rare
    fewer = counted.where(F.expr("not pair") & (F.col("n") < least)).select(F.col("key").alias("word"), F.col("n").alias("found"))
    counted_words = lambda df: df.join(fewer, "word", "left").withColumn("n", F.coalesce("found", F.lit(0))).withColumn("rare", F.lit(True)).drop("found", "word")
    near = counted_words(each.select("row", F.inline(F.arrays_zip("word", "pair", "times"))))
    left = each.select("row", F.inline(F.arrays_zip("left_pair", "left_word", "left_n", "left_times")).alias("key", "word", "n", "times"))
    open_ = left.where("n >= 0").drop("word").withColumn("rare", F.lit(False)).unionByName(counted_words(left.where("n < 0").drop("n")))
    # the counts of pairs that had no room in the filter, at the lower end of their level as there
    others = counted.where(F.col("pair") & (F.col("n") < 1 << min(model.least - 1, 62))).select("key", F.pow(F.lit(2.0), F.length(F.bin("n")) - 1).alias("pair"))
    met = near.unionByName(open_.join(others, "key", "left").drop("key").withColumn("pair", F.coalesce("pair", F.lit(0.0))))
    base = (F.col("n") + 0.1) / mass
    below = F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.length(F.bin("n"))) - 1).otherwise(0) + KAPPA
    only = lambda x: F.sum(F.when(F.col("rare"), F.col("times") * x).otherwise(0))  # noqa: E731  other words have theirs already
    more = met.groupBy("row").agg(
        only((F.col("n") > 0).cast("long")).alias("more_known"), only(F.log10(base)).alias("more_base"),
        (F.sum(F.col("times") * F.log10(F.col("pair") + KAPPA * base)) - only(F.log10(below))).alias("more_score"))
    plus_ = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return each.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus_("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus_("base_score", "more_base"), plus_("score", "more_score"))
