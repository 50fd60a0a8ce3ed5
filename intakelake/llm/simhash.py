"""SimHash fingerprints and their near-duplicate groups by a self-join of binary tries.

All fingerprints within three bits of each other are linked. Of four 16-bit blocks of two such
fingerprints at least one is equal, so every fingerprint goes to four tries, one for each block
rotated to the front; below that block a trie is joined with itself: pairs of nodes descend
together, differing bits add up, and a pair over the budget is dropped with all below it.
A node of a trie is a range of its sorted fingerprints, so thousands of tries descend at once in
arrays. A task gives a star for each group it finds, never all pairs of a group, and leaves out
node pairs that lie in one group already.

Defined cases: a null text counts as empty; an empty text has fingerprint zero, which links like
any other; repeated rows each get the id of their group; a row without doc_id gets the smallest id
of its group too, null if no row there has one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, fresh, plus, utf8, written

SHINGLE_WORDS, SEED, BUDGET, BLOCK = 3, 42, 3, 16
#: Fingerprints in one trie above which its pairs of child nodes become work of their own.
SPLIT_OVER = 200_000
#: Bits by which such a trie is cut.
CUT = 5
#: Fingerprints joined at a time in a task, and node pairs held at a time.
CHUNK, FRONTIER = 200_000, 400_000


def simhash(text: bytes) -> int:
    words = text.lower().split()  # A-Z only; splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return xxh(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - SHINGLE_WORDS], ends[SHINGLE_WORDS - 1 :]
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = [xxh(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    """doc_id, further columns to carry, and the 64-bit fingerprint as a long."""
    docs = docs.select("doc_id", *carry, "text")
    schema = plus(docs.drop("text"), mark="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.array([simhash(x) for x in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.int64())], schema.names)

    return arrow_pass(docs, run, schema)


def groups_of(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links (a, b), starting from ``label``."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def join_tries(trie: np.ndarray, value: np.ndarray, depth: int, budget: int, cross: np.ndarray | None = None) -> np.ndarray:
    """Group of each value: the smallest index linked to it. Rows are sorted by (trie, side, value) and distinct.

    ``depth`` bits of each value below its trie's common prefix remain. Where ``cross`` is given, it
    holds for each row the side (0 or 1) it is on, and only links between sides count; for each trie
    with two sides the bits above ``depth`` that differ are counted against the budget first.
    """
    n = len(value)
    label = np.arange(n)
    if n < 2:
        return label
    side = np.zeros(n, np.int8) if cross is None else cross
    new = np.flatnonzero((trie[1:] != trie[:-1]) | (side[1:] != side[:-1])) + 1
    lo, hi = np.r_[0, new], np.r_[new, n]
    if cross is None:
        first = (lo, hi, lo, hi, np.zeros(len(lo), np.int8))
    else:  # a trie's sides follow each other
        at = np.flatnonzero((trie[lo[1:]] == trie[lo[:-1]]))
        top = np.bitwise_count((value[lo[at]] ^ value[lo[at + 1]]) >> np.uint64(depth)).astype(np.int8)
        ok = top <= budget
        at, top = at[ok], top[ok]
        first = (lo[at], hi[at], lo[at + 1], hi[at + 1], top)
    stack, pending, ones_at = [(depth, first)], [], {}
    while stack:
        bit, (alo, ahi, blo, bhi, err) = stack.pop()
        same = alo == blo
        one = (ahi - alo == 1) & (bhi - blo == 1)
        leaf = one & ~same
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(value[a] ^ value[b]) <= budget
            pending.append((a[near], b[near]))
        live = ~one
        if sum(len(a) for a, _ in pending) > 4 * FRONTIER or (len(alo) > FRONTIER // 4 and pending):
            label, pending = groups_of(n, np.concatenate([a for a, _ in pending]), np.concatenate([b for _, b in pending]), label), []
        if len(alo) > FRONTIER // 4:  # node pairs within one group cannot change it
            turns = np.cumsum(np.r_[0, label[1:] != label[:-1]])
            live &= ~((turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (label[alo] == label[blo]))
        alo, ahi, blo, bhi, err, same = (x[live] for x in (alo, ahi, blo, bhi, err, same))
        if not len(alo) or not bit:
            continue
        if len(alo) > FRONTIER:
            for half in (slice(len(alo) // 2, None), slice(len(alo) // 2)):
                stack.append((bit, tuple(x[half] for x in (alo, ahi, blo, bhi, err))))
            continue
        bit -= 1
        if bit not in ones_at:
            ones_at[bit] = np.r_[0, np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]
        ones = ones_at[bit]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        steps = [(alo, amid, blo, bmid, err, None), (amid, ahi, bmid, bhi, err, None), (alo, amid, bmid, bhi, err + 1, None), (amid, ahi, blo, bmid, err + 1, ~same)]
        parts = []
        for *x, keep in steps:
            ok = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget)
            parts.append([y[ok if keep is None else ok & keep] for y in x])
        stack.append((bit, tuple(np.concatenate([p[i] for p in parts]) for i in range(5))))
    if pending:
        label = groups_of(n, np.concatenate([a for a, _ in pending]), np.concatenate([b for _, b in pending]), label)
    return label


def _rotated(mark, r: int):
    return mark if r == 0 else F.shiftleft(mark, BLOCK * r).bitwiseOR(F.shiftrightunsigned(mark, 64 - BLOCK * r))


def links(marks: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Stars (mark, root) that connect what three bits connect; ``marks`` holds distinct fingerprints."""
    spread = marks.select(F.inline(F.array(*[F.struct(F.lit(r).alias("turn"), _rotated(F.col("mark"), r).alias("value")) for r in range(64 // BLOCK)])))
    spread = spread.withColumn("block", F.shiftrightunsigned("value", 64 - BLOCK).cast("int"))
    large = spread.groupBy("turn", "block").count().where(F.col("count") > split_over).select("turn", "block", F.lit(True).alias("large"))
    spread = spread.join(large, ["turn", "block"], "left")
    # a large trie is cut into its nodes CUT bits down; each pair of nodes within the budget is one piece of work
    node = F.shiftrightunsigned("value", 64 - BLOCK - CUT).bitwiseAND(F.lit((1 << CUT) - 1)).cast("int")
    flips = [m for m in range(1 << CUT) if bin(m).count("1") <= BUDGET]
    other = F.array(*[F.lit(m) for m in flips])
    pairs = F.transform(other, lambda m: F.struct(F.least(node, node.bitwiseXOR(m)).alias("a"), F.greatest(node, node.bitwiseXOR(m)).alias("b"), (node.bitwiseXOR(m) < node).cast("int").alias("side")))
    whole = F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("side")))
    work = spread.select("turn", "block", "value", F.inline(F.when(F.col("large"), pairs).otherwise(whole)))
    key = (F.col("turn").cast("long") * (1 << BLOCK) + F.col("block")) * 4096 + (F.col("a") + 1) * 64 + F.col("b") + 1
    work = work.select(key.alias("trie"), "side", "value").repartition(F.col("trie"))
    work = work.sortWithinPartitions("trie", "side", (F.col("value").bitwiseXOR(F.lit(-(2**63)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(trie, side, value):
            for two in (False, True):  # node pairs (a, b) with a < b join two sides
                pick = (trie // 64 % 64 != trie % 64) if two else (trie // 64 % 64 == trie % 64)
                t, s, v = trie[pick], side[pick], value[pick]
                if not len(t):
                    continue
                inside = 64 - BLOCK if not two else 64 - BLOCK - CUT
                label = join_tries(t, v, inside, BUDGET, s if two else None)
                mine = np.flatnonzero(label != np.arange(len(label)))
                if len(mine):
                    turn = (t[mine] >> (12 + BLOCK)).astype(np.uint64) * np.uint64(BLOCK)
                    back = lambda x: np.where(turn == 0, x, (x >> turn) | (x << (np.uint64(64) - np.maximum(turn, 1)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(back(v[mine])), pa.array(back(v[label[mine]]))], ["mark", "root"])

        held: list[tuple] = []
        for b in batches:
            held.append((b.column("trie").to_numpy(), b.column("side").to_numpy().astype(np.int8), b.column("value").to_numpy().view(np.uint64)))
            if sum(len(x[0]) for x in held) >= CHUNK:
                trie, side, value = (np.concatenate(x) for x in zip(*held))
                cut = np.searchsorted(trie, trie[-1])  # the last trie may go on
                if cut:
                    yield from stars(trie[:cut], side[:cut], value[:cut])
                held = [(trie[cut:], side[cut:], value[cut:])]
        if held:
            yield from stars(*(np.concatenate(x) for x in zip(*held)))

    work.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    return work.mapInArrow(run, "mark long, root long").distinct()


def connect(stars: DataFrame) -> DataFrame:
    """(mark, root) with root the smallest mark connected, for every mark in ``stars``: alternating large and small stars.

    Each round is written; minima are taken before anything is joined, so a hub's neighbours meet
    only in joins, whose large side Spark splits.
    """
    edges, before = written(stars.where("mark != root"), "stars"), None
    while True:
        for large in (True, False):
            both = edges.select(F.col("mark").alias("u"), F.col("root").alias("v"))
            if large:
                both = both.union(both.select("v", "u"))
            else:
                both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
            met = both.join(low, "u")
            moved = met.where("v > u" if large else "v != low").select(F.col("v").alias("mark"), F.col("low").alias("root"))
            if not large:
                moved = moved.union(low.select(F.col("u").alias("mark"), F.col("low").alias("root")))
            edges = written(moved.where("mark != root").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("mark", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def rooted(marks: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """mark and root, the smallest fingerprint that links reach, for each fingerprint of ``marks``."""
    every = marks.select("mark").distinct()
    return every.join(connect(links(every, split_over)), "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def components(docs: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """doc_id, mark and component_id, one row for each row of ``docs``."""
    each = written(fingerprints(docs), "marks")
    least = each.groupBy("mark").agg(F.min("doc_id").alias("least")).join(rooted(each, split_over), "mark")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(least.join(ids, "root").select("mark", "component_id"), "mark").select("doc_id", "mark", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group one row stays, columns untouched.

    It is the row with the smallest doc_id (a row without one only where no other is linked to it), of rows that
    share it the one whose text has the least hash; of rows alike in both, one. So rows are told apart by
    doc_id and text, and two texts under one doc_id that are no near copies both stay.
    """
    id_, one, two, text = (fresh(docs, x) for x in ("_id", "_one", "_two", "_mark"))
    hashes = [F.xxhash64("text").alias(one), F.xxhash64(F.lit(1), "text").alias(two)]
    each = written(fingerprints(docs.select("doc_id", *hashes, "text"), [one, two]).withColumnRenamed("doc_id", id_), "marks")
    rows = each.groupBy("mark", id_, one, two).agg(F.count("*").alias("rows")).join(rooted(each), "mark")
    first = F.min(F.struct(F.col(id_).isNull(), id_, one, two, "rows")).alias(text)
    kept = rows.groupBy("root").agg(first).select(f"{text}.{id_}", f"{text}.{one}", f"{text}.{two}", F.col(f"{text}.rows").alias(text))
    kept = written(kept, "kept").withColumnsRenamed({one: one + "k", two: two + "k"})
    met = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")})
    met = met.join(kept, (F.col(one) == F.col(one + "k")) & (F.col(two) == F.col(two + "k")) & F.col("doc_id").eqNullSafe(F.col(id_)))
    out = met.where(F.col(text) == 1).select(*docs.columns)
    if kept.where(F.col(text) > 1).limit(1).count():
        out = out.unionByName(met.where(F.col(text) > 1).dropDuplicates(["doc_id", one, two]).select(*docs.columns))
    return out
