"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a shuffled order of their own, fill blocks of a given size. With target weight
w, block k (from 0) of a source is released at slot floor(k / w) and due by slot ceil((k + 1) / w). Of the
released blocks the one due first gets the slot (earliest deadline first); with weights that sum to one
every block meets its window, so after any slot each source has got its weight's share of the slots to
within less than one block.

Weights are whole parts of a period, so the schedule repeats: after PERIOD slots every source has got
exactly its parts. When a source has no blocks left a new phase begins, with the others' parts as the
period, and the guarantee holds anew within the phase. No document is dropped or repeated.

The schedule of a phase is one period long, whatever the amount of data, and made in a task of its own;
every block's slot then follows from its number by a join and arithmetic. Only totals come to the driver,
MAX_SOURCES rows at most; of more sources the smaller ones share lanes (see :func:`lanes`). Documents get their numbers by prefix sums over
pieces of PIECE_ROWS rows, so no source, however large, is numbered in one task.

Defined cases: null source is a source of its own; null text has size zero; equal documents are ordered by
hash, id and text and may take each other's place; sources without weight get the least weight of one part;
extra columns are carried along untouched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Parts of the whole in which weights are given, and characters of a block.
PERIOD, BLOCK_CHARS = 1000, 20_000
#: Sources scheduled each on its own, and the lanes that further ones share.
MAX_SOURCES, TAIL_LANES = 2_000, 64
PIECE_ROWS = 4_000
#: Rows of the schedules up to which they are broadcast; their number is known before.
BROADCAST_ROWS = 200_000
#: Default weights: total size to this power.
ALPHA = 0.5


def parts_of(sizes: list[int], weights: list[float] | None = None, period: int = PERIOD) -> list[int]:
    """Whole parts, at least one each, that sum to ``period`` (or to the number of sources if that is larger)."""
    raw = weights or [max(s, 1) ** ALPHA for s in sizes]
    period, total = max(period, len(raw)), sum(raw)
    exact = [w / total * (period - len(raw)) for w in raw]
    parts = [1 + int(x) for x in exact]
    for i in sorted(range(len(raw)), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(parts)]:
        parts[i] += 1
    return parts


def schedule(parts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(slot, source, k) of one period: earliest deadline first among released blocks."""
    period = sum(parts.values())
    release = lambda s, k: k * period // parts[s]
    due = lambda s, k: -(-(k + 1) * period // parts[s])
    later = [(0, s, 0) for s in sorted(parts)]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(later)
    out = []
    for slot in range(period):
        while later and later[0][0] <= slot:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((slot, s, k))
        if k + 1 < parts[s]:
            heapq.heappush(later, (release(s, k + 1), s, k + 1))
    return out


def phases(parts: list[int], blocks: list[int]) -> list[dict]:
    """For each phase its first slot, and of each source with blocks left its parts and first block.

    A phase lasts until the source that runs out first has had its last block; sources are numbered
    from 0. In a phase of whole and begun periods a source has had ``parts`` blocks for each whole one.
    """
    left, begun, slot, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        live = {i: parts[i] for i in range(len(parts)) if left[i]}
        period = sum(live.values())
        whole = min(left[i] // p for i, p in live.items())
        # within one further period somebody runs out: find the slot after the last block of the first to do so
        had, used = {i: whole * p for i, p in live.items()}, whole * period
        if all(had[i] < left[i] for i in live):
            for at, s, _ in schedule(live):
                had[s] += 1
                if had[s] == left[s]:
                    used += at + 1
                    break
        out.append({"slot": slot, "slots": used, "period": period, "parts": live, "first": {i: begun[i] for i in live}})
        for i, n in had.items():
            left[i] -= n
            begun[i] += n
        slot += used
    return out


def lanes(docs: DataFrame, size: Column) -> tuple[DataFrame, list[list[str | None]]]:
    """``docs`` as row (all its columns), source, doc_id, size and lane, and the sources each lane is named after.

    A source is a lane of its own, numbered from 0 by name. Of more than MAX_SOURCES sources the largest
    ones stay lanes; the others are dealt by hash to TAIL_LANES lanes, in which their documents are shuffled
    together, so that each still gets its share of the lane in the long run. Their lanes are named by no source.
    """
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id", F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.xxhash64("text").alias("mark"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("sum")).orderBy(F.desc("sum"), F.col("source").asc_nulls_first()).limit(MAX_SOURCES + 1).collect()
    tail = TAIL_LANES if len(sums) > MAX_SOURCES else 0
    names = sorted((r.source for r in sums[: MAX_SOURCES - tail if tail else None]), key=lambda x: (x is None, x or ""))
    heads = docs.sparkSession.createDataFrame([(x or "", x is None, i) for i, x in enumerate(names)], "name string, missing boolean, head int")
    met = rows.join(F.broadcast(heads), (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("missing")), "left")
    lane = F.coalesce("head", F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(max(tail, 1))).cast("int"))
    return met.select("row", "source", "doc_id", "size", "mark", lane.alias("lane")), [[x] for x in names] + [[] for _ in range(tail)]


def numbered(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """``rows`` with before: the size of what precedes a row in its lane's order.

    Rows are ordered by a hash; its leading part picks the piece, so a piece's rows are few and its
    total is added to all pieces after it. Window and join share their keys, so that texts move once
    whether or not the sums are broadcast.
    """
    hashed = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("mark", F.lit(0)))
    pieces = max(1, -(-n_rows // PIECE_ROWS))
    rows = rows.withColumn("hash", F.shiftrightunsigned(hashed, 1))
    rows = rows.withColumn("piece", F.floor(F.shiftrightunsigned("hash", 31) * F.lit(pieces) / F.lit(2**32)).cast("int"))
    sums = rows.groupBy("lane", "piece").agg(F.sum("size").alias("sum"))
    ahead = sums.select("lane", "piece", (F.sum("sum").over(Window.partitionBy("lane").orderBy("piece")) - F.col("sum")).alias("ahead"))
    order = Window.partitionBy("lane", "piece").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    met = inside.join(ahead, ["lane", "piece"], "left")
    return met.select("row", "source", "doc_id", "size", "lane", (F.col("inside") + F.coalesce("ahead", F.lit(0))).alias("before"))


#: What the mixture says of a document.
PLACE = ["block", "slot", "release", "due", "phase", "before"]


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK_CHARS, seed: int = 17, size: Column | None = None) -> DataFrame:
    """row (all columns of ``docs``), doc_id, source and PLACE: the document's block in its source, that
    block's slot, release and deadline, its phase, and the size before it in its source. Sorted by slot
    and before, the rows are the mixture.

    A document belongs to the block in which it begins; one longer than a block uses up its source's next
    blocks too, so that shares are shares of characters.
    """
    spark = docs.sparkSession
    rows, names = lanes(docs, F.length("text") if size is None else size)
    rows = numbered(rows, docs.count(), seed).withColumn("block", F.floor(F.col("before") / F.lit(block)).cast("long"))
    totals = rows.groupBy("lane").agg(F.sum("size").alias("size"), F.max("block").alias("last")).orderBy("lane").collect()
    given = None
    if weights is not None:  # what no lane is named after goes to the lanes without a name, in equal parts
        own = [sum(max(weights.get(x, 0.0), 0.0) for x in names[r.lane]) for r in totals]
        rest = sum(max(w, 0.0) for x, w in weights.items() if [x] not in names) / max(sum(not names[r.lane] for r in totals), 1)
        given = [w if names[r.lane] else rest for w, r in zip(own, totals)]
    parts = parts_of([r["size"] for r in totals], given) if totals else []
    plan = phases(parts, [r["last"] + 1 for r in totals])
    tasks = [(n, p["slot"], p["period"], [totals[i].lane for i in p["parts"]], list(p["parts"].values()), list(p["first"].values())) for n, p in enumerate(plan)]
    kinds = "phase int, slot long, period long, lanes array<int>, parts array<long>, first array<long>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                made = schedule(dict(enumerate(int(x) for x in t.parts)))
                yield pd.DataFrame({"lane": [t.lanes[s] for _, s, _ in made], "k": [k for *_, k in made], "at": [x for x, *_ in made], "phase": t.phase,
                                    "first": [t.first[s] for _, s, _ in made], "parts": [t.parts[s] for _, s, _ in made], "start": t.slot, "period": t.period})

    made = spark.createDataFrame(tasks, kinds).repartition(max(1, min(len(tasks), 200)), "phase")
    table = written(made.mapInPandas(run, "lane int, k long, at long, phase int, first long, parts long, start long, period long"), "schedule")
    small = F.broadcast if sum(p["period"] for p in plan) <= BROADCAST_ROWS else lambda df: df
    # the phase of a block: the last one of its lane that begins at or before it; one row a lane, MAX_SOURCES at most
    spans = table.groupBy("lane").agg(F.sort_array(F.collect_set(F.struct("first", "phase", "parts"))).alias("spans"))
    own = rows.join(F.broadcast(spans), "lane", "left")
    own = own.withColumn("in", F.element_at(F.filter("spans", lambda x: x["first"] <= F.col("block")), -1)).drop("spans")
    own = own.select("row", "source", "doc_id", "before", "block", "lane", F.col("in.phase").alias("phase"), (F.col("block") - F.col("in.first")).alias("nth"), ((F.col("block") - F.col("in.first")) % F.col("in.parts")).alias("k"))
    met = own.join(small(table), ["lane", "phase", "k"], "left")
    slot = F.col("start") + F.floor(F.col("nth") / F.col("parts")) * F.col("period") + F.col("at")
    released = F.col("start") + F.floor(F.col("nth") * F.col("period") / F.col("parts"))
    due = F.col("start") + F.ceil((F.col("nth") + 1) * F.col("period") / F.col("parts"))
    return met.select("row", "doc_id", "source", "block", slot.cast("long").alias("slot"), released.cast("long").alias("release"), due.cast("long").alias("due"), "phase", "before")


def in_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mixture: sorted across its files, columns untouched."""
    return placed(docs, **options).orderBy("slot", "before", "doc_id").select("row.*")
