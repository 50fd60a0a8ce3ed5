"""Substring dedup: words covered by a window that also stands elsewhere are removed, found behind a count-min prefilter.

A window is WINDOW consecutive words of one text. First pass: each task counts into a count-min sketch of
its own and hands on its blocks; the blocks are added up. Counts stop at two, which is all that is asked.
A window is counted by its anchor, the least of the hashes of its SHINGLE-word stretches, and each place of
a text that is some window's anchor counts once. Two places of a window are two places of its anchor, so the
sketch never says less than the window's count, and it counts about a tenth of what windows there are.
Second pass: windows that the sketch estimates to be repeated, and only those, are sorted by their 128-bit
hash; those that turn out to stand alone go back to their texts. So a window is repeated exactly if the
sketch says so and it has not come back. The third pass removes words.

Nothing depends on how full the sketch is but the work: the sketch has about four slots a row for each
anchor up to MAX_SLOTS (MAX_SLOTS / 4 bytes are broadcast), and a fuller one sends more windows to the
second pass, at worst all. A task hands on each window at most twice for each CHUNK of windows it has read,
so passages in all texts do not meet in one task. What comes back stands in one text alone, so nothing
hot comes back. Rows are known by two hashes of their text: equal texts have equal answers, and only a text
without a copy gets anything back.

Defined cases: a null or empty text has no words; one below WINDOW words has no window; repeated rows of
WINDOW words are removed whole; a repeat inside one text counts, overlapping or not; extra columns stay
untouched in :func:`without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, fresh, plus, utf8

WINDOW, SHINGLE = 35, 16
#: Rows of the sketch, slots of a row at most (a power of two), slots of a block, bytes of text for each slot of a row.
ROWS, MAX_SLOTS, BLOCK, BYTES_PER_SLOT = 2, 1 << 28, 1 << 16, 16
#: Anchors or windows a task gathers before it hands them on, and words whose hashes it keeps at hand.
CHUNK, HELD_WORDS = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordMarks(dict):
    """16 bytes for each word, made once while it is held."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= HELD_WORDS:
            self.clear()
        mark = self[word] = xxhash.xxh3_128_digest(word)
        return mark


class Powers:
    """Powers of the base and of its inverse, as many as have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, np.uint64)])
            self.up, self.down = grow(_BASE), grow(_INVERSE)
        return self.up[:n], self.down[:n]


def stretch_hashes(marks: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """For each position the hash of ``size`` words from there, by prefix sums."""
    up, down = powers(len(marks))
    total = np.r_[np.uint64(0), np.cumsum(marks * up)]
    return (total[size:] - total[:-size]) * down[: len(marks) - size + 1]


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``size`` numbers in a row."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[:n], x[size - have : size - have + n])


class Windows:
    """The windows of a batch of texts, all their words side by side."""

    def __init__(self, texts: list[bytes], held: WordMarks, powers: Powers) -> None:
        self.words = [x.split() for x in texts]  # at 0x20 and 0x09-0x0D
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        pairs = np.frombuffer(b"".join([held[w] for words in self.words for w in words]), np.uint64).reshape(n, 2)
        count = max(n - WINDOW + 1, 0)
        #: The text of each position at which WINDOW words are left, and whether they are all its own.
        self.text = np.repeat(np.arange(len(texts)), self.sizes)[:count]
        self.whole = np.arange(count) + WINDOW <= (self.starts + self.sizes)[self.text]
        self.place = np.arange(count) - self.starts[self.text]
        if not count:
            self.hash = np.zeros((2, 0), np.uint64)
            self.anchor, self.counted = self.hash[0], self.hash[0]
            return
        own = np.ascontiguousarray(pairs.T)
        self.hash = np.stack([stretch_hashes(x, WINDOW, powers) for x in own])
        least = mixed(stretch_hashes(own[0], SHINGLE, powers))
        reach = WINDOW - SHINGLE + 1
        self.anchor = sliding(least, reach, np.minimum)
        # a place is an anchor if a whole window around it has its hash as the least
        found = np.where(self.whole, self.anchor, 0)
        around = sliding(np.r_[np.zeros(reach - 1, np.uint64), found, np.zeros(reach - 1, np.uint64)], reach, np.maximum)
        self.counted = least[(around == least) & (around > 0)]


def slots(anchors: np.ndarray, row: int, n: int) -> np.ndarray:
    return (mixed(anchors, row + 1) >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


class Sketch:
    """Which slots hold two or more, as bits."""

    def __init__(self, n: int) -> None:
        self.n, self.bits = n, np.zeros((ROWS, max(n // 8, 1)), np.uint8)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """Whether the estimate of each anchor, the least of its slots, is two or more."""
        out = np.ones(len(anchors), bool)
        for row in range(ROWS):
            at = slots(anchors, row, self.n)
            out &= (self.bits[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def slots_for(docs: DataFrame) -> int:
    """Slots of a row for these texts: a power of two, at least one block."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_SLOTS, max(BLOCK, 1 << max(size // BYTES_PER_SLOT, 1).bit_length()))


def partial_sketches(docs: DataFrame, n: int) -> DataFrame:
    """row, block, once and twice: the slots that a task has counted once, or twice and more, as 16-bit numbers within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, powers, parts, size = WordMarks(), Powers(), [], 0

        def blocks(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {"row": [], "block": [], "once": [], "twice": []}
            for row in range(ROWS):
                at, times = np.unique(slots(anchors, row, n), return_counts=True)
                block, inside = at // BLOCK, (at % BLOCK).astype("<u2")
                cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(at)]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    more = times[a:b] > 1
                    out["row"].append(row)
                    out["block"].append(int(block[a]))
                    out["once"].append(inside[a:b][~more].tobytes())
                    out["twice"].append(inside[a:b][more].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["twice"], pa.binary())], list(out))

        for b in batches:
            parts.append(Windows(utf8(b.column(0)), held, powers).counted)
            size += len(parts[-1])
            if size >= CHUNK:
                yield from blocks(np.concatenate(parts))
                parts, size = [], 0
        if size:
            yield from blocks(np.concatenate(parts))

    return arrow_pass(docs.select("text"), run, "row int, block int, once binary, twice binary")


def merged(partial: DataFrame) -> DataFrame:
    """row, block and the bits of its slots that hold two or more; blocks without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None and twice.any():
                bits = np.packbits(twice, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits], pa.binary())], ["row", "block", "bits"])

        for b in batches:
            for row, block, one, two in zip(*(c.to_pylist() for c in b.columns)):
                if key != (row, block):
                    yield from done()
                    key, once, twice = (row, block), np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                one, two = np.frombuffer(one, "<u2"), np.frombuffer(two, "<u2")
                twice[one[once[one]]] = True
                once[one] = True
                once[two] = twice[two] = True
        yield from done()

    return arrow_pass(partial.repartition("row", "block").sortWithinPartitions("row", "block"), run, "row int, block int, bits binary")


def sketch_of(docs: DataFrame) -> Sketch:
    """The merged sketch of all texts; its bits, ROWS * MAX_SLOTS / 8 bytes at most, come to the driver."""
    out = Sketch(slots_for(docs))
    for b in merged(partial_sketches(docs, out.n)).toArrow().to_batches():
        for row, block, bits in zip(*(c.to_pylist() for c in b.columns)):
            at = block * (BLOCK // 8)
            out.bits[row, at : at + BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return out


def _key(k1: str, k2: str) -> list:
    """Two hashes of a text; the second leaves room for a place."""
    return [F.xxhash64("text").alias(k1), F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 32).alias(k2)]


def candidates(docs: DataFrame, sketch) -> DataFrame:
    """h1, h2, k1, at: the hash and one or two places of each window estimated repeated, from each CHUNK of windows.

    ``at`` holds k2 above and the number of the window's first word below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, powers, parts, size, known = WordMarks(), Powers(), [], 0, sketch.value

        def rows() -> pa.RecordBatch:
            h1, h2, k1, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            third = np.zeros(len(order), bool)  # like the two before it
            third[2:] = (a[2:] == a[:-2]) & (b[2:] == b[:-2])
            keep = np.sort(order[~third])  # places of a text side by side
            return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (h1, h2, k1, at)], ["h1", "h2", "k1", "at"])

        for b in batches:
            texts = Windows(utf8(b.column(0)), held, powers)
            pick = np.flatnonzero(texts.whole)
            pick = pick[known.repeated(texts.anchor[pick])]
            if not len(pick):
                continue
            of = texts.text[pick]
            k1, k2 = (b.column(i).to_numpy().view(np.uint64)[of] for i in (1, 2))
            parts.append((texts.hash[0][pick], texts.hash[1][pick], k1, (k2 << np.uint64(32)) | texts.place[pick].astype(np.uint64)))
            size += len(pick)
            if size >= CHUNK:
                yield rows()
                parts, size = [], 0
        if size:
            yield rows()

    return arrow_pass(docs.select("text", *_key("k1", "k2")), run, "h1 long, h2 long, k1 long, at long")


def alone(found: DataFrame) -> DataFrame:
    """k1 and at of the candidates whose hash no other has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether the one before it is equal
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns])
            if held is not None:
                x = np.concatenate([held[0], x], axis=1)
            same = np.r_[held is not None and held[1], (x[0, 1:] == x[0, :-1]) & (x[1, 1:] == x[1, :-1])]
            one = ~same[:-1] & ~same[1:]
            held = (x[:, -1:].copy(), bool(same[-1]))
            if one.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[2, :-1][one]), pa.array(x[3, :-1][one])], ["k1", "at"])
        if held is not None and not held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0][2]), pa.array(held[0][3])], ["k1", "at"])

    laid = found.repartition("h1").sortWithinPartitions("h1", "h2")
    laid.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    return laid.mapInArrow(run, "k1 long, at long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``;
    underscores go behind names that are taken."""
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(docs.select("text")))
    single = alone(candidates(docs, sketch)).select(F.col("k1").alias("_k1"), F.shiftrightunsigned("at", 32).alias("_k2"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))
    single = single.groupBy("_k1", "_k2").agg(F.collect_list("place").alias("_places"))
    given = docs.select(F.struct("*").alias("_row"), *_key("_1", "_2"))
    met = given.join(single.hint("merge"), (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2")), "left").select("_row.*", F.col("_places").alias(fresh(docs, "_places")))
    names = [fresh(docs, x) for x in ("kept", "n_words", "n_removed")]
    schema, at = plus(docs, **dict(zip(names, ("string", "long", "long")))), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, powers, known = WordMarks(), Powers(), sketch.value
        for b in batches:
            texts = Windows(utf8(b.column(at)), held, powers)
            again = texts.whole.copy()
            again[again] = known.repeated(texts.anchor[again])
            back = b.column(b.num_columns - 1)
            for k, places in enumerate(back.to_pylist() if back.null_count < len(back) else []):
                if places:
                    again[texts.starts[k] + np.array(places)] = False
            n = int(texts.sizes.sum())
            turn = np.zeros(n + 1, np.int64)
            first = np.flatnonzero(again)
            np.add.at(turn, first, 1)
            np.add.at(turn, first + WINDOW, -1)
            stays = np.cumsum(turn[:-1]) == 0
            kept, removed = [], []
            for words, start, size in zip(texts.words, texts.starts.tolist(), texts.sizes.tolist()):
                own = stays[start : start + size]
                gone = size - int(own.sum())
                kept.append(b" ".join(words if not gone else [words[i] for i in np.flatnonzero(own).tolist()]))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(texts.sizes), pa.array(removed, pa.int64())], schema.names)

    return arrow_pass(met, run, schema)
