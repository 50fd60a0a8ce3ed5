"""Periodic runs of words, by online dyadic square catching.

A run is a stretch of words with smallest period p (words p apart are equal) that is at least EXPONENT
periods and MIN_WORDS words long and that no neighbouring word extends. Words are appended in pieces.
For each power of two L a catcher watches the completed blocks of L words: the second half of a square
of half-length p, 2L <= p < 4L (1 <= p < 4 for L = 1), holds a whole aligned block, which stands p words
earlier too. When a block is complete the catcher compares it with what stood p words before it, for all
its p at once; a period whose blocks go on matching stays open, and each further block advances its
comparison. Squares of one period that follow each other are thus one open stretch, which is reported
when it breaks and merged into a run: its ends are found word by word, less than one block away.

A catcher is made when there are 8 L words, as a run of four periods needs, and keeps the hashes of the
last 5 L positions and one open start for each period, so a text's state is a few numbers a word. Each word is compared
twice for each catcher, in arrays. Hashes only propose: a stretch is compared word by word before it
counts. A stretch inside a run of smaller period says nothing new (both periods hold on more than their
sum of words, so one divides the other) and is left out before any word is compared.

Defined cases: a null or empty text has no words and no runs; repeated rows are judged each; a very long
text is held whole by its task, as numbers; extra columns stay untouched in :func:`collapsed`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, fresh, plus, utf8

EXPONENT, MIN_WORDS = 4, 6
#: Words appended at a time, and comparisons held at a time.
PIECE, CELLS = 1 << 15, 1 << 22
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def doubled(marks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of ``2 * size`` words from those of ``size`` words, for each position that has one."""
    x = marks[:-size] * _A + (marks[size:] ^ _B)
    return (x ^ (x >> np.uint64(29))) * _B


class Catcher:
    """Squares of half-length ``low`` to ``high - 1`` over completed blocks of ``size`` words."""

    def __init__(self, size: int) -> None:
        self.size, self.low, self.high = size, 1 if size == 1 else 2 * size, 4 * size
        self.periods = np.arange(self.high - 1, self.low - 1, -1)  # column c stands for this period
        matched = np.maximum((EXPONENT - 1) * self.periods, MIN_WORDS - self.periods)
        self.least = matched if size == 1 else np.maximum((matched + 1) // size - 1, 1)
        self.blocks = 0
        #: Hashes of the positions from ``base`` on; before the text stands nothing that is equal to a word.
        self.base, self.marks = 1 - self.high, np.zeros(self.high - 1, np.uint64)
        self.open, self.going = np.full(len(self.periods), -1), False
        self.closed: list[np.ndarray] = []

    @property
    def known(self) -> int:
        """Positions whose hashes have been given."""
        return self.base + len(self.marks)

    def append(self, marks: np.ndarray) -> tuple[int, np.ndarray]:
        """Hashes of the next positions; compares the blocks that they complete. Returns what it held to do so, and from which position."""
        base, held = self.base, np.concatenate([self.marks, marks])
        self.marks, ready = held, (base + len(held) - 1) // self.size + 1
        rows = max(1, CELLS // len(self.periods))
        for first in range(self.blocks, ready, rows):
            self._compare(first, min(first + rows, ready))
        self.blocks = max(self.blocks, ready)
        self.base = max(base, self.blocks * self.size - self.high + 1)
        self.marks = held[self.base - base :]
        return base, held

    def _compare(self, first: int, last: int) -> None:
        """Blocks ``first`` to ``last - 1`` against all their periods."""
        at = first * self.size - self.base
        own = self.marks[at : at + (last - first - 1) * self.size + 1 : self.size]
        start, width, step = at - self.high + 1, len(self.periods), self.marks.strides[0]
        earlier = np.lib.stride_tricks.as_strided(self.marks[start:], (last - first, width), (self.size * step, step), writeable=False)
        same = earlier == own[:, None]
        if not same.any():
            self._break(first)
            return
        column, row = np.nonzero(same.T)
        new = np.flatnonzero((column[1:] != column[:-1]) | (row[1:] != row[:-1] + 1)) + 1
        head, tail = np.r_[0, new], np.r_[new, len(column)] - 1
        c, begin, end = column[head], row[head] + first, row[tail] + first
        on = (begin == first) & (self.open[c] >= 0)
        begin[on] = self.open[c[on]]
        self.open[c[on]] = -1
        self._break(first)
        live = end == last - 1
        self._close(c[~live], begin[~live], end[~live])
        self.open[c[live]], self.going = begin[live], live.any()

    def _break(self, at: int) -> None:
        """What is still open ends before block ``at``."""
        if self.going:
            c = np.flatnonzero(self.open >= 0)
            self._close(c, self.open[c], np.full(len(c), at - 1))
            self.open[c], self.going = -1, False

    def _close(self, c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        enough = end - begin + 1 >= self.least[c]
        if enough.any():
            self.closed.append(np.stack([self.periods[c[enough]], begin[enough] * self.size, (end[enough] + 1) * self.size]))

    def finish(self) -> np.ndarray:
        """Stretches (period, first word, end) equal to what stands a period before, each period's in order."""
        self._break(self.blocks)
        found = np.concatenate(self.closed, axis=1) if self.closed else np.zeros((3, 0), np.int64)
        return found[:, np.lexsort((found[1], found[0]))]


class RunFinder:
    """Finds the runs of a text whose words are appended as numbers above zero; none is longer than ``longest`` words."""

    def __init__(self, longest: int | None = None) -> None:
        self.words, self.n, self.longest = np.zeros(PIECE, np.int64), 0, longest
        self.catchers: list[Catcher] = []

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.zeros(max(len(words), self.n), np.int64)])
        self.words[self.n : self.n + len(words)] = words
        self.n += len(words)
        size, base, held = 1, 0, self.words[:0]
        most = self.n if self.longest is None else min(self.n, self.longest)
        while EXPONENT * (1 if size == 1 else 2 * size) <= most:
            if len(self.catchers) < size.bit_length():
                self.catchers.append(Catcher(size))
            catcher = self.catchers[size.bit_length() - 1]
            if size == 1:
                new = self.words[catcher.known : self.n].astype(np.uint64)
            elif catcher.known >= base:
                new = doubled(held[catcher.known - base :], size // 2)
            else:  # a new catcher, and the one below has let go of the beginning
                new = self._marks(size)
            base, held = catcher.append(new)
            size *= 2

    def _marks(self, size: int) -> np.ndarray:
        marks, at = self.words[: self.n].astype(np.uint64), 1
        while at < size:
            marks, at = doubled(marks, at), at * 2
        return marks

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        found: dict[tuple[int, int], int] = {}
        words = self.words
        for catcher in self.catchers:
            p, a, b = catcher.finish()
            if not len(p):
                continue
            if found:
                known = sorted(found)
                starts, reach = np.array([s for s, _ in known]), np.maximum.accumulate([e for _, e in known])
                at = np.searchsorted(starts, a - p, "right") - 1
                new = (at < 0) | (reach[at] < b)
                p, a, b = p[new], a[new], b[new]
            for p_, a_, b_ in zip(p.tolist(), a.tolist(), b.tolist()):
                if not np.array_equal(words[a_:b_], words[a_ - p_ : b_ - p_]):
                    continue
                low, high = max(p_, a_ - catcher.size), min(self.n, b_ + catcher.size)
                odd = np.flatnonzero(words[low:a_] != words[low - p_ : a_ - p_])
                start = (low + odd[-1] + 1 if len(odd) else low) - p_
                odd = np.flatnonzero(words[b_:high] != words[b_ - p_ : high - p_])
                end = b_ + odd[0] if len(odd) else high
                if end - start >= max(MIN_WORDS, EXPONENT * p_):
                    found.setdefault((int(start), int(end)), p_)
        return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each text, a list of words, the (start, length, period) of its runs.

    Short texts are appended one after another to one finder, each behind a word that stands nowhere else,
    which no run can hold.
    """
    out, at = [], 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(texts[until]) < PIECE):
            size += len(texts[until]) + 1
            until += 1
        group, ids = texts[at:until], {}
        codes, offsets = np.zeros(size, np.int64), []
        here = 0
        for k, words in enumerate(group):
            codes[here] = -1 - k
            codes[here + 1 : here + 1 + len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]
            offsets.append(here + 1)
            here += len(words) + 1
        finder = RunFinder(max(map(len, group)))
        for piece in range(0, size, PIECE):
            finder.append(codes[piece : piece + PIECE])
        found: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for start, length, period in finder.runs():
            k = int(np.searchsorted(offsets, start, "right")) - 1
            found[k].append((start - offsets[k], length, period))
        out += found
        at = until
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    turn = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    return np.cumsum(turn[:-1]) == 0


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words, in order) and ``collapsed``, the text of the
    words that are left when each run keeps its first period; underscores go behind names that are taken."""
    runs_name, text_name = fresh(docs, "runs"), fresh(docs, "collapsed")
    schema = plus(docs, **{runs_name: RUNS, text_name: "string"})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.split() for x in utf8(b.column(at))]  # at 0x20 and 0x09-0x0D
            found = runs_of(texts)
            for k, got in enumerate(found):
                if got:
                    texts[k] = [texts[k][i] for i in np.flatnonzero(kept(len(texts[k]), got)).tolist()]
                found[k] = [{"start": s, "length": n, "period": p} for s, n, p in got]
                texts[k] = b" ".join(texts[k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return arrow_pass(docs, run, schema)
