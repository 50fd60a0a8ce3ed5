"""Document fingerprints from prefix polynomial hashes.

``S[i] = sum of (c_j + 1) * B**j for j < i``, modulo two primes below 2**31, is kept for a text's code
points. Any span's hash is then ``(S[end] - S[start]) * B**-start``, so spans compare in constant time,
within a text or between two, and the longest common extension of two places is found by bisection.
A text made of spans of other texts gets its array from theirs, without reading it again.

The fingerprint is the hash of the whole span with its length, and the KEPT smallest different hashes
of all spans of WINDOW code points (of the whole text if it is shorter). The likeness of two
fingerprints estimates the share of windows their texts have in common.

Defined cases: a null text is empty; an empty text has no windows, likeness 1 to an empty text and 0
to any other; rows with equal doc_id follow each other by text; a row without doc_id is its own next
document; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, plus

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
WINDOW, KEPT, HASH_AT_ONCE = 16, 64, 1 << 20
#: Documents that one bucket of neighbours holds.
BUCKET_ROWS = 1000
#: Buckets at most; beyond BUCKET_ROWS times as many documents, buckets grow.
MAX_BUCKETS = 20_000

_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """B**j and B**-j for j < n, for both primes; grown by doubling."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        grown = []
        for p, base in zip(PRIMES, BASES):
            for b in (base, pow(base, -1, p)):
                x = np.ones(1, np.uint64)
                while len(x) < n:
                    x = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
                grown.append(x)
        _powers = grown
    return _powers


class Prefix:
    """Prefix hashes of a sequence of code points."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums, self.n = sums, len(sums[0]) - 1

    @classmethod
    def of(cls, points: np.ndarray) -> Prefix:
        own, up = points.astype(np.uint64) + np.uint64(1), powers(len(points) + 1)
        sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * up[2 * k][: len(own)] % np.uint64(p), out=s[1:])  # below 2**64 up to 2**33 code points
            sums.append(s % np.uint64(p))
        return cls(sums)

    def then(self, keep: int, other: Prefix, take: int) -> Prefix:
        """The first ``keep`` code points of this text, then the first ``take`` of the other."""
        up, sums = powers(max(self.n, other.n, keep + take) + 1), []
        for k, p in enumerate(PRIMES):
            rest = self.sums[k][keep] + up[2 * k][keep] * other.sums[k][1 : take + 1]
            sums.append(np.concatenate([self.sums[k][: keep + 1], rest % np.uint64(p)]))
        return Prefix(sums)

    def spans(self, start: np.ndarray, size: int) -> np.ndarray:
        """62-bit hashes of the spans of ``size`` code points from each start."""
        up, out = powers(self.n + 1), np.zeros(len(start), np.uint64)
        for k, p in enumerate(PRIMES):
            s, m = self.sums[k], np.uint64(p)
            out = (out << np.uint64(31)) | ((s[start + size] + m - s[start]) * up[2 * k + 1][start] % m)
        return out

    def span(self, start: int, size: int) -> int:
        return int(self.spans(np.array([start]), size)[0])

    def common(self, at: int, other: Prefix, other_at: int) -> int:
        """Length of the longest common extension of two places, by bisection over span equality."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, mid) == other.span(other_at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self) -> np.ndarray:
        """The smallest KEPT different window hashes, 32 bits each."""
        size, low = min(WINDOW, self.n), np.zeros(0, np.uint32)
        if not size:
            return low
        count = self.n - size + 1
        for at in range(0, count, HASH_AT_ONCE):
            h = scramble(self.spans(np.arange(at, min(at + HASH_AT_ONCE, count)), size))
            m = 2 * KEPT
            while True:  # repeated windows may leave too few different ones among the smallest
                few = np.unique(h if m >= len(h) else np.partition(h, m)[:m])
                if len(few) >= KEPT or m >= len(h):
                    break
                m *= 8
            low = np.unique(np.concatenate([low, few]))[:KEPT]
        return low

    def fingerprint(self) -> str:
        whole = scramble(np.array([self.span(0, self.n) ^ self.n << 1], np.uint64)) if self.n else np.zeros(1, np.uint32)
        return f"{self.n:08x}{int(whole[0]):08x}" + self.sketch().astype(">u4").tobytes().hex()


def scramble(h: np.ndarray) -> np.ndarray:
    """Upper half of a 64-bit finaliser: spreads polynomial hashes evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Share of the smallest windows of both texts that both have; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(z[16:]), ">u4") for z in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:KEPT]
    return float(np.isin(union, np.intersect1d(x, y)).sum()) / len(union)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket and tail, dealt by bucket and sorted by descending doc_id within.

    Buckets are ranges of doc_id; the first document of each is also sent, as the tail, to the bucket
    before, and that of the first bucket to the last. Only cut points and one id for each bucket come
    to the driver, MAX_BUCKETS at most; a bucket is sorted, where it is large on disk, and read in batches.
    An id that is no number counts as none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id is not null")
    parts = min(MAX_BUCKETS, max(1, -(-ids.count() // BUCKET_ROWS)))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []

    def dealt(heads: dict[int, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column("doc_id").to_pylist()
                at = [len(cuts) - bisect_right(cuts, x) if x is not None else i % parts for i, x in enumerate(key)]
                rows, tail = list(range(len(key))), [False] * len(key)
                for i, x in enumerate(key if heads else []):
                    if x in heads:
                        rows.append(i)
                        tail.append(True)
                        at.append(heads[x])
                b = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(tail)], [*b.schema.names, "bucket", "tail"])

        return run

    first = arrow_pass(ids, dealt(None), plus(ids, bucket="int", tail="boolean")).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    heads = {b.head: a.bucket for a, b in zip(first, first[1:] + first[:1])}
    spread = arrow_pass(docs, dealt(heads), plus(docs, bucket="int", tail="boolean"))
    return spread.repartition(max(parts, 1), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edit with the next document, and their likeness.

    The edited text keeps its first half and goes on with the beginning of the next document, by
    descending doc_id; ``common_edited`` and ``common_next`` are the code points both begin with.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(doc_id, text, own, mark, next_text, following, next_mark):
        n = own.n
        keep, take = n - n // 2, min(n // 2, following.n)
        edited = own.then(keep, following, take)
        sha = hashlib.sha256((text[:keep] + next_text[:take]).encode()).hexdigest()
        edited_mark = edited.fingerprint()
        return (doc_id, n, sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark), own.common(0, edited, 0), own.common(0, following, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one
        for b in batches:
            out = []
            for doc_id, text, bucket, tail in zip(*(c.to_pylist() for c in b.columns)):
                if tail and held is None:
                    continue  # a further row with the id of the tail
                own = Prefix.of(code_points(text))
                mark = own.fingerprint()
                if held is not None and (tail or doc_id is not None):
                    out.append(row(*held, text, own, mark))
                if doc_id is None:
                    out.append(row(doc_id, text, own, mark, text, own, mark))
                elif tail:
                    held = None
                else:
                    held = (doc_id, text, own, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if i else pa.array(list(c), pa.int64()) for i, c in enumerate(zip(*out))], names)

    return arrow_pass(in_order(docs), run, schema)
