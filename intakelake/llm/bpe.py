"""Byte-level BPE by monoid tree reduction.

The encoding of a run of bytes is an element of a monoid: the empty run is its identity, and joining
the encodings of two neighbours gives the encoding of both. A run is halved down to leaves of a few
bytes; leaves are merged lowest rank first, and neighbours are joined up the tree. A join re-encodes
a window around the border and doubles it until the tokens outside provably stay.

Why they stay: a sequence of tokens is the encoding of its bytes exactly if every two neighbours
encode to themselves. (Take the first merge over a border between tokens. Until then each token has
merged by itself, as it does when the two are encoded alone, so the two alone would merge over that
border as well.) Inside both runs and inside the window all neighbours are stable; so once the two
outer borders of the window are, the whole is the encoding.

Text is cut by the tokenizer's pattern first; no merge crosses a match, so encodings of matches are
simply concatenated. A match that is a token as a whole is that token. Decoding concatenates up the
tree. Defined cases: a null or empty text has no ids and decodes to no bytes; special tokens are not
known; repeated rows are encoded each; a row without doc_id is encoded like any other.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, plus

#: Bytes of a leaf, ids of a leaf when decoding, runs from which merging uses a heap.
LEAF, DECODE_LEAF, HEAP_FROM = 24, 4096, 48
#: Matches remembered by a worker; the memory is emptied when full.
REMEMBERED = 300_000


class Remembered(dict):
    """Results of a function by text, emptied when full; long texts are not kept."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, text: str):
        got = self.of(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = got
        return got


class Codec:
    """Encoder and decoder for ``{token bytes: rank}`` and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # \s of the tokenizer is the White_Space property; spelt out, as Python's has four controls more
        white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        spelt = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
        self.matches = regex.compile(spelt, regex.V1).findall
        self.by_match, self.by_word = Remembered(self.encode_match), Remembered(self.encode_word)
        self.firm: dict[tuple[int, int], bool] = {}

    def merge(self, run: bytes) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost of equals, until none has a rank."""
        if len(run) >= HEAP_FROM:
            return self._merge_long(run)
        rank, none = self.ranks.get, len(self.tokens)
        parts = [run[i : i + 1] for i in range(len(run))]
        pair = [rank(run[i : i + 2], none) for i in range(len(run) - 1)]
        while pair and (best := min(pair)) != none:
            at = pair.index(best)
            parts[at] += parts.pop(at + 1)
            del pair[at]
            if at < len(pair):
                pair[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                pair[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[x] for x in parts]

    def _merge_long(self, run: bytes) -> list[int]:
        n, rank = len(run), self.ranks.get
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(run[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or after[j] != end:
                continue
            dead[j], after[i] = True, end
            if end < n:
                before[end] = i
                if (r := rank(run[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := rank(run[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [self.ranks[run[i : after[i]]] for i in range(n) if not dead[i]]

    def stable(self, a: int, b: int) -> bool:
        """Do these neighbours encode to themselves?"""
        got = self.firm.get((a, b))
        if got is None:
            if len(self.firm) >= REMEMBERED:
                self.firm.clear()
            got = self.firm[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the two runs together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            k *= 2
            head, tail = left[:-k], right[k:]
            window = self.merge(b"".join([self.tokens[t] for t in left[-k:] + right[:k]]))
            if (not head or self.stable(head[-1], window[0])) and (not tail or self.stable(window[-1], tail[0])):
                return head + window + tail

    def tree(self, run: bytes) -> list[int]:
        if len(run) <= LEAF:
            return self.merge(run)
        return self.join(self.tree(run[: len(run) // 2]), self.tree(run[len(run) // 2 :]))

    def encode_match(self, match: str) -> bytes:
        run = match.encode()
        whole = self.ranks.get(run)
        return array("I", self.tree(run) if whole is None else [whole]).tobytes()

    def encode_matches(self, text: str) -> bytes:
        return b"".join([self.by_match[x] for x in self.matches(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space between two other characters that are not white always begins a match, so the words
        between such spaces are looked up one by one; a text with other white space beside a space is
        matched as a whole.
        """
        first, *words = text.split(" ")
        if first[-1:].isspace() or not first:
            return self.encode_matches(text)
        ids = list(map(self.by_word.__getitem__, words))
        return self.encode_matches(text) if None in ids else self.encode_matches(first) + b"".join(ids)

    def encode_word(self, word: str) -> bytes | None:
        """Encoding of the word with its space; None where white space stands beside that space or the next."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.encode_matches(" " + word)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join([self.tokens[i] for i in ids])
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def read_ranks(path: str) -> bytes:
    """The rank file: a line for each token, base64 and rank. It has a fixed size, far below a megabyte or two."""
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[tuple, Codec] = {}


def codec(lines: bytes, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (lines, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec({base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x)}, pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to carry, ids (binary, little-endian unsigned 32-bit) and n_tokens of every whole text."""
    lines = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = docs.select("doc_id", *(carry or []), "text")
    schema = plus(docs.drop("text"), ids="binary", n_tokens="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(lines.value, pattern)
        for b in batches:
            ids = [one.encode(x or "") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], schema.names)

    return arrow_pass(docs, run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes its ids stand for."""
    lines = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = plus(encoded, decoded="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(lines.value, pattern)
        for b in batches:
            back = [one.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary())], schema.names)

    return arrow_pass(encoded, run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
