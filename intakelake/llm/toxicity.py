"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document is labelled. A sentence scores
``p = sigmoid(bias + sum of the weights of its words' features)``; the document scores by noisy-or,
``1 - product of (1 - p)``: it is toxic if any sentence is. In the product each sentence counts beyond
what the bias alone gives, and the bias counts once for a document, so that sentences without evidence
add nothing however many there are. The weights are trained through the same noisy-or from document
labels alone, with weights held at or above zero and an L1 penalty. The sentences' own scores then
locate what offends.

The features of a word are the word, its beginnings and its endings; a worker remembers the sum for
each word. The model is fitted on a bounded sample (PER_CLASS rows of MAX_BYTES at most).

Defined cases: a null or empty text has no sentences and scores 0; with no labelled rows of both
classes nothing is learnt and only the bias speaks; repeated rows score alike; extra columns are not
read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import arrow_pass, plus

#: Bounds of the sample: toxic and other rows, and bytes of a text.
PER_CLASS, MAX_BYTES = {1: 1200, 0: 2400}, 1 << 14
BIAS, STEPS, RATE, PENALTY, MIN_TEXTS = -10.0, 200, 2.0, 1e-5, 3
BEGINNINGS, ENDINGS = (4, 5, 6), (4, 5)
REMEMBERED = 400_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> list[int]:
    """Hashes of the word, its beginnings and its endings, in lower case without outer marks."""
    core = _EDGE.sub("", word).lower()
    if len(core) < 3:
        return []
    names = [f"={core}"] + [f"{core[:k]}*" for k in BEGINNINGS if len(core) >= k] + [f"*{core[-k:]}" for k in ENDINGS if len(core) >= k]
    return [xxhash.xxh64_intdigest(n) for n in names]


def fit(texts: list[str], labels: list[int]) -> dict[int, float]:
    """Weights above zero by feature hash."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return {}
    words: dict[str, int] = {}
    sentence_of, word_of, text_of = array("i"), array("i"), array("i")
    for t, text in enumerate(texts):
        for s in SENTENCE.findall(text):
            own = {words.setdefault(w, len(words)) for w in s.split()}
            if own:
                word_of.extend(own)
                sentence_of.extend([len(text_of)] * len(own))
                text_of.append(t)
    sentence_of, word_of, text_of = (np.array(x, np.int32) for x in (sentence_of, word_of, text_of))
    has, hashes = array("i"), array("Q")
    for w, i in words.items():
        own = features(w)
        hashes.extend(own)
        has.extend([i] * len(own))
    has, hashes = np.array(has, np.int32), np.array(hashes, np.uint64)
    names, feature = np.unique(hashes, return_inverse=True)
    # texts in which a feature occurs, counted on the words' texts
    in_text = np.unique(text_of[sentence_of].astype(np.int64) * len(words) + word_of)
    order = np.argsort(has, kind="stable")
    begin = np.searchsorted(has[order], np.arange(len(words) + 1))
    w = (in_text % len(words)).astype(np.int64)
    n = begin[w + 1] - begin[w]
    each = np.repeat(begin[w] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    seen = np.unique(np.repeat(in_text // len(words), n) * len(names) + feature[order][each]) % len(names)
    toxic_seen = np.bincount(seen, minlength=len(names)) >= MIN_TEXTS
    keep = np.flatnonzero(toxic_seen)
    at = np.full(len(names), -1)
    at[keep] = np.arange(len(keep))
    use = at[feature] >= 0
    has, feature = has[use], at[feature[use]]

    theta, square, quiet = np.zeros(len(keep)), np.full(len(keep), 1e-8), np.logaddexp(0, BIAS)
    for _ in range(STEPS):
        score = np.bincount(has, theta[feature], len(words))
        s = BIAS + np.bincount(sentence_of, score[word_of], len(text_of))
        clean = np.bincount(text_of, quiet - np.logaddexp(0, s), len(y)) - quiet  # log of the product of 1 - p
        q = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = np.where(y == 1, -(1 - q) / q, 1.0) / len(y)
        g = pull[text_of] / (1 + np.exp(-s))
        grad = np.bincount(feature, np.bincount(word_of, g[sentence_of], len(words))[has], len(keep))
        square += grad * grad
        rate = RATE / np.sqrt(square)
        theta = np.maximum(0, theta - rate * (grad + PENALTY))
    return {int(names[keep[i]]): float(theta[i]) for i in np.flatnonzero(theta > 0.05)}


class WordScores(dict):
    """Summed weights by word, remembered up to REMEMBERED words."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        got = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


def judge(text: str, score: WordScores) -> tuple[float, list[dict]]:
    """The document's score and its offending sentences, those that score a half or more."""
    quiet, loud, found = float(np.logaddexp(0, BIAS)), 0.0, []
    marked = any(map(score.__getitem__, text.split()))
    for m in SENTENCE.finditer(text) if marked else ():
        s = sum(map(score.__getitem__, set(m[0].split())))
        if not s:
            continue
        loud += float(np.logaddexp(0, BIAS + s)) - quiet
        if BIAS + s >= 0:
            found.append({"start": m.start(), "end": m.end(), "score": float(1 / (1 + np.exp(-BIAS - s)))})
    if any(not m[0].isspace() for m in SENTENCE.finditer(text)):
        loud += quiet
    return float(-np.expm1(-loud)), found


def scored(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id, score, predicted and the offending sentences (start, end and score of each)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # features of the bounded sample
    schema = plus(docs.select("doc_id"), score="double", predicted="int", offending="array<struct<start: int, end: int, score: double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = WordScores(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [judge(x or "", score) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p for p, _ in got], pa.float64()), pa.array([int(p >= 0.5) for p, _ in got], pa.int32()), pa.array([x for _, x in got], kind)], schema.names)

    return arrow_pass(docs, run, schema)
