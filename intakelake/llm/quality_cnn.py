"""Quality by a byte-level convolutional network in numpy.

Each byte has a learned vector, beside it a mark that tells whether the last four bytes have occurred
up to LAGS bytes before. FILTERS learned filters of WIDTH bytes slide over the whole text. The text is
covered by chunks of 256 bytes that overlap by half; each filter is max-pooled over a chunk, and the
chunks' maxima are combined, by their mean and their maximum over the text, into one probability.
Long texts go through in pieces with enough bytes on either side to give the same result as in one.

Fitted by gradient descent on a bounded sample (PER_CLASS rows of MAX_BYTES at most) with a fixed seed.
Defined cases: a null or empty text is one empty chunk; with no labelled rows of both classes every
text scores the share of the one class seen, 0.5 if none; repeated rows score alike; columns other
than doc_id and text are not read, and left alone by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, plus, utf8

#: Bounds of the sample: rows of each label, and bytes of a text.
PER_CLASS, MAX_BYTES = {0: 800, 1: 800}, 1 << 13
VECTOR, WIDTH, STRIDE, FILTERS, LAGS = 6, 8, 4, 12, range(4, 49)
BLOCK, CHUNK_BLOCKS, HOP_BLOCKS = 64, 4, 2
#: Bytes that go through the filters at once.
PIECE = 1 << 19
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.3


class Net:
    """Parameters and passes of the network."""

    def __init__(self, prior: float = 0.5):
        rng, channels = np.random.default_rng(7), VECTOR + 1
        self.p = {
            "vector": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32), "filter": rng.normal(0, 0.2, (FILTERS, WIDTH, channels)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32), "dense": np.zeros(2 * FILTERS, np.float32), "rest": np.zeros(1, np.float32)}
        prior = min(max(prior, 0.01), 0.99)
        self.p["rest"][:] = np.log(prior / (1 - prior))

    def inputs(self, data: np.ndarray) -> np.ndarray:
        """Vectors of the bytes and the mark of recurrence; a zero byte is padding."""
        code = np.zeros(len(data), np.uint32)
        for k in range(4):
            code[3:] |= data[3 - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
        again = np.zeros(len(data), bool)
        for lag in LAGS:
            again[lag:] |= code[lag:] == code[:-lag]
        x = np.empty((len(data), VECTOR + 1), np.float32)
        x[:, :VECTOR] = self.p["vector"][data]
        x[:, VECTOR] = again
        x[data == 0] = 0
        return x

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at each place: the sum of what the two halves of the window give."""
        half = self.p["filter"].reshape(FILTERS, 2, -1)
        steps = x.reshape(len(x) // STRIDE, -1)
        first, second = steps @ half[:, 0].T, steps @ half[:, 1].T
        first[:-1] += second[1:]
        return first + self.p["bias"]

    def layout(self, pieces: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces one after another, each from a block's start and with a block of padding behind; the blocks that count."""
        rows, own, at = [], [], 0
        for data, skip, size in pieces:
            blocks = max(1, -(-len(data) // BLOCK)) + 1
            rows.append(data.ljust(blocks * BLOCK, b"\0"))
            own.append(np.arange(at + skip, at + skip + size))
            at += blocks
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(own)

    def maxima(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of every block of every text, and each text's first block."""
        out, waiting, size, counts = [], [], 0, []

        def flush():
            nonlocal waiting, size
            if waiting:
                data, own = self.layout(waiting)
                y = self.convolve(self.inputs(data))
                out.append(np.maximum(y.reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1), 0)[own])
                waiting, size = [], 0

        for text in texts:
            blocks = max(1, -(-len(text) // BLOCK))
            counts.append(blocks)
            for at in range(0, blocks, PIECE // BLOCK):
                n, skip = min(PIECE // BLOCK, blocks - at), min(at, 1)
                waiting.append((text[(at - skip) * BLOCK : (at + n + 1) * BLOCK], skip, n))
                size += n * BLOCK
                if size >= PIECE:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32), np.r_[0, np.cumsum(counts)].astype(np.int64)

    @staticmethod
    def chunks(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of each chunk (the last repeated at a text's end), and each text's first chunk."""
        n = np.diff(begin)
        count = np.maximum(1, -(-(n - CHUNK_BLOCKS) // HOP_BLOCKS) + 1)
        first = np.r_[0, np.cumsum(count)]
        start = np.repeat(begin[:-1], count) + HOP_BLOCKS * (np.arange(first[-1]) - np.repeat(first[:-1], count))
        return np.minimum(start[:, None] + np.arange(CHUNK_BLOCKS), np.repeat(begin[1:] - 1, count)[:, None]), first

    def combine(self, top: np.ndarray, begin: np.ndarray):
        """Probabilities, and what the backward pass needs."""
        member, first = self.chunks(begin)
        pooled = top[member].max(axis=1)
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
        most = np.maximum.reduceat(pooled, first[:-1], axis=0)
        full = np.concatenate([mean, most], axis=1)
        z = full @ self.p["dense"] + self.p["rest"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40))), (member, first, pooled, most, full)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.combine(*self.maxima(texts))[0]

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        blocks = [max(1, -(-len(t) // BLOCK)) for t in texts]
        data, own = self.layout([(t, 0, n) for t, n in zip(texts, blocks)])
        begin = np.r_[0, np.cumsum(blocks)].astype(np.int64)
        x = self.inputs(data)
        out = self.convolve(x).reshape(-1, BLOCK // STRIDE, FILTERS)[own]
        place, top = out.argmax(axis=1), np.maximum(out.max(axis=1), 0)
        p, (member, first, pooled, most, full) = self.combine(top, begin)
        d = ((p - y) / len(y)).astype(np.float32)
        back = d[:, None] * self.p["dense"]
        text = np.repeat(np.arange(len(y)), np.diff(first))
        g = back[text, :FILTERS] / np.diff(first)[text, None]
        peak = pooled == most[text]
        ties = np.add.reduceat(peak.astype(np.float32), first[:-1], axis=0)
        g = g + np.where(peak, back[text, FILTERS:] / ties[text], 0)
        which = member[np.arange(len(member))[:, None], top[member].argmax(axis=1)]
        on_block = np.zeros_like(top)
        np.add.at(on_block, (which, np.arange(FILTERS)), g)
        on_block[top <= 0] = 0
        block, f = np.nonzero(on_block)
        g = on_block[block, f]
        start = own[block] * BLOCK + place[block, f] * STRIDE
        at = np.minimum(start[:, None] + np.arange(WIDTH), len(data) - 1)
        seen = x[at]
        weighted, filters = g[:, None, None] * seen, np.zeros_like(self.p["filter"])
        to_byte = (g[:, None, None] * self.p["filter"][f])[:, :, :VECTOR].reshape(-1, VECTOR)
        for k in range(FILTERS):
            filters[k] = weighted[f == k].sum(axis=0)
        ids = data[at].ravel()
        vectors = np.stack([np.bincount(ids, to_byte[:, c], 256) for c in range(VECTOR)], axis=1)
        vectors[0] = 0
        return {"vector": vectors, "filter": filters, "bias": np.bincount(f, g, FILTERS), "dense": full.T @ d, "rest": np.array([d.sum()])}


def fit(texts: list[bytes], labels: list[int]) -> Net:
    y = np.array(labels, np.float64)
    net = Net(float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        return net
    rng, step = np.random.default_rng(11), 0
    first, second = ({k: np.zeros(v.shape) for k, v in net.p.items()} for _ in range(2))
    total = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick, step = order[at : at + BATCH], step + 1
            rate = RATE * (1 - (step - 1) / total) + RATE / 50
            for k, g in net.gradients([texts[i] for i in pick], y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score and predicted."""
    docs = docs.select("doc_id", "text")
    schema = plus(docs.select("doc_id"), score="double", predicted="int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = net.score(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema.names)

    return arrow_pass(docs, run, schema)


def keep_good(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(net.score(utf8(b.column("text"))) >= THRESHOLD))

    return arrow_pass(docs, run, docs.schema)
