"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of `chunk` bytes, each overlapping the one before by `overlap` bytes,
so that the chunks cover the whole document. A filter is a table of one weight for each byte
value and place (so that the byte embedding and the convolution are one lookup); its responses
are max-pooled over the chunk. A linear layer turns the pooled responses of a chunk, and their
products with the logarithm of its length, into one score, and the mean and the maximum of a document's scores are combined into one probability.

Defined results: a null or empty text has no chunk and gets the probability `empty_probability`
(0.0: rejected). Rows with a null doc_id are scored like any other. Repeated rows get equal
probabilities. Labels that are null, or that contradict each other for one doc_id, aren't used.
Without labelled rows of both classes nothing can be learned: every text gets probability 1.0
(nothing is rejected). Columns beside doc_id and text are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import P
from ledgerweave.llm.textnp import slices

BLOCK = 64 << 10


@dataclass
class ByteCnn:
    """filters: width x 256 x number; the rest as in the module's docstring. threshold: the least probability that is kept."""

    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    combine: np.ndarray
    chunk: int
    overlap: int
    threshold: float = 0.5

    def pooled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each chunk, the largest response of every filter, at least 0."""
        width, _, n = self.filters.shape
        out = np.zeros((len(start), n), np.float32)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(start, start[a] + BLOCK)))
            lo, hi = int(start[a]), int((start[a:b] + length[a:b]).max())
            body = data[lo:hi]
            if len(body) < width:
                body = np.concatenate([body, np.zeros(width - len(body), np.uint8)])
            m = len(body) - width + 1
            response = self.filters[0].take(body[:m], axis=0)
            for k in range(1, width):
                response += self.filters[k].take(body[k : k + m], axis=0)
            first = np.minimum(start[a:b] - lo, m - 1)
            last = np.clip(start[a:b] + length[a:b] - lo - width + 1, first + 1, m)
            cuts = np.empty(2 * (b - a), np.int64)
            cuts[::2], cuts[1::2] = first, last
            out[a:b] = np.maximum.reduceat(response, cuts[:-1] if cuts[-1] == m else cuts, axis=0)[::2]
            a = b
        # a chunk shorter than the filters goes on with zero bytes, not with its neighbour
        for i in np.flatnonzero(length < width):
            piece = np.zeros(width, np.int64)
            piece[: length[i]] = data[start[i] : start[i] + length[i]]
            out[i] = self.filters[np.arange(width), piece].sum(0)
        out += self.bias
        return np.maximum(out, 0, out=out)

    def pooled_at(self, pieces: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pooled() of the rows of a byte matrix, all at once, and where in its row each response was. length: bytes of each row
        that count; the rest of it is zero."""
        width, _, n = self.filters.shape
        m = pieces.shape[1] - width + 1
        response = self.filters[0].take(pieces[:, :m], axis=0, mode="clip")
        for k in range(1, width):
            response += self.filters[k].take(pieces[:, k : k + m], axis=0, mode="clip")
        response[np.arange(m) > np.maximum(length - width, 0)[:, None]] = -np.inf
        place = response.argmax(1)
        best = np.take_along_axis(response, place[:, None, :], 1)[:, 0]
        return np.maximum(best + self.bias, 0), place


    def chunks(self, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, length) of every chunk; the last one of a text ends where the text ends."""
        size = np.diff(offs)
        step = self.chunk - self.overlap
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - self.chunk) // step)), 0)
        text = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(number * step, np.maximum(0, size[text] - self.chunk))
        return text, offs[text] + start, np.minimum(self.chunk, size[text])

    def inputs(self, pooled: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What the linear layer sees of a chunk: short chunks have weights of their own."""
        short = np.log2(np.maximum(length, 1) / self.chunk).astype(np.float32)[:, None] / 4
        return np.concatenate([pooled, pooled * short, short], axis=1)

    def gradients(self, pieces: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of the weighted logistic loss of some chunks, see pooled_at(), by filters, bias, weight and offset."""
        width, _, n = self.filters.shape
        pooled, place = self.pooled_at(pieces, length)
        x = self.inputs(pooled, length)
        g = (1 / (1 + np.exp(-np.clip(x @ self.weight + self.offset, -30, 30))) - label) * weight
        up = g[:, None] * (self.weight[:n] + x[:, -1:] * self.weight[n:-1]) * (pooled > 0)
        out, row = np.zeros(width * 256 * n), np.arange(len(pieces))[:, None]
        for k in range(width):
            slot = (pieces[row, place + k].astype(np.int64) + k * 256) * n + np.arange(n)
            out += np.bincount(slot.ravel(), up.ravel(), len(out))
        return out.reshape(-1, n).astype(np.float32), up.sum(0), x.T @ g, float(g.sum())

    def scores(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.inputs(self.pooled(data, start, length), length) @ self.weight + self.offset).astype(np.float64)

    def combined(self, scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Mean and maximum of the scores of each text; 0 where it has none."""
        out = np.zeros((n, 2))
        if len(text):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            own = text[first]
            out[own, 0] = np.add.reduceat(scores, first) / np.diff(np.r_[first, len(text)])
            out[own, 1] = np.maximum.reduceat(scores, first)
        return out

    def probabilities(self, arr: pa.Array, empty_probability: float = 0.0) -> np.ndarray:
        out = np.full(len(arr), empty_probability)
        for i, j, data, offs in slices(arr):
            text, start, length = self.chunks(offs)
            pair = self.combined(self.scores(data, start, length), text, j - i)
            has = np.diff(offs) > 0
            out[i:j][has] = 1 / (1 + np.exp(-np.clip(pair[has] @ self.combine[:2] + self.combine[2], -30, 30)))
        return out


def train(texts: list[str], quality: list[int], *, filters: int = 24, width: int = 5, chunk: int = 256, overlap: int = 32, epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7, keep_recall: float = 0.995) -> ByteCnn | None:
    """Learns filters and weights with Adam on chunks (each has its document's label; a quarter of
    them, drawn anew each time, is cut to a random part), then on a
    fifth of the documents, which the filters haven't seen, the combination and the threshold: the
    largest at which `keep_recall` of their good documents are kept, 0.5 at most."""
    y = np.array(quality, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(held) or y[held].min() == y[held].max() or y[fit].min() == y[fit].max():
        held = fit = order
    net = ByteCnn(rng.normal(0, 0.25, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters + 1).astype(np.float32), 0.0, np.array([1.0, 0.0, 0.0]), chunk, overlap)
    raw = [texts[i].encode() for i in fit]
    offs = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    padded = np.frombuffer(b"".join(raw) + bytes(chunk + width), np.uint8)
    text, start, length = net.chunks(offs)
    label = y[fit][text]
    balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
    flat = net.filters.reshape(-1, filters)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("f", flat), ("b", net.bias), ("w", net.weight))}
    step = 0
    for _ in range(epochs):
        perm = rng.permutation(len(text))
        for at in range(0, len(perm), batch):
            own = np.sort(perm[at : at + batch])
            span = length[own]
            cut = rng.random(len(own)) < 0.25
            span[cut] = np.minimum(span[cut], rng.integers(12, chunk, int(cut.sum())))
            begin = start[own] + rng.integers(0, length[own] - span + 1)
            wide = max(width, int(span.max()))
            pieces = padded[begin[:, None] + np.arange(wide)]
            pieces[np.arange(wide) >= span[:, None]] = 0
            grad_f, grad_b, grad_w, grad_o = net.gradients(pieces, span, label[own], balance[own] / len(own))
            step += 1
            for key, value, grad in (("f", flat, grad_f), ("b", net.bias, grad_b), ("w", net.weight, grad_w + 1e-4 * net.weight)):
                m, v = state[key]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.offset -= rate * grad_o
    arr = pa.array([texts[i] for i in held])
    pairs = []
    for i, j, body, off in slices(arr):
        t, s, n = net.chunks(off)
        pairs.append(net.combined(net.scores(body, s, n), t, j - i))
    pair, goal = np.concatenate(pairs), y[held].astype(np.float64)
    scale = np.maximum(np.abs(pair).mean(0), 1e-6)
    w, design = np.array([1.0, 0.0, 0.0]), np.c_[pair / scale, np.ones(len(pair))]
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= 0.5 * (design.T @ (p - goal) / len(goal) + 1e-4 * w)
    net.combine = w / np.r_[scale, 1.0]
    p = net.probabilities(arr)
    good = np.sort(p[goal > 0])
    net.threshold = min(0.5, float(good[int((1 - keep_recall) * len(good))]) * 0.999)
    return net


def fit(documents: DataFrame, labels: DataFrame, *, rows_per_class: int = 1500, sample_bytes: int = 24 << 20, seed: int = 7, **more) -> ByteCnn | None:
    """Trains on the labelled rows of least hash, at most `rows_per_class` of either class and
    `sample_bytes` of text in all: these two bounds hold for any size of the corpus. A row that doesn't fit is passed over."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2 and q in (0, 1)")
    rank = F.xxhash64(F.lit(seed), "doc_id")
    picked = None
    for q in (0, 1):
        part = own.where(F.col("q") == q).orderBy(rank, "doc_id").limit(rows_per_class).select("doc_id", "q")
        picked = part if picked is None else picked.union(part)
    rows = documents.select("doc_id", "text").where("text is not null and text != ''").join(F.broadcast(picked), "doc_id").select("doc_id", "q", "text").orderBy(rank, "doc_id", "q", F.xxhash64("text")).toLocalIterator()
    texts, quality, size = [], [], 0
    for row in rows:
        n = len(row.text.encode())
        if size + n > sample_bytes:  # passed over, as shorter ones after it may fit
            continue
        size += n
        texts.append(row.text)
        quality.append(row.q)
    return train(texts, quality, seed=seed, **more)


def score(documents: DataFrame, net: ByteCnn | None, column: str = P + "probability") -> DataFrame:
    """All columns of documents, and the probability that each is of good quality."""
    if net is None:
        return documents.withColumn(column, F.lit(1.0))
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probabilities(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, column])

    return documents.mapInArrow(run, schema)


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, with `__lw_probability`."""
    net = fit(documents, labels, **more)
    return score(documents, net).where(F.col(P + "probability") >= (net.threshold if net else 0.0))
