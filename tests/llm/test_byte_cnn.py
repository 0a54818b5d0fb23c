import numpy as np
import pyarrow as pa
import pytest

from ledgerweave.llm import byte_cnn
from tests.llm.data import awkward
from tests.llm.test_isolation_forest import corpus


def net(filters=4, chunk=32, overlap=8):
    g = np.random.default_rng(2)
    return byte_cnn.ByteCnn(g.normal(size=(3, 256, filters)).astype(np.float32), g.normal(size=filters).astype(np.float32), g.normal(size=2 * filters + 1).astype(np.float32), 0.3, np.array([0.4, 0.2, -0.1]), chunk, overlap)


def brute(n, text):
    """The forward pass in plain loops."""
    raw, scores = text.encode(), []
    step, start = n.chunk - n.overlap, 0
    starts = [0] if len(raw) <= n.chunk else [min(i * step, len(raw) - n.chunk) for i in range(1 + -(-(len(raw) - n.chunk) // step))]
    for start in starts:
        piece = raw[start : start + n.chunk]
        if len(piece) < 3:
            return None
        pooled = [max(0.0, max(sum(n.filters[k, piece[p + k], f] for k in range(3)) for p in range(len(piece) - 2)) + n.bias[f]) for f in range(len(n.bias))]
        short = np.log2(len(piece) / n.chunk) / 4
        scores.append(float(np.dot(np.r_[pooled, np.array(pooled) * short, short], n.weight) + n.offset))
    z = n.combine[0] * np.mean(scores) + n.combine[1] * max(scores) + n.combine[2]
    return 1 / (1 + np.exp(-z))


def test_forward_pass():
    n = net()
    texts = ["abc", "x" * 31, "y" * 32, "z é 漢字 " * 4, "words and words " * 20, "tail" * 9]
    assert n.probabilities(pa.array(texts)) == pytest.approx([brute(n, t) for t in texts], abs=1e-5)


def test_gradients_are_those_of_the_loss():
    n = net()
    g = np.random.default_rng(4)
    n.filters, n.bias, n.weight = (x.astype(np.float64) for x in (n.filters, n.bias, n.weight))
    length = np.array([32, 20, 3, 2, 32])
    pieces = g.integers(97, 101, (5, 32)).astype(np.uint8)
    pieces[np.arange(32) >= length[:, None]] = 0
    label, weight = np.array([0.0, 1, 1, 0, 1]), g.uniform(0.5, 2, 5)

    def loss():
        z = n.inputs(n.pooled_at(pieces, length)[0], length) @ n.weight + n.offset
        return float((weight * (np.logaddexp(0, z) - label * z)).sum())

    filters, bias, own, offset = n.gradients(pieces, length, label, weight)
    flat, h = n.filters.reshape(-1, 4), 1e-5
    for value, grad in ((flat, filters), (n.bias, bias), (n.weight, own)):
        spots = list(zip(*np.nonzero(grad)))
        assert len(spots) > 2
        for at in spots[:40]:
            old = value[at]
            value[at] = old + h
            more = loss()
            value[at] = old - h
            less = loss()
            value[at] = old
            assert (more - less) / (2 * h) == pytest.approx(grad[at], rel=1e-3, abs=1e-4)
    n.offset += h
    more = loss()
    n.offset -= 2 * h
    assert (more - loss()) / (2 * h) == pytest.approx(offset, rel=1e-3, abs=1e-4)


def test_pooling_in_rows_equals_pooling_in_texts():
    n = net()
    length = np.array([32, 7, 2, 3, 1])
    data = np.random.default_rng(1).integers(97, 123, 45).astype(np.uint8)
    start = np.r_[0, np.cumsum(length)[:-1]]
    pieces = np.zeros((5, 32), np.uint8)
    for i, (a, k) in enumerate(zip(start, length)):
        pieces[i, :k] = data[a : a + k]
    assert n.pooled_at(pieces, length)[0] == pytest.approx(n.pooled(data, start, length), abs=1e-5)


def test_rows_too_long_for_the_sample_are_passed_over(spark):
    docs, labels = corpus(spark, 200)
    long_ = docs.limit(1).selectExpr("doc_id + 1000000 AS doc_id", "repeat('long words ', 20000) AS text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    both = docs.unionByName(long_.select(*docs.columns))
    marked = labels.unionByName(long_.selectExpr("doc_id", "1 AS quality", "0 AS toxic").select(*labels.columns))
    assert byte_cnn.fit(both, marked, sample_bytes=200_000, epochs=1) is not None
    assert byte_cnn.fit(both, marked, sample_bytes=100, epochs=1) is None


def test_chunks_cover_the_whole_text():
    n = net()
    for size in (1, 31, 32, 33, 56, 57, 500):
        _, start, length = n.chunks(np.array([0, size]))
        seen = np.zeros(size, bool)
        for s, k in zip(start, length):
            seen[s : s + k] = True
        assert seen.all() and (start + length <= size).all()


def test_batches_do_not_matter():
    n = net()
    texts = ["abc def", "", "x" * 1000, "é" * 40, "q"] * 3
    assert np.allclose(n.probabilities(pa.array(texts)), np.concatenate([n.probabilities(pa.array([t])) for t in texts]))


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark, 500)
    kept = {r["doc_id"] for r in byte_cnn.keep_good(spark, docs, labels.where("doc_id % 50 < 40"), epochs=8).collect()}
    held = labels.where("doc_id % 50 >= 40").collect()
    good, bad = [r["doc_id"] in kept for r in held if r["quality"]], [r["doc_id"] in kept for r in held if not r["quality"]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert byte_cnn.keep_good(spark, docs, labels).count() == docs.count()
    n = net()
    out = byte_cnn.score(docs, n)
    by = {r["doc_id"]: r for r in out.where("doc_id in (1, 2, 3)").collect()}
    assert by[1][-1] == 0.0 and by[2][-1] == 0.0 and by[3][-1] > 0
    assert byte_cnn.score(docs.where("false"), n).count() == 0
    assert byte_cnn.fit(docs.where("false"), labels) is None
