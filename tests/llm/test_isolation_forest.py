import numpy as np
import pyarrow as pa
import pytest

from ledgerweave.llm import isolation_forest as iso
from tests.llm.data import awkward, documents, rng, text


def corpus(spark, n=400):
    r = rng(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        t = text(r, r.randint(40, 200))
        if bad:
            t = r.choice([t.upper().replace(" ", "!! "), " | ".join(t.split()), (t.split()[0] + " ") * 90, "".join(w + r.choice([" ### ", "*** "]) for w in t.split())])
        rows.append((i, t))
        labels.append((i, int(not bad), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    known = labels.where("doc_id % 20 < 15")
    kept = {r["doc_id"] for r in iso.kept(spark, docs, known, lose=0.02).collect()}
    held = [r for r in labels.where("doc_id % 20 >= 15 or doc_id % 20 = 0").collect()]
    good, bad = [r["doc_id"] in kept for r in held if r["quality"]], [r["doc_id"] in kept for r in held if not r["quality"]]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.3


def test_statistics():
    x = dict(zip(iso.STATS, iso.statistics(pa.array(["one two two two - x!! ABC"]))[0]))
    words, letters = 6, 19 - 2
    assert x["adjacent_same"] == pytest.approx(2 / (words + 30))
    assert x["top_word"] == pytest.approx((3 + 30 * 0.06) / (words + 30))
    assert x["lone_marks"] == pytest.approx((1 + 30 * 0.01) / (words + 30))
    assert x["mark_words"] == pytest.approx((1 + 30 * 0.12) / (words + 30))
    assert x["bigram_same"] == pytest.approx((1 + 30 * 0.02) / (words + 30))
    assert 0 < x["upper"] < 1 and letters


def test_statistics_do_not_depend_on_the_batch():
    r = rng(6)
    texts = [text(r, r.randint(1, 50)) for _ in range(40)] + ["", "é", None, "!!", "x\n\nx\n"]
    whole = iso.statistics(pa.array(texts))
    single = np.concatenate([iso.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(whole, single, equal_nan=True)


def test_path_lengths():
    """Scores agree with a walk in plain Python."""
    g = np.random.default_rng(1)
    x = g.normal(size=(300, len(iso.STATS))).astype(np.float32)
    forest = iso.grow(x, 20, 64, 3)
    want = []
    for p in x[:50]:
        total = 0.0
        for t in range(20):
            k = 0
            while forest.stat[t, k] >= 0:
                k = 2 * k + 1 + int(p[forest.stat[t, k]] > forest.cut[t, k])
            total += forest.path[t, k]
        want.append(2 ** (-total / (20 * forest.expected)))
    assert np.allclose(forest.scores(x[:50]), want)
    far = np.full((1, len(iso.STATS)), 50, np.float32)
    assert forest.scores(far)[0] > forest.scores(x).max() - 0.02


def test_calibration():
    score, quality = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.9]), np.array([1, 1, 1, 1, 0, 0])
    assert iso.calibrate(score, quality, 0.0) == 0.4
    assert iso.calibrate(score, np.ones(6), 0.1) > 0.99


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    kept = iso.kept(spark, docs, labels)
    # no labels of both classes: only texts without words go
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [4, 5, 5, 5, 7, None]
    out = iso.keep_normal(spark, docs, labels)
    assert out.count() == 6 and out.columns == [*docs.columns, "__lw_score"]
    assert iso.kept(spark, docs.where("false"), labels).count() == 0
