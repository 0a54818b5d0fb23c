from collections import defaultdict

import numpy as np
import pyarrow as pa

from ledgerweave.llm import simhash_forest as sf
from tests.llm.data import awkward, documents, rng, text


def corpus(seed=1, n=300):
    r = rng(seed)
    texts = [text(r, r.randint(80, 300)) for _ in range(n)]
    for _ in range(n):
        w = r.choice(texts).split(" ")
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice(["changed", "other", ""])
        texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


def brute(texts, limit):
    """Components of all pairs within the limit."""
    fp, _ = sf.fingerprint_array(pa.array(texts), np.arange(len(texts), dtype=np.int64))
    d = sf.distances(fp, fp)
    return sf.local_roots(len(texts), *np.nonzero(d <= limit)), d


def test_recall_against_all_pairs(spark):
    texts = corpus()
    docs = documents(spark, texts)
    root, d = brute(texts, 56)
    found = {r["doc_id"]: r["duplicate_of"] for r in sf.duplicates(spark, docs, leaf=8, short_distance=56).collect()}
    same = {i: found.get(i, i) for i in range(len(texts))}
    pairs = [(i, j) for i, j in zip(*np.nonzero(d <= 56)) if i < j]
    assert len(pairs) > 200
    assert np.mean([same[i] == same[j] for i, j in pairs]) >= 0.9
    # nothing beyond the components of close pairs
    assert all(root[i] == root[k] for i, k in same.items())


def test_copies_go_and_one_stays(spark):
    r = rng(5)
    base = [text(r, 150) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:10])] + [(200 + i, t + " and a few more words") for i, t in enumerate(base[:10])] + [(300, base[0])] * 30
    docs = documents(spark, rows)
    kept = sf.keep_one(spark, docs)
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(20)) and kept.columns == docs.columns
    groups = defaultdict(set)
    for x in sf.duplicates(spark, docs).collect():
        groups[x["duplicate_of"]].add(x["doc_id"])
    assert groups[0] == {100, 200, 300} and groups[9] == {109, 209}


def test_dense_groups_keep_their_components(monkeypatch):
    g = np.random.default_rng(3)
    base = g.integers(0, 2**63, (3, sf.LANES), dtype=np.uint64)
    fp = base[g.integers(0, 3, 500)]
    flips = g.integers(0, 64, 500)
    fp[:, 0] ^= np.uint64(1) << flips.astype(np.uint64)
    limit = np.full(500, 20, np.uint16)
    want = sf.local_roots(500, *sf.close_pairs(fp, limit))
    monkeypatch.setattr(sf, "DENSE", 50)
    a, b = sf.close_pairs(fp, limit)
    assert (sf.local_roots(500, a, b) == want).all() and len(a) < 2000


def test_climbing_compares_the_nodes_that_a_descent_would_end_in():
    """Components of a subtree: those of all pairs within the maximal nodes of at most `leaf`, or at the depth of the recall."""
    g = np.random.default_rng(5)
    for depth, base, leaf in ((6, 2, 8), (9, 5, 4), (3, 0, 16), (1, 0, 4)):
        n = 400
        fp = g.integers(0, 2**63, (40, sf.LANES), dtype=np.uint64)[g.integers(0, 40, n)]
        for _ in range(10):
            fp[np.arange(n), g.integers(0, 4, n)] ^= np.uint64(1) << g.integers(0, 63, n).astype(np.uint64)
        key = np.ascontiguousarray(np.packbits(np.unpackbits(fp.view(np.uint8), axis=1)[:, g.permutation(256)[:32]], axis=1)).view(">u4")[:, 0].astype(np.uint32)
        key = key >> np.uint32(base) if base else key  # share `base` bits
        limit, v = np.full(n, 16, np.uint16), g.permutation(n).astype(np.int64)
        a, b, todo = [], [], [(np.arange(n), base)]
        while todo:
            rows, d = todo.pop()
            if len(rows) > leaf and d < depth:
                bit = (key[rows] >> np.uint32(31 - d)) & 1
                todo += [(rows[bit == 0], d + 1), (rows[bit == 1], d + 1)]
            elif len(rows) > 1:
                x, y = sf.close_pairs(fp[rows], limit[rows])
                a.append(rows[x])
                b.append(rows[y])
        want = sf.local_roots(n, np.concatenate(a), np.concatenate(b))
        x, y = sf.tree_edges(v, key, fp, limit, base, depth, leaf)
        back = np.argsort(v)
        got = sf.local_roots(n, back[x], back[y])
        assert (got == want).all() and len(set(want.tolist())) < n


def test_hot_subtrees_are_searched_in_parts(spark, monkeypatch):
    texts = corpus(7, 120)
    docs = documents(spark, texts)
    want = sorted((r["doc_id"], r["duplicate_of"]) for r in sf.duplicates(spark, docs, short_distance=56).collect())
    monkeypatch.setattr(sf, "HOT", 32)
    assert sorted((r["doc_id"], r["duplicate_of"]) for r in sf.duplicates(spark, docs, short_distance=56).collect()) == want and len(want) > 50


def test_plan_meets_its_recall():
    for n in (10, 10**4, 10**7, 10**10):
        depth, trees = sf.plan(n, 256, 0.95, 40)
        assert 1 - (1 - (1 - 40 / sf.BITS) ** depth) ** trees >= 0.95 and depth <= 32


def test_recall_holds_for_all_accepted_distances(spark, monkeypatch):
    """The forest that decisions() asks for finds pairs at the greatest distance it accepts, whatever the size."""
    asked, plan = [], sf.plan
    monkeypatch.setattr(sf, "plan", lambda n, *more: asked.append(more) or plan(n, *more))
    docs = documents(spark, ["one text", "another text"])
    for most, short in ((56, 44), (20, 30)):
        sf.duplicates(spark, docs, max_distance=most, short_distance=short)
    sf.duplicates(spark, docs)
    for more, most in zip(asked, (56, 30, 56), strict=True):
        for n in (10**4, 10**7, 10**10):
            depth, trees = plan(n, *more)
            assert 1 - (1 - (1 - most / sf.BITS) ** depth) ** trees >= 0.95


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(101, 100), (102, 100)], "u long, v long")
    got = {r["v"]: r["c"] for r in sf.components(spark, links).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = sf.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # of the repeated row one stays; null texts are nobody's copies
    assert ids.count(5) == 2 and ids.count(None) == 2 and ids.count(1) == 1 and len(ids) == docs.count() - 1
    assert [(r["doc_id"], r["duplicate_of"]) for r in sf.duplicates(spark, docs).collect()] == [(5, 5)]
    assert sf.keep_one(spark, docs.where("false")).count() == 0
