import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import kdtree_shards as kd
from tests.llm.data import awkward, documents, rng, text


def brute(points, weights, target):
    """Leaves as sets of rows, from left to right: the same rule, recursively and in memory."""
    if not len(points):
        return []
    full = points.max(0) - points.min(0)

    def split(rows):
        p, w = points[rows], weights[rows]
        width = p.max(0) - p.min(0)
        share = [width[i] / full[i] if full[i] else 0 for i in range(3)]
        if w.sum() <= target or not width.any():
            return [frozenset(rows.tolist())]
        dim = share.index(max(share)) if max(share) > 0 else 3
        x = p[:, dim]
        if dim == 3:
            size = 1
            while (x.max() - x.min()) // size >= 2**16:
                size *= 2
            x = (x - x.min()) // size
        cut = min(np.unique(x)[:-1], key=lambda v: (abs(2 * int(w[x <= v].sum()) - int(w.sum())), v))
        return split(rows[x <= cut]) + split(rows[x > cut])

    return split(np.arange(len(points)))


def points_of(docs):
    rows = docs.select("doc_id", *(c.alias(n) for n, c in kd.coordinates().items()), kd.weight().alias("w")).orderBy("doc_id").collect()
    return np.array([[x[d] for d in kd.DIMS] for x in rows], np.int64), np.array([x["w"] for x in rows], np.int64)


@pytest.mark.parametrize("local, leaves", [(1 << 17, 1 << 20), (20, 1 << 20), (20, 3)])
@pytest.mark.parametrize("target", [500, 3000, 10**9])
def test_equals_brute_force(spark, target, local, leaves, monkeypatch):
    monkeypatch.setattr(kd, "LOCAL_POINTS", local)
    monkeypatch.setattr(kd, "BROADCAST_LEAVES", leaves)
    r = rng(4)
    docs = documents(spark, [(i, text(r, r.randint(1, 60)), r.choice(["en", "fr"]), f"s{r.randint(0, 4)}", 1) for i in range(120)] + [(120 + i, f"{i:02} same size", "en", "s1", 1) for i in range(60)])
    want = brute(*points_of(docs), target)
    out = kd.shard(spark, docs, target_bytes=target, least_shards=1)
    got = {}
    for x in out.collect():
        got.setdefault(x["shard"], set()).add(x["doc_id"])
    assert [frozenset(got[k]) for k in sorted(got)] == want and sorted(got) == list(range(len(want)))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_brute_force(spark, sf):
    from ledgerweave.llm import queries

    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    points, w = points_of(docs)
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    want = [{ids[i] for i in leaf} for leaf in brute(points, w, min(16 << 20, -(-int(w.sum()) // 32)))]
    got = {}
    for x in queries.op8_kdtree_shards(spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(x["shard"], set()).add(x["doc_id"])
    assert [got[k] for k in sorted(got)] == want and len(want) >= 16


def test_metadata_are_split_before_rows(spark):
    """Shards hold few sources and languages; the row hash comes last."""
    r = rng(6)
    docs = documents(spark, [(i, text(r, 50), r.choice(["en", "fr"]), f"s{i % 8}", 1) for i in range(400)])
    out = kd.shard(spark, docs, target_bytes=4_000, least_shards=1)
    kinds = out.groupBy("shard").agg(F.countDistinct("source").alias("s"), F.countDistinct("lang").alias("l")).collect()
    assert len(kinds) > 8 and np.mean([x["s"] for x in kinds]) <= 3 and np.mean([x["l"] for x in kinds]) <= 1.2


def test_sizes(spark):
    r = rng(5)
    docs = documents(spark, [text(r, r.randint(5, 80)) for _ in range(400)])
    target = 8000
    sizes = kd.shard(spark, docs, target_bytes=target, least_shards=1).groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert max(x["b"] for x in sizes) <= target
    assert np.mean([x["b"] for x in sizes]) > target / 3


def test_rows_of_one_point_stay_together(spark):
    docs = documents(spark, [(1, "the same row", "en", "s", 1)] * 20 + [(2, "another", "en", "s", 1)])
    out = kd.shard(spark, docs, target_bytes=10, least_shards=1).groupBy("shard").agg(F.countDistinct("doc_id").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted((r["n"], r["rows"]) for r in out) == [(1, 1), (1, 20)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = kd.shard(spark, docs, target_bytes=1000)
    assert out.count() == docs.count() and sorted(out.columns) == sorted(docs.columns)
    assert kd.shard(spark, docs.where("false")).count() == 0
