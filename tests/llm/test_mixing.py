from collections import Counter

import numpy as np
import pytest

from ledgerweave.llm import mixing
from ledgerweave.llm.common import P
from tests.llm.data import awkward, documents


def test_quotas():
    q = mixing.quotas({"a": 1000, "b": 100}, {"a": 1, "b": 1})
    assert q == {"a": 100, "b": 100}
    assert mixing.quotas({"a": 1000, "b": 100}, {"a": 2, "b": 1}) == {"a": 200, "b": 100}
    assert mixing.quotas({"a": 10, "b": 0}, {"a": 1, "b": 5}) == {"a": 10}
    assert mixing.quotas({"a": 10}, {"b": 1}) == {} and mixing.quotas({}) == {}
    # a source that is next to nothing doesn't bind the others
    assert mixing.quotas({"a": 10_000, "b": 10_000, "c": 1}, {"a": 1, "b": 1, "c": 1}) == {"a": 10_000, "b": 10_000, "c": 1}
    n = {"a": 10_000, "b": 2_500, "c": 900}
    q = mixing.quotas(n)
    assert all(q[s] <= n[s] for s in n) and q["a"] / q["c"] == pytest.approx(100 / 30, rel=0.01) and q["c"] == 900


def test_quotas_are_continuous_in_the_counts():
    """A row more or less of a tiny source changes the other quotas by next to nothing."""
    equal = {f"s{i:02}": 50_000 for i in range(20)}
    kept = []
    for tiny in range(0, 50_001, 25):
        counts = {**equal, "tiny": tiny}
        kept.append(sum(mixing.quotas(counts).values()) / sum(counts.values()))
    assert max(abs(a - b) for a, b in zip(kept, kept[1:])) < 0.002
    assert min(kept[:41]) > 0.99 and min(kept) > 0.8
    # one source or its parts: the same level
    whole, parts = {"a": 900_000, "b": 9_000}, {"a": 900_000, **{f"b{i}": 1_000 for i in range(9)}}
    q, p = mixing.quotas(whole, {"a": 1, "b": 1}), mixing.quotas(parts, {"a": 1, **{f"b{i}": 1 / 9 for i in range(9)}})
    assert abs(q["a"] - p["a"]) <= 1


def test_a_stated_total_is_met():
    n, w = {"a": 1000, "b": 500, "c": 10}, {"a": 1, "b": 1, "c": 2}
    assert mixing.quotas(n, w, total=20) == {"a": 5, "b": 5, "c": 10}
    # what c and then b are short of goes to the others
    assert mixing.quotas(n, w, total=410) == {"a": 200, "b": 200, "c": 10}
    assert mixing.quotas(n, w, total=1310) == {"a": 800, "b": 500, "c": 10}
    assert mixing.quotas(n, w, total=5000) == n and sum(mixing.quotas(n, w, total=0).values()) == 0
    assert sum(mixing.quotas(n, total=777).values()) == 777


def dealt_in_memory(blocks, shards, seed):
    """Shard of every (source, block): the tree walked recursively in memory."""
    out = {}

    def walk(lo, hi, held):
        if hi - lo == 1:
            out.update({(i, b): lo for i, own in enumerate(held) for b in own})
            return
        sizes = np.array([len(x) for x in held])
        some = np.flatnonzero(sizes)
        mid, left = mixing.split(lo, hi, sizes[some], seed)
        take = dict(zip(some.tolist(), left.tolist()))
        walk(lo, mid, [x[: take.get(i, 0)] for i, x in enumerate(held)])
        walk(mid, hi, [x[take.get(i, 0) :] for i, x in enumerate(held)])

    walk(0, shards, [list(range(n)) for n in blocks])
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_tree_deals_every_block_once(spark, shards, monkeypatch):
    blocks = [50, 0, 13, 200]
    monkeypatch.setattr(mixing, "LEVELS", 2)
    got = {}
    for r in mixing.deal(spark, blocks, shards, 3).collect():
        for b in range(r["first"], r["first"] + r["n"]):
            assert (r["i"], b) not in got
            got[r["i"], b] = r["shard"]
    assert got == dealt_in_memory(blocks, shards, 3) and len(got) == 263
    sizes = np.bincount(list(got.values()), minlength=shards)
    assert sizes.max() - sizes.min() <= shards.bit_length()


def brute(docs):
    """Shard of every doc_id in the mixture: quotas, permutation, blocks and dealing, in memory."""
    rows = docs.select("doc_id", "source", mixing.keyed_hash(docs, 17).alias("h"), mixing.rest_hash(docs, 17).alias("g")).collect()
    per = {}
    for r in rows:
        per.setdefault(r["source"], []).append((r["h"] % 2**64, r["g"], r["doc_id"]))
    quota = mixing.quotas({s: len(x) for s, x in per.items()})
    names = sorted(quota)
    shards = max(-(-sum(quota.values()) // 16384), min(16, sum(-(-quota[s] // 16) for s in names)))
    shard = dealt_in_memory([-(-quota[s] // 16) for s in names], shards, 17)
    want = {}
    for i, s in enumerate(names):
        # the buckets follow the hash's leading bits, so the order is that of the unsigned hash by bucket, signed within it
        n = max(1, len(per[s]) // mixing.BUCKET_ROWS)
        order = sorted(per[s], key=lambda x: ((x[0] >> 32) * n >> 32, x[0] - 2**64 if x[0] >= 2**63 else x[0], x[1]))
        want |= {d: shard[i, k // 16] for k, (_, _, d) in enumerate(order[: quota[s]])}
    return want, shards


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_brute_force(spark, sf):
    """The whole query: the mixture, its shards and their order."""
    from ledgerweave.llm import queries

    want, shards = brute(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    out = queries.op7_mixing(spark, f"/root/testdata/sf{sf}").collect()
    assert len(out) == len(want) and {r["doc_id"]: r["shard"] for r in out} == want
    assert len(set(want.values())) == shards >= 16
    assert [(r["shard"], r["place"]) for r in out] == sorted((r["shard"], r["place"]) for r in out)


def test_draws_have_the_right_law():
    own, take = np.array([30, 60, 10]), 40
    draws = np.array([mixing.draw(np.random.default_rng([s, 1]), own, take) for s in range(4000)])
    assert (draws.sum(1) == take).all() and (draws <= own).all()
    mean, var = take * own / 100, take * own / 100 * (1 - own / 100) * 60 / 99
    assert np.abs(draws.mean(0) - mean).max() < 0.15 and np.abs(draws.var(0) / var - 1).max() < 0.12
    big = mixing.draw(np.random.default_rng(1), np.array([10**10, 3 * 10**10]), 10**9)
    assert big.sum() == 10**9 and abs(big[0] - 250_000_000) < 200_000


def test_mixture(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 10 else "small", 1) for i in range(3000)]
    docs = documents(spark, rows)
    out = mixing.mix(spark, docs, weights={"big": 1, "small": 1}, block=8, shard_rows=64, least_shards=1).collect()
    assert Counter(r["source"] for r in out) == {"big": 300, "small": 300}
    assert len({r["doc_id"] for r in out}) == 600
    per = Counter((r[P + "shard"], r["source"]) for r in out)
    shards = {s for s, _ in per}
    assert len(shards) == 10 and max(sum(per[s, x] for x in ("big", "small")) for s in shards) <= 64 + 4 * 8
    again = mixing.mix(spark, docs.repartition(7), weights={"big": 1, "small": 1}, block=8, shard_rows=64, least_shards=1).collect()
    assert sorted((r["doc_id"], r[P + "shard"], r[P + "place"]) for r in out) == sorted((r["doc_id"], r[P + "shard"], r[P + "place"]) for r in again)
    # a random draw, not the first rows
    assert 0.35 < sum(r["doc_id"] < 1500 for r in out) / 600 < 0.65


def test_shuffled_within_shards(spark):
    docs = documents(spark, [(i, f"text {i}", "en", f"s{i % 4}", 1) for i in range(400)])
    out = mixing.shuffled(*mixing.dealt(spark, docs, weights=dict.fromkeys(("s0", "s1", "s2", "s3"), 1), shard_rows=100, least_shards=1)).collect()
    assert len(out) == 400
    runs = [r[P + "shard"] for r in out]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == 3
    assert [r["doc_id"] for r in out] != sorted(r["doc_id"] for r in out)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = mixing.mix(spark, docs, alpha=1.0)
    assert out.count() == docs.count() and out.columns == [*docs.columns, P + "shard", P + "place"]
    assert mixing.mix(spark, docs.where("false")).count() == 0
    assert mixing.mixed_documents(spark, docs, alpha=1.0).columns == docs.columns


def test_rows_that_differ_in_other_columns_only(spark):
    """They don't tie: which of them is drawn doesn't depend on the run."""
    docs = documents(spark, [(1, "a text", "en", "s", i) for i in range(40)] + [(2, "b", "en", "t", 1)] * 5)
    once, again = (sorted((r["doc_id"], r["n_chars"], r[P + "shard"]) for r in mixing.mix(spark, d, total=20, block=2).collect()) for d in (docs, docs.repartition(5)))
    assert once == again and len(once) == 20


def test_many_shards_share_partitions(spark, monkeypatch):
    from ledgerweave.llm import common

    monkeypatch.setattr(common, "MOST_PARTITIONS", 3)
    docs = documents(spark, [(i, f"text {i}", "en", "s", 1) for i in range(400)])
    out = mixing.shuffled(*mixing.dealt(spark, docs, alpha=1.0))
    assert out.rdd.getNumPartitions() == 3
    runs = [r[P + "shard"] for r in out.collect()]
    assert runs == sorted(runs) and len(set(runs)) == 16
