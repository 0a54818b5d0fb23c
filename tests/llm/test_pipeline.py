import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import byte_cnn, queries, simhash_forest
from ledgerweave.llm.common import shared_dir
from tests.llm import test_kdtree_shards, test_mixing
from tests.llm.data import awkward, rng, text

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"] and cp.ORACLE_SQL is None


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.columns == [*docs.columns, "shard"] and out.count() > 0
    assert out.groupBy("text").count().where("count > 1").count() == 0
    assert out.where(F.col("doc_id").isin([r["doc_id"] for r in queries.op5_suffix_decontam(spark, SF).collect()])).count() == 0


def test_stages_live_with_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns), name
        assert out.count() <= docs.count()
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0, name


def test_planted_documents(spark):
    """Copies and passages planted among the documents of the table go, clean ones stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first()["text"]
    r = rng(11)
    clean = [text(r, 150) for _ in range(6)]
    rows = [(10_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(clean)]
    rows += [(20_000, clean[0], "en", "src1", 1), (20_001, clean[1] + " one more", "en", "src1", 1), (20_002, clean[2][:200] + " " + item + " " + clean[3][:200], "en", "src1", 1)]
    out = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for stage in (cp.near_dedup, cp.decontaminate):
        out = stage(spark, out, SF)
    ids = {x["doc_id"] for x in out.where("doc_id >= 10000").collect()}
    assert ids == set(range(10_000, 10_006))


def probability(net, t):
    """The classifier's probability of one text, chunk by chunk and place by place."""
    raw, width = np.frombuffer(t.encode(), np.uint8), len(net.filters)
    last = max(0, len(raw) - net.chunk)
    starts = [min(i * (net.chunk - net.overlap), last) for i in range(1 + -(-last // (net.chunk - net.overlap)))]
    scores = []
    for a in starts:
        piece = raw[a : a + net.chunk]
        at = np.arange(len(piece) - width + 1)
        pooled = np.maximum(sum(net.filters[k, piece[at + k]].astype(np.float64) for k in range(width)).max(0) + net.bias, 0)
        short = np.log2(len(piece) / net.chunk) / 4
        scores.append(float(np.r_[pooled, pooled * short, short] @ net.weight + net.offset))
    return 1 / (1 + np.exp(-(net.combine[0] * np.mean(scores) + net.combine[1] * max(scores) + net.combine[2])))


def grams(t, n):
    w = "".join(c.lower() if c.isalnum() else " " for c in t).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def brute(spark, docs, labels, bench):
    """Shards as sets of doc_ids, from the first to the last, and what each stage but the last drops."""
    rows, dropped = {r["doc_id"]: r["text"] for r in docs.collect()}, []

    def drop(ids):
        dropped.append(set(ids))
        for d in ids:
            del rows[d]

    net = byte_cnn.fit(docs, labels)
    p = {d: probability(net, t) for d, t in rows.items()}
    assert min(abs(x - net.threshold) for x in p.values()) > 1e-5
    drop([d for d, x in p.items() if x < net.threshold])

    ids = sorted(rows)
    fp, features = simhash_forest.fingerprint_array(pa.array([rows[d] for d in ids]), np.array(ids, np.int64))
    limit = np.where(features < simhash_forest.SHORT, 44, 56)
    group = {d: d for d in ids}
    for i in range(len(ids)):
        for j in range(i):
            if sum(int(a ^ b).bit_count() for a, b in zip(fp[i].tolist(), fp[j].tolist())) <= min(limit[i], limit[j]):
                a, b = sorted((group[ids[i]], group[ids[j]]))
                group = {d: a if g == b else g for d, g in group.items()}
    drop([d for d in ids if group[d] != d])

    items = [r["text"] for r in bench.collect() if r["text"]]
    sizes = {t: grams(t, 1)[1] for t in items}
    for_size = {}
    for t, n in sizes.items():
        if n >= 5:
            for_size.setdefault(min(13, n), set()).update(grams(t, min(13, n))[0])
    whole = {next(iter(grams(t, n)[0])) for t, n in sizes.items() if 0 < n < 5}
    drop([d for d, t in rows.items() if any(grams(t, n)[0] & own for n, own in for_size.items()) or (0 < (k := grams(t, 1)[1]) < 5 and grams(t, k)[0] & whole)])

    left = docs.where(F.col("doc_id").isin(list(rows)))
    mixture, _ = test_mixing.brute(left)
    drop([d for d in rows if d not in mixture])
    left = left.where(F.col("doc_id").isin(list(rows)))
    points, w = test_kdtree_shards.points_of(left)
    ids = sorted(rows)
    return [{ids[i] for i in leaf} for leaf in test_kdtree_shards.brute(points, w, min(16 << 20, -(-int(w.sum()) // 32)))], dropped


def planted(spark, folder):
    """The tables of SF with copies, near copies and passages of the benchmark among the documents, in a folder."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    r = rng(12)
    own = [x["text"] for x in docs.orderBy("doc_id").limit(40).collect()]
    items = [x["text"] for x in bench.where("length(text) > 150").orderBy("item_id").limit(5).collect()]
    texts = own[:10] + [t + " and one word more" for t in own[10:20]] + [f"{own[20 + i]} {t} {own[30 + i]}" for i, t in enumerate(items)]
    texts += [own[0]] * 60  # a hot group of copies in a hot source
    rows = [(100_000 + i, t, "en", "hot" if i >= 25 else f"src{r.randrange(5)}", len(t)) for i, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")


def test_run_equals_brute_force(spark, tmp_path):
    planted(spark, tmp_path)
    docs, labels, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    want, dropped = brute(spark, docs, labels, bench)
    got = {}
    for x in cp.run(spark, str(tmp_path)).select("doc_id", "shard").collect():
        got.setdefault(x["shard"], []).append(x["doc_id"])
    assert [set(got[k]) for k in sorted(got)] == want and sorted(got) == list(range(len(want)))
    assert sum(map(len, got.values())) == sum(map(len, want)) and len(want) >= 16
    assert all(dropped), "every stage has something to drop"


@pytest.mark.parametrize("empty", [False, True])
def test_run_lives_with_awkward_tables(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows and clashing names, or no rows at all, through all stages in turn."""
    docs = awkward(spark)
    (docs.where("false") if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        own = spark.read.parquet(f"{SF}/{t}.parquet")
        (own.where("false") if empty else own).write.parquet(f"{tmp_path}/{t}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert set(out.columns) == set(docs.columns)  # docs has a column `shard` of its own, which is replaced
    ids = [x["doc_id"] for x in out.collect()]
    assert len(ids) == 0 if empty else 0 < len(ids) <= docs.count() and ids.count(5) <= 2


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
