import numpy as np
import pytest

from ledgerweave.llm import suffix_decontam as sd
from tests.llm.data import awkward, documents, rng, text, word


def brute(docs, items, min_words, least):
    """(doc, item) -> length of the longest common run of words, if it's long enough."""
    out = {}
    split = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    for d, t in enumerate(docs):
        for i, b in enumerate(items):
            x, y = split(t), split(b)
            best, row = 0, [0] * (len(y) + 1)
            for a in x:
                new = [0] * (len(y) + 1)
                for j, c in enumerate(y):
                    if a == c:
                        new[j + 1] = row[j] + 1
                        best = max(best, new[j + 1])
                row = new
            if len(y) >= least and best >= min(min_words, len(y)):
                out[d, i] = best
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", 700)
    r = rng(seed)
    few = [word(r) for _ in range(6)]
    items = [text(r, r.randint(3, 30)) for _ in range(8)] + [" ".join(r.choice(few) for _ in range(r.randint(4, 25))) for _ in range(6)]
    docs = []
    for _ in range(40):
        own = text(r, r.randint(0, 40)).split()
        for _ in range(r.randint(0, 2)):
            x = r.choice(items).split()
            a = r.randrange(len(x))
            own[len(own) // 2 : len(own) // 2] = [w.upper() + r.choice(["", ",", " -"]) for w in x[a : a + r.randint(1, 25)]]
        docs.append(" ".join(own) + " " + " ".join(r.choice(few) for _ in range(r.choice([0, 10]))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in sd.contaminated(spark, documents(spark, docs), bench, min_words=6, least_words=4).collect()}
    want = brute(docs, items, 6, 4)
    assert {k: x["words"] for k, x in got.items()} == want
    split = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    for (d, i), x in got.items():
        assert split(docs[d])[x["doc_word"] : x["doc_word"] + x["words"]] == split(items[i])[x["item_word"] : x["item_word"] + x["words"]]
    clean = {x["doc_id"] for x in sd.decontaminated(spark, documents(spark, docs), bench, min_words=6, least_words=4).collect()}
    assert clean == set(range(40)) - {d for d, _ in want}


def test_suffix_array_is_sorted():
    g = np.random.default_rng(2)
    for n in (1, 2, 500):
        tokens = g.integers(0, 4, n).astype(np.uint64)
        for depth in (2, 5, 64):
            a = sd.SuffixArray(tokens, depth)
            keys = [tuple(tokens[i : i + depth].tolist()) for i in a.sa]
            assert sorted(a.sa.tolist()) == list(range(n)) and keys == sorted(keys)
    assert len(sd.SuffixArray(np.zeros(0, np.uint64), 5).sa) == 0


def test_benchmark_in_portions(spark, monkeypatch):
    r = rng(9)
    items = [text(r, 20) for _ in range(5)]
    docs = documents(spark, [items[i] + " more words" for i in range(5)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 200)
    assert len(sd.benches(bench, 13, 5)) > 1
    assert sorted((x["doc_id"], x["item_id"]) for x in sd.contaminated(spark, docs, bench).collect()) == [(i, i) for i in range(5)]
    assert sd.decontaminated(spark, docs, bench).count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(0, None), (1, ""), (None, "same text of some words"), (2, "no id"), (3, "another TEXT under that id")], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = sd.contaminated(spark, docs, bench).collect()
    assert sorted((r["doc_id"], str(r["item_id"]), r["words"]) for r in got) == [(5, "3", 5), (5, "None", 5), (5, "None", 5)]
    out = sd.decontaminated(spark, docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count() - 3
    assert sd.contaminated(spark, docs.where("false"), bench).count() == 0
    assert sd.decontaminated(spark, docs, bench.where("false")).count() == docs.count()


def test_query_equals_its_sql(spark):
    from ledgerweave.llm import queries
    from tests.compare import both

    for sf in ("0.001", "0.01"):
        ours, theirs = both(spark, f"/root/testdata/sf{sf}", queries.op5_suffix_decontam, sd.SQL)
        assert ours == theirs and ours


def test_short_items_match_whole_texts_only(spark):
    docs = documents(spark, ["Two, words!", "two words more", "one", "words two", "", "!!"])
    bench = spark.createDataFrame([(0, "two words"), (1, "ONE."), (2, "..."), (3, "two words")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["words"], r["doc_word"], r["item_word"]) for r in sd.contaminated(spark, docs, bench).collect())
    assert got == [(0, 0, 2, 0, 0), (0, 3, 2, 0, 0), (2, 1, 1, 0, 0)]
    assert sorted(r["doc_id"] for r in sd.decontaminated(spark, docs, bench).collect()) == [1, 3, 4, 5]


def repetitive_run():
    import time

    bench = sd.Bench([0, 1], [" ".join(["la"] * 200), "some other item of the benchmark that stands nowhere in this text at all"], 13, 5)
    text = ("la " * 400_000).encode() + b"end"
    began = time.perf_counter()
    out = bench.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return time.perf_counter() - began, np.stack(out).T.tolist()


def test_repetitive_text_is_cheap():
    """1.2 MB of one word against an item of 200 times that word: all pairs of places would be 75 million."""
    import resource
    import subprocess
    import sys

    code = "import resource; from tests.llm.test_suffix_decontam import repetitive_run; base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; s, out = repetitive_run(); print(s, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024, out)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout
    seconds, mb, out = said.split(" ", 2)
    assert out.strip() == "[[0, 0, 200, 0, 0]]" and float(seconds) < 5 and int(mb) < 500, said


def test_many_items():
    """The items of a large benchmark that don't occur cost next to nothing."""
    r = rng(8)
    pool = [word(r) for _ in range(3000)]
    items = [" ".join(r.choices(pool, k=20)) for _ in range(100_000)]
    bench = sd.Bench(list(range(len(items))), items, 13, 5)
    texts = [" ".join(r.choices(pool, k=100)) for _ in range(500)]
    for i in range(0, 500, 50):
        texts[i] += " " + items[i * 200] + " and so on"
    raw = [t.encode() for t in texts]
    doc, item, n, x, y = bench.matches(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    assert sorted(zip(doc.tolist(), item.tolist(), n.tolist(), y.tolist())) == [(i, i * 200, 20, 0) for i in range(0, 500, 50)]


@pytest.mark.parametrize("seed", range(3))
def test_places_of_repetitive_texts(seed, monkeypatch):
    """Length and place of the match, against a search over all pairs of places."""
    monkeypatch.setattr(sd, "STEPS", 20)
    r = rng(seed)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(12)]
    items = [" ".join(r.choice("ab") for _ in range(r.randint(5, 30))) for _ in range(8)] + ["a " * 20, "a b " * 9]
    bench = sd.Bench(list(range(len(items))), items, 6, 5)
    raw = [t.encode() for t in texts]
    got = {(d, i): rest for d, i, *rest in np.stack(bench.matches(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])).T.tolist()}
    want = {}
    for d, t in enumerate(texts):
        for i, b in enumerate(items):
            x, y = t.split(), b.split()
            least = min(6, len(y))
            for p in range(len(x)):
                for s in range(len(y)):
                    k = 0
                    while p + k < len(x) and s + k < len(y) and x[p + k] == y[s + k]:
                        k += 1
                    if k >= least and (-k, p, s) < want.get((d, i), (0,)):
                        want[d, i] = (-k, p, s)
    assert got == {k: [-v[0], v[1], v[2]] for k, v in want.items()}
