import itertools
import math

import pytest

from ledgerweave.llm import url_filter as uf
from ledgerweave.llm.common import P
from tests.llm.data import documents, rng, text, word

COUNTS = {"cheap": 50, "pills": 40, "the": 500, "a": 300, "art": 20, "car": 30, "cart": 5, "park": 25, "parks": 3, "spark": 4, "s": 2}


def brute(seg, run):
    """The best of all splits."""
    best = (-math.inf, None)
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        parts, now = [], run[0]
        for c, ch in zip(cuts, run[1:]):
            if c:
                parts.append(now)
                now = ch
            else:
                now += ch
        parts.append(now)
        if all(p in seg.cost or len(p) == 1 for p in parts):
            best = max(best, (sum(seg.cost.get(p, seg.unknown) for p in parts), tuple(parts)))
    return best


def cost(seg, words):
    return sum(seg.cost[w] if w in seg.cost else seg.unknown * len(w) for w in words)


@pytest.mark.parametrize("run", ["cheappills", "thecarpark", "acartparks", "sparkart", "xcarx", "qqq", "theart", "a", "carsparks"])
def test_viterbi_finds_the_best_split(run):
    seg = uf.Segmenter(COUNTS)
    words = seg.split(run)
    assert "".join(words) == run and cost(seg, words) == pytest.approx(brute(seg, run)[0])


def test_parts():
    assert uf.parts("https://www.cheap-pills.example.com/en/12.html?a=b#top") == (["cheap", "pills"], ["en", "12", "html", "a", "b"])
    assert uf.parts("http://user@m.host.co.uk:80/x") == (["host"], ["x"])
    assert uf.parts("host") == (["host"], []) and uf.parts(None) == ([], []) and uf.parts("") == ([], []) and uf.parts("com") == (["com"], [])


def test_naive_bayes(spark):
    """Counts, smoothing, prior and sums by hand."""
    split = spark.createDataFrame([("u", ["x", "y"]), ("v", ["x", "x"]), ("w", ["y", "z"]), ("n", ["q"])], f"{P}url string, {P}tokens array<string>")
    marked = spark.createDataFrame([("u", 0), ("u", 0), ("v", 0), ("w", 1), ("n", None)], f"{P}url string, y int")
    prior, odds = uf.train_bayes(split, marked)
    assert prior == pytest.approx(math.log(1 / 3))
    # times in wanted URLs: x 4, y 2, z 0; in unwanted ones: x 0, y 1, z 1
    want = {"x": math.log((1 / 5) / (5 / 9)), "y": math.log((2 / 5) / (3 / 9)), "z": math.log((2 / 5) / (1 / 9))}
    assert {r["t"]: float(r["o"]) for r in odds.collect()} == pytest.approx(want)
    got = {r[P + "url"]: r[P + "sum"] for r in uf.url_odds(split, odds, 2).collect()}
    assert got == pytest.approx({"u": want["x"] + want["y"], "v": 2 * want["x"], "w": want["y"] + want["z"]})
    assert uf.train_bayes(split, marked.where("y = 0"))[0] == 0 and uf.train_bayes(split, marked.where("y = 0"))[1].count() == 0


def test_labels_from_pages_beat_the_list(spark):
    """Hosts whose words aren't in the list are learnt from what their pages hold, and recognised on pages never seen."""
    from tests.llm.test_isolation_forest import corpus

    docs, labels = corpus(spark, 400)
    r = rng(12)
    fine, foul = ([word(r) + word(r) for _ in range(12)] for _ in range(2))
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        names = foul if bad else fine
        body = text(r, 120)
        rows.append((i, f"http://{r.choice(names)}-{r.choice(names)}.example.com/{i}", "<html><script>x()</script><p>" + (" | ".join(body.split()) if bad else body) + "</p></html>"))
    held = [(1000 + i, f"http://{r.choice(foul if i < 40 else fine)}{r.choice(foul if i < 40 else fine)}.example.org/{i}", None) for i in range(80)]
    pages = spark.createDataFrame(rows + held, "page_id long, url string, html string")
    got = {x["page_id"]: x[P + "keep"] for x in uf.score(spark, pages, docs, quality=labels).where("page_id >= 1000").collect()}
    right = [got[1000 + i] == (i >= 40) for i in range(80)]
    by_list = [i >= 40 for i in range(80) if not any(w in held[i][1] for w in uf.UNWANTED)]
    assert sum(right) / 80 > 0.9 and sum(by_list) / 80 <= 0.5


def test_held_out_hosts(spark):
    """Words learnt from hyphenated hosts are recognised in hosts that run them together."""
    r = rng(8)
    wanted = [word(r) + word(r) for _ in range(40)]
    spammy = ["cheap", "win", "free", "best", "fast"]
    docs = documents(spark, [text(r, 200) + " " + " ".join(spammy * 2) for _ in range(20)])
    urls = [f"https://{r.choice(wanted)}-{r.choice(wanted)}.example.com/en/{i}" for i in range(300)] + [f"http://{r.choice(spammy)}-{r.choice(['casino', 'pills'])}.example.com/{i}" for i in range(80)]
    held = [f"http://{a}{b}.example.com/9" for a in spammy for b in ("casino", "pills")] + [f"http://{a}{b}.example.com/9" for a in spammy for b in spammy]
    fine = [f"https://{r.choice(wanted)}{r.choice(wanted)}.example.org/en/7" for _ in range(30)]
    label = uf.F.when(uf.F.col("page_id") < 1000, uf.seed_label())
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1000 + i, u) for i, u in enumerate(held + fine)], "page_id long, url string")
    got = {x["page_id"]: x[P + "keep"] for x in uf.score(spark, pages, docs, labels=label).collect()}
    caught, lost = [not got[1000 + i] for i in range(len(held))], [not got[1000 + len(held) + i] for i in range(30)]
    assert sum(caught) / len(caught) > 0.9 and sum(lost) / len(lost) < 0.1


def test_all_words_of_urls_count(spark):
    """However many words the documents have, a rare one that stands in a URL is known; so are the words of `unwanted`."""
    r = rng(4)
    docs = documents(spark, [" ".join(["the ware cheap"] * 50), "zebrafish zebrafish", *(text(r, 300) for _ in range(5))])
    urls = ["http://cheapzebrafish.example.com/", "http://thewarez.example.com/zebrafishcheap", "http://the-cheap.example.com/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seg = uf.train_segmenter(docs, pages)
    assert seg.split("cheapzebrafish") == ("cheap", "zebrafish") and seg.split("thewarez") == ("the", "warez")
    # words that stand in no URL change the costs, but aren't held
    assert set(seg.cost) <= {u[i:j] for u in urls for i in range(len(u)) for j in range(i + 1, len(u) + 1)} and len(seg.cost) < 50
    rows = {x["page_id"]: x for x in uf.score(spark, pages, docs).collect()}
    assert not rows[1][P + "keep"] and rows[0][P + "keep"] and rows[2][P + "keep"]


def test_tokens_that_are_joined_count_alike(spark):
    """The number of tokens that are sent to the tasks doesn't change the result."""
    urls = [f"http://{w}-casino.example.com/{w}x/win/win" for w in ("cheap", "free", "best")] + [f"http://{w}-garden.example.com/{w}y/read" for w in ("green", "old", "new")] * 2 + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    docs = documents(spark, ["garden read garden read win win"])
    want, *others = [{r["page_id"]: (r[P + "log_odds"], r[P + "keep"]) for r in uf.score(spark, pages, docs, features=f).collect()} for f in (200_000, 3, 0)]
    assert not want[0][1] and want[3][1] and len(want) == len(urls)
    for got in others:
        assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "http://a.example.com/"), (3, "not a url at all"), (4, "http://" + "longname" * 500 + ".com/"), (5, "http://casino.com/x"), (5, "http://casino.com/x"), (6, "http://ü.example/漢字?\n")], "page_id long, url string").selectExpr("*", "1 AS tokens", "'h' AS host", "2 AS y", "3 AS keep")
    docs = documents(spark, ["long name words long name", None, ""])
    out = uf.score(spark, pages, docs)
    rows = out.collect()
    assert len(rows) == pages.count() and out.columns == [*pages.columns, P + "tokens", P + "log_odds", P + "keep"]
    assert len({r[P + "log_odds"] for r in rows if r["page_id"] == 5}) == 1
    assert [list(r[P + "tokens"]) for r in rows if r["page_id"] in (1, 2)] == [[], []]
    assert uf.score(spark, pages.where("false"), docs).count() == 0
    none = uf.score(spark, pages.where("page_id < 3"), docs.where("false")).collect()
    assert {(r[P + "log_odds"], r[P + "keep"]) for r in none} == {(0.0, True)}
