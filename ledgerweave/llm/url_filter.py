"""URL filter: host word segmentation and naive Bayes.

The labels of a host name (without a leading www, m or blog, and without its public suffix) are split at
everything that isn't a letter; what remains, often several words run together, is split by Viterbi
into the words of greatest total probability under a unigram model. Words in paths and queries are
split the same way; runs of digits become one token. A multinomial naive Bayes model over these
tokens, host and path apart, gives the log odds that a URL is unwanted. Every distinct URL is split once.

Training: the unigram model counts the words of all documents and the separate letter runs of all URLs, without those seen less
than `seldom` times; the words of `unwanted` are always among them. A word has at most LONGEST letters; longer runs of letters
are words run together. Of the words counted, the model holds those that
occur anywhere in a letter run of a URL: no other can take part in a split. Naive Bayes is trained on all URLs that carry a label.
Labels come from what the pages hold: a byte-level classifier, trained on the documents with known quality, judges the
text of each page, and one that it rejects marks its URL as unwanted, any other as wanted. A URL whose host has a word of
`unwanted` is labelled unwanted whatever its page. Without known qualities or pages' html, that list alone gives the labels, and every
other URL with a host counts as wanted. All tokens count: those of greatest count, at most `features`, are sent to the tasks, the others
are joined.

Defined results: a null or empty URL has no tokens and gets the prior's log odds; text that isn't a URL is read as
a host and a path. A character that no word covers is a word of its own, at the cost of an unknown
letter. A page with null html has no label of its own. Repeated rows get equal results. Without labels of both classes all log odds are 0 and
nothing is unwanted. An empty table gives an empty result. Columns of any name pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import byte_cnn
from ledgerweave.llm.common import P, save
from ledgerweave.llm.textnp import slices, words

UNWANTED = ("casino", "pills", "bets", "spam", "ads", "track", "viagra", "porn", "xxx", "lottery", "payday", "phishing", "malware", "warez", "gambling")
LONGEST = 32
_RUNS = re.compile(r"[a-z]+|[0-9]+")
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", re.S)
PREFIXES, SUFFIXES = {"www", "m", "blog", "amp"}, {"com", "org", "net", "edu", "gov", "co", "uk", "de", "fr", "es", "io", "info", "biz", "example"}


def parts(url: str | None) -> tuple[list[str], list[str]]:
    """Letter and digit runs of the host and of the rest."""
    m = _URL.match((url or "").strip().lower())
    host, tail = (m.group(1), m.group(2)) if m else ("", "")
    labels = [x for x in host.split(".") if x]
    while len(labels) > 1 and labels[0] in PREFIXES:
        labels = labels[1:]
    while len(labels) > 1 and labels[-1] in SUFFIXES:
        labels = labels[:-1]
    return [r for x in labels for r in _RUNS.findall(x)], _RUNS.findall(tail)


class Segmenter:
    """Unigram model: log probability of each word, and of an unknown letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: of the counts of all words, if counts holds only those that are looked up."""
        total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: math.log(n / total) for w, n in counts.items() if 0 < len(w) <= LONGEST}
        self.longest = max(map(len, self.cost), default=1)
        self.unknown = math.log(0.01 / total)
        self.split = lru_cache(1 << 16)(self._split)

    def __reduce__(self):
        return _segmenter, (self.cost, self.unknown)

    def _split(self, run: str) -> tuple[str, ...]:
        if run[:1].isdigit():
            return ("0",)
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for j in range(1, len(run) + 1):
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(run[i:j])
                c = best[i] + (c if c is not None else self.unknown * (j - i) if j - i == 1 else -math.inf)
                if c > best[j]:
                    best[j], back[j] = c, i
        out, j, letters = [], len(run), []
        while j:
            word = run[back[j] : j]
            if word in self.cost:
                if letters:
                    out.append("".join(reversed(letters)))
                    letters = []
                out.append(word)
            else:
                letters.append(word)
            j = back[j]
        if letters:
            out.append("".join(reversed(letters)))
        return tuple(reversed(out))

    def tokens(self, url: str | None) -> list[str]:
        host, tail = parts(url)
        return ["h:" + w for r in host for w in self.split(r)] + ["p:" + w for r in tail for w in self.split(r)]


def _segmenter(cost: dict[str, float], unknown: float) -> Segmenter:
    s = Segmenter({})
    s.cost, s.unknown, s.longest = cost, unknown, max(map(len, cost), default=1)
    return s


def document_words(docs: DataFrame) -> DataFrame:
    """(word, n): counts of the words of ASCII letters in all texts, summed within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                low = data | np.where((data >= 65) & (data < 91), 32, 0).astype(np.uint8)
                h, _, start, end = words(data, offs)
                kind, first, count = np.unique(h, return_index=True, return_counts=True)
                ok, out = ((end - start)[first] <= LONGEST), []
                names = [low[a:b].tobytes() for a, b in zip(start[first[ok]], end[first[ok]])]
                plain = np.array([x.isalpha() and x.isascii() for x in names], bool)
                out = [x.decode() for x, p in zip(names, plain) if p]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(count[ok][plain].astype(np.int64))], names=["word", "n"])

    return docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def url_words(pages: DataFrame) -> DataFrame:
    """(word, n): letter runs of paths, and of hosts that have several; the only run of a host may be several words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for url in batch.column(0).to_pylist():
                host, tail = parts(url)
                for r in (host if len(host) > 1 else []) + tail:
                    if r.isalpha() and len(r) <= LONGEST:
                        counts[r] = counts.get(r, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return pages.select(F.col("url").cast("string")).mapInArrow(run, "word string, n long")


def url_pieces(pages: DataFrame) -> DataFrame:
    """(word): all that stands anywhere in a letter run of a URL, each once."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {r for url in batch.column(0).to_pylist() for side in parts(url) for r in side if r.isalpha()}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["run"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for run in batch.column(0).to_pylist():
                for i in range(len(run)):
                    found.update(run[i:j] for j in range(i + 1, min(i + LONGEST, len(run)) + 1))
                    if len(found) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])
                        found = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])

    distinct = pages.select(F.col("url").cast("string")).mapInArrow(runs, "run string").distinct()
    return distinct.mapInArrow(pieces, "word string").distinct()


def train_segmenter(docs: DataFrame, pages: DataFrame, *, unwanted: tuple[str, ...] = UNWANTED, seldom: int = 2) -> Segmenter:
    spark = pages.sparkSession
    seeds = spark.createDataFrame([(w, 0) for w in unwanted], "word string, n long")
    counts = document_words(docs).union(url_words(pages)).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    counts = save(spark, counts.where((F.col("n") >= seldom) | F.col("word").isin(*unwanted)).withColumn("n", F.greatest("n", F.lit(1))), "words")
    total = counts.agg(F.sum("n")).first()[0]
    return Segmenter({r[0]: r[1] for r in counts.join(url_pieces(pages), "word", "left_semi").toLocalIterator()}, total)


def least_sent(counts: DataFrame, most: int) -> float:
    """The least n such that no more than `most` rows have as much or more. It is taken from the number of rows at each n,
    so that nothing has to be sorted."""
    upto, cut = 0, math.inf
    for n, rows in sorted(((r[0], r[1]) for r in counts.groupBy("n").count().toLocalIterator()), reverse=True):
        upto += rows
        if upto > most:
            break
        cut = n
    return cut


def page_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html.cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "), r"[ \t]+", " "))


def content_labels(pages: DataFrame, docs: DataFrame, quality: DataFrame) -> DataFrame:
    """(`__lw_url`, y) of every page with html: 1 if the classifier rejects its text."""
    net = byte_cnn.fit(docs, quality)
    rows = pages.where("html is not null").select(url_key(), page_text(F.col("html")).alias("text"))
    if net is None:
        return rows.select(P + "url", F.lit(None).cast("int").alias("y"))
    return byte_cnn.score(rows, net).select(P + "url", (F.col(P + "probability") < net.threshold).cast("int").alias("y"))


def url_key() -> Column:
    return F.coalesce(F.col("url").cast("string"), F.lit("")).alias(P + "url")


def tokenised(pages: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(`__lw_url`, `__lw_tokens`) of every distinct URL."""
    sent = pages.sparkSession.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<string>")
    def tokens(url):
        return url.map(sent.value.tokens)

    return pages.select(url_key()).distinct().withColumn(P + "tokens", tokens(P + "url"))


def host_words() -> Column:
    return F.transform(F.filter(P + "tokens", lambda t: t.startswith("h:")), lambda t: F.substr(t, F.lit(3)))


def seed_label(unwanted: tuple[str, ...] = UNWANTED) -> Column:
    """1, 0 or null, from a URL's tokens."""
    hit = F.arrays_overlap(host_words(), F.array(*map(F.lit, unwanted)))
    return F.when(F.size(host_words()) == 0, None).otherwise(F.coalesce(hit, F.lit(False)).cast("int"))


def train_bayes(split: DataFrame, marked: DataFrame) -> tuple[float, DataFrame]:
    """The prior, and (t, n, o), the log odds of every token and how many URLs it stands in. split: tokenised(); marked: (`__lw_url`, y), y 0 or 1 or null."""
    spark = split.sparkSession
    per = save(spark, marked.where("y in (0, 1)").groupBy(P + "url").agg(F.expr("count_if(y = 0)").alias("a"), F.expr("count_if(y = 1)").alias("b")), "url-labels")
    n = per.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    rows = split.join(per, P + "url").select("a", "b", F.explode(P + "tokens").alias("t")).groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    rows = save(spark, rows, "token-counts")
    if not min(n):
        return 0.0, rows.select("t", "n", F.lit(0).cast(ODDS).alias("o")).where("false")
    sums = rows.agg(F.coalesce(F.sum(F.col("a") + 1), F.lit(0)), F.coalesce(F.sum(F.col("b") + 1), F.lit(0))).first()
    return math.log(n[1] / n[0]), rows.select("t", "n", F.round(F.log((F.col("b") + 1) / sums[1]) - F.log((F.col("a") + 1) / sums[0]), 10).cast(ODDS).alias("o"))


#: Sums of decimals don't depend on their order.
ODDS = "decimal(24,10)"


def url_odds(split: DataFrame, odds: DataFrame, features: int) -> DataFrame:
    """(`__lw_url`, `__lw_sum`): the sum of the odds of each URL's tokens. Tokens of greatest count, which could make a join
    uneven, are sent to the tasks, the others joined."""
    cut = least_sent(odds, features)
    each = split.select(P + "url", F.explode(P + "tokens").alias("t"))
    sent = F.broadcast(odds.where(F.col("n") >= cut).select("t", F.col("o").alias("o1"))) if cut < math.inf else None
    found = each.withColumn("o1", F.lit(None).cast(ODDS)) if sent is None else each.join(sent, "t", "left")
    rest = odds.where(F.col("n") < cut) if cut < math.inf else odds
    parts = found.where("o1 is not null").select(P + "url", F.col("o1").alias("o"))
    if not rest.isEmpty():
        parts = parts.union(found.where("o1 is null").join(rest, "t").select(P + "url", "o"))
    return parts.groupBy(P + "url").agg(F.sum("o").cast("double").alias(P + "sum"))


def score(spark: SparkSession, pages: DataFrame, docs: DataFrame, *, quality: DataFrame | None = None, labels: Column | None = None, threshold: float = 0.0, unwanted: tuple[str, ...] = UNWANTED, features: int = 200_000) -> DataFrame:
    """pages with `__lw_tokens`, `__lw_log_odds` and `__lw_keep`. quality: (doc_id, quality) of some documents. labels: instead of
    the module's labels, a column expression over pages with their tokens. features: the tokens that are sent to the tasks
    instead of being joined; the result doesn't depend on it."""
    split = save(spark, tokenised(pages, train_segmenter(docs, pages, unwanted=unwanted)), "url-tokens")
    keyed = pages.withColumn(P + "url", url_key())
    if labels is not None:
        marked = keyed.join(split, P + "url").select(P + "url", labels.cast("int").alias("y"))
    elif quality is not None and "html" in pages.columns:
        seed = split.select(P + "url", (seed_label(unwanted) == 1).alias("hit"))
        own = content_labels(pages, docs, quality).union(pages.where("html is null").select(url_key(), F.lit(None).cast("int")))
        marked = own.join(seed, P + "url").select(P + "url", F.when(F.col("hit"), 1).otherwise(F.col("y")).alias("y"))
    else:
        marked = keyed.select(P + "url").join(split, P + "url").select(P + "url", seed_label(unwanted).alias("y"))
    prior, odds = train_bayes(split, marked)
    scored = split.join(url_odds(split, odds, features), P + "url", "left").select(P + "url", P + "tokens", (F.lit(prior) + F.coalesce(P + "sum", F.lit(0.0))).alias(P + "log_odds"))
    out = keyed.join(scored, P + "url").withColumn(P + "keep", F.col(P + "log_odds") <= threshold)
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), P + "tokens", P + "log_odds", P + "keep")
