"""Quality rules: an isolation forest on rule statistics.

For each document the statistics that quality rules look at are computed over its whole text: the
shares of upper-case letters, of symbols, of words that a mark follows and of marks that stand
alone, and the repetition of words, of neighbouring words and of pairs of words. Every tree isolates the points of a small random sample by splits
at random values of random statistics; a document that is isolated after few splits, on average over
all trees, is anomalous. The threshold on the score is calibrated on labelled rows: the one with the
best balanced accuracy among those at which at most `lose` of the good rows are rejected.

The method's samples: each of the `trees` trees has `per_tree` rows of its own, all of them together being those of least hash of
doc_id and text among all documents whose text isn't blank (if there are fewer, trees share rows). The threshold is taken from all labelled rows.
Extremes to be expected of short texts are levelled by counting `PRIOR` typical words along.

Defined results: null texts and texts without any word have no statistics and are rejected. Rows with
a null doc_id are scored like others; repeated rows get equal scores. Labels that are null or contradict each other for
one doc_id aren't used. Without labels of both classes the threshold rejects nothing but such
texts. An empty table gives an empty result. Columns beside doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import P, save
from ledgerweave.llm.textnp import SPACE, WORD, lowered, slices, words

STATS = ("upper", "symbol", "mark_words", "lone_marks", "distinct_words", "top_word", "adjacent_same", "bigram_same")
PRIOR = 30.0
TYPICAL = dict(zip(STATS, (0.03, 0.03, 0.12, 0.01, 0.9, 0.06, 0.0, 0.02)))


def statistics(arr: pa.Array) -> np.ndarray:
    """A row of STATS for each text; NaN where there is no word."""
    out = np.full((len(arr), len(STATS)), np.nan, np.float32)
    for i, j, data, offs in slices(arr):
        n = j - i
        low = lowered(data)
        h, text, start, end = words(data, offs, low)
        if not len(h):
            continue
        count = np.bincount(text, minlength=n).astype(np.float64)

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)

        def level(hits: np.ndarray, base: np.ndarray, stat: str, prior: float = PRIOR) -> np.ndarray:
            return (hits + prior * TYPICAL[stat]) / (base + prior)

        blank = SPACE[data] | (data == 10)
        letters, space = per_text(WORD[data]), per_text(blank)
        whole = np.diff(offs).astype(np.float64)
        symbols = np.maximum(whole - letters - space, 0)
        cols = {"upper": level(per_text((low != data)), letters, "upper", PRIOR * 5)}
        cols["symbol"] = level(symbols, whole, "symbol", PRIOR * 5)
        # words that a symbol follows
        after = np.minimum(end, len(data) - 1)
        marked = (end < offs[text + 1]) & ~WORD[data[after]] & ~blank[after]
        cols["mark_words"] = level(np.bincount(text, marked, n), count, "mark_words")
        order = np.lexsort((h, text))
        hs, ts = h[order], text[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])])
        times = np.diff(np.r_[first, len(hs)]).astype(np.float64)
        kinds, top = np.bincount(ts[first], minlength=n).astype(np.float64), np.zeros(n)
        np.maximum.at(top, ts[first], times)
        # distinct words fall with length as vocabulary grows like a power of it (Heaps)
        cols["distinct_words"] = level(kinds / np.maximum(count, 1) ** 0.85 * count, count, "distinct_words")
        cols["top_word"] = level(top, count, "top_word")
        same = np.r_[False, (h[1:] == h[:-1]) & (text[1:] == text[:-1])]
        cols["adjacent_same"] = level(np.bincount(text, same, n), count, "adjacent_same")
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] if len(h) > 1 else h[:0]
        inside = text[1:] == text[:-1]
        two, t2 = two[inside], text[1:][inside]
        order = np.lexsort((two, t2))
        two, t2 = two[order], t2[order]
        again = np.r_[False, (two[1:] == two[:-1]) & (t2[1:] == t2[:-1])] if len(two) else np.zeros(0, bool)
        cols["bigram_same"] = level(np.bincount(t2, again, n), count, "bigram_same")
        lone = np.zeros(len(data), bool)
        lone[1:-1] = ~blank[1:-1] & ~WORD[data[1:-1]] & blank[:-2] & blank[2:]
        cols["lone_marks"] = level(per_text(lone), count, "lone_marks")
        table = np.stack([cols[s] for s in STATS], axis=1)
        table[count == 0] = np.nan
        out[i:j] = table
    return out


@dataclass
class Forest:
    """Trees as arrays over nodes in heap order: stat -1 is a leaf, whose path is its depth and the expected rest."""

    stat: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    expected: float
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path); near 1 for anomalies. 1.0 where a statistic is missing."""
        out = np.zeros(len(x))
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            total = np.zeros(len(part))
            for stat, cut, path in zip(self.stat, self.cut, self.path):
                node, rows = np.zeros(len(part), np.int64), np.arange(len(part))
                while len(rows):
                    k = node[rows]
                    rows = rows[stat[k] >= 0]
                    k = node[rows]
                    node[rows] = 2 * k + 1 + (part[rows, stat[k]] > cut[k])
                total += path[node]
            out[at : at + 8192] = total
        score = 2.0 ** (-out / (max(1, len(self.stat)) * self.expected))
        score[np.isnan(x).any(axis=1)] = 1.0
        return score


def rest(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int, per_tree: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    per_tree = min(per_tree, len(sample))
    own = rng.permutation(len(sample))[: trees * per_tree].reshape(trees, per_tree) if len(sample) >= trees * per_tree else None
    depth = max(1, int(np.ceil(np.log2(max(2, per_tree)))))
    nodes = 2 ** (depth + 1) - 1
    stat, cut, path = np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes), np.float32), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, sample[own[t] if own is not None else rng.choice(len(sample), per_tree, replace=False)])]
        while todo:
            k, d, x = todo.pop()
            lo, hi = (x.min(0), x.max(0)) if len(x) else (np.zeros(len(STATS)), np.zeros(len(STATS)))
            wide = np.flatnonzero(hi > lo)
            if d == depth or len(x) < 2 or not len(wide):
                path[t, k] = d + rest(len(x))
                continue
            s = int(rng.choice(wide))
            c = np.float32(rng.uniform(lo[s], hi[s]))
            c = min(c, np.nextafter(hi[s], -np.inf, dtype=np.float32))
            stat[t, k], cut[t, k] = s, c
            right = x[:, s] > c
            todo += [(2 * k + 1, d + 1, x[~right]), (2 * k + 2, d + 1, x[right])]
    return Forest(stat, cut, path, max(rest(per_tree), 1e-9))


def calibrate(score: np.ndarray, quality: np.ndarray, lose: float) -> float:
    """Scores above the result are rejected."""
    good, bad = np.sort(score[quality > 0]), np.sort(score[quality == 0])
    if not len(good) or not len(bad):
        return 1.0 - 1e-12
    cuts = np.unique(np.r_[good, bad])
    lost = 1 - np.searchsorted(good, cuts, "right") / len(good)
    caught = 1 - np.searchsorted(bad, cuts, "right") / len(bad)
    fits = np.flatnonzero(lost <= lose)
    return float(cuts[fits[np.argmax((caught - lost)[fits])]])


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, *, trees: int = 200, per_tree: int = 256, lose: float = 0.002, seed: int = 5) -> Forest:
    """stats: (doc_id, th, s), saved."""
    known = stats.where("not isnan(s[0])")
    rank, pool = F.xxhash64(F.lit(seed), "doc_id", "th"), trees * per_tree
    # hashes are spread evenly: below this one lie about twice as many rows as are wanted, so no task sends more than a few
    most = min(2**63 - 1, int(-(2**63) + 2**64 * (2 * pool + 64) / max(1, known.count())))
    picked = known.where(rank <= F.lit(most)).orderBy(rank, "doc_id").limit(pool).select("s").toPandas()["s"]
    sample = np.stack(picked.to_list()).astype(np.float32) if len(picked) else np.zeros((0, len(STATS)), np.float32)
    if not len(sample):
        return Forest(np.full((1, 1), -1), np.zeros((1, 1), np.float32), np.zeros((1, 1)), 1.0, 1.0 - 1e-12)
    forest = grow(sample, trees, per_tree, seed)
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q")
    marked = scored(known.join(own, "doc_id").select("q", "s"), forest).groupBy("q", F.round("score", 4).alias("score")).count().toPandas()
    forest.threshold = calibrate(np.repeat(marked["score"].to_numpy(), marked["count"]), np.repeat(marked["q"].to_numpy(), marked["count"]), lose)
    return forest


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    @F.pandas_udf("double")
    def score(s):
        import pandas as pd

        return pd.Series(np.round(forest.scores(np.stack(s.to_list()).astype(np.float32)), 4) if len(s) else [])

    return stats.withColumn("score", score("s"))


def stats_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, s) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float32()))], names=["doc_id", "th", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, s array<float>")


def kept(spark: SparkSession, docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """(doc_id, score) of the rows that aren't anomalous."""
    stats = save(spark, stats_of(docs), "rule-statistics")
    forest = fit(spark, stats, labels, **more)
    return scored(stats, forest).where(F.col("score") <= forest.threshold).select("doc_id", "score")


def keep_normal(spark: SparkSession, docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """All columns of docs, and the score as `__lw_score`, of the rows that aren't anomalous."""
    forest = fit(spark, save(spark, stats_of(docs), "rule-statistics"), labels, **more)
    schema = T.StructType([*docs.schema.fields, T.StructField(P + "score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.round(forest.scores(statistics(b.column(b.schema.get_field_index("text")))), 4)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, P + "score"]).filter(pa.array(score <= forest.threshold))

    return docs.mapInArrow(run, schema)
