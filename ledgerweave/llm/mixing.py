"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows are put in the order of a keyed hash (a random permutation) and cut into blocks
of `block` consecutive rows. A source's quota is a number of rows that follows from the target
weights; its blocks are the leading ones of the permutation, the last of them cut to the quota. The
output has `shards` shards: at each node of a binary tree over the shards, the blocks of all
sources that the node holds are dealt to its two halves by one multivariate-hypergeometric draw, so
that the halves get shares of exact size, drawn without replacement. A leaf, i.e. a shard, thus owns
disjoint ranges of every source's permuted blocks. Within a shard the rows are put in the order of
another keyed hash.

The tree is a table of (node, source, blocks) that is split LEVELS levels a round, each node in a task of its own, so that
neither the driver nor a worker ever holds all of it. What rows need of it, the shards of the few blocks that their bucket of
the permutation covers, is joined to the buckets, before the rows are. There are ceil(rows / `shard_rows`) shards, and
`least_shards` at least, as far as there are blocks: as many readers get one each.

Quotas: with weights w and rows n of the sources, a source gives min(n, level * w); what it is short of its share goes to
the others in proportion to their weights, as the level is what adds up to the total. The total may be stated. Otherwise the
level follows from the bounds n / w at which the sources run short: it is their geometric mean over the scarcest rows, i.e. over the
sources of least bound that hold the share `scarce` of all rows, where the rows up to the share u count (u / scarce) ** 2.
So scarce sources with that share or more bind the total, and the weights are met exactly; with fewer rows they give what they
have and bind it the less the fewer rows they hold. The level is continuous in the counts, and splitting a source in
parts of the same bound doesn't change it. Fractions go to the largest remainders, ties to the source that sorts
first. Default weights are n ** `alpha` (temperature sampling). The sources' names and counts go through the driver.

Defined results: a null source is a source of its own. Rows with equal doc_id, text and source are told apart by a hash of
their other columns (all but maps), and rows equal in all of these by a number among their equals. A source that has no
weight gives nothing, a weight for a source without rows is left out. An empty table gives an empty result. Columns of any
name pass through; helper columns start with `__lw_`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import P, by_shard, save

BUCKET_ROWS, BROADCAST_SOURCES, LEVELS = 2048, 100_000, 10
NULL_SOURCE = "\0null"


def level(counts: dict[str, int], w: dict[str, float], scarce: float) -> float:
    """Rows per unit of weight, from the bounds of the scarcest rows."""
    everything, upto, before, out = sum(counts[s] for s in w), 0, 0.0, 0.0
    for s in sorted(w, key=lambda s: counts[s] / w[s]):
        upto += counts[s]
        now = min(1.0, upto / everything / scarce) ** 2
        out += (now - before) * math.log(counts[s] / w[s])
        before = now
    return math.exp(out)


def level_of_total(counts: dict[str, int], w: dict[str, float], total: int) -> float:
    """Rows per unit of weight at which the sources give `total` rows, those that run short all of theirs."""
    whole, given = sum(w.values()), 0
    for s in sorted(w, key=lambda s: counts[s] / w[s]):
        if counts[s] / w[s] * whole + given >= total:
            return (total - given) / whole
        whole, given = whole - w[s], given + counts[s]
    return math.inf


def quotas(counts: dict[str, int], weights: dict[str, float] | None = None, *, alpha: float = 0.5, scarce: float = 0.05, total: int | None = None) -> dict[str, int]:
    """Rows to draw of each source."""
    counts = {s: n for s, n in counts.items() if n > 0}
    w = {s: n**alpha for s, n in counts.items()} if weights is None else {s: float(weights[s]) for s in counts if weights.get(s, 0) > 0}
    if not w:
        return {}
    per = level(counts, w, scarce) if total is None else level_of_total(counts, w, total)
    exact = {s: min(float(counts[s]), per * w[s]) for s in w}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(w, key=lambda s: (-(exact[s] - out[s]), s))[: round(sum(exact.values())) - sum(out.values())]:
        out[s] += 1
    return {s: min(n, counts[s]) for s, n in out.items()}


def draw(rng: np.random.Generator, own: np.ndarray, take: int) -> np.ndarray:
    """One multivariate-hypergeometric draw of `take` units, exact for any numbers. Every unit is chosen independently first,
    which makes any set of so many chosen ones as likely as any other; those that are too many or too few are then
    given back, or added, one by one at random."""
    total = int(own.sum())
    if take <= 0 or take >= total:
        return own * (take > 0)
    out = rng.binomial(own, take / total)
    over = int(out.sum()) - take
    if over:
        among = out if over > 0 else own - out
        picked = rng.choice(int(among.sum()), abs(over), replace=False, shuffle=False)
        out -= np.sign(over) * np.bincount(np.searchsorted(np.cumsum(among), picked, "right"), minlength=len(own))
    return out


def split(lo: int, hi: int, own: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The first shard of the right half of the node over the shards lo..hi-1, and each source's blocks that go to the left half;
    the draw depends on the seed, the node and its blocks alone."""
    mid = (lo + hi) // 2
    return mid, draw(np.random.default_rng([seed, lo, hi]), own, (int(own.sum()) * (mid - lo) + (hi - lo) // 2) // (hi - lo))


def deal(spark: SparkSession, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(i, shard, first, n): the n blocks from `first` on of source number i are the shard's."""
    kind = "lo int, hi int, i int, first long, n long"
    nodes = spark.createDataFrame([(0, shards, i, 0, n) for i, n in enumerate(blocks) if n], kind)

    def down(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("i")
        name, out = node["i"].to_numpy(), []
        todo = [(int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), 0, np.arange(len(name)), node["first"].to_numpy(), node["n"].to_numpy())]
        while todo:
            lo, hi, level, own, first, n = todo.pop()
            own, first, n = own[n > 0], first[n > 0], n[n > 0]
            if hi - lo == 1 or level == LEVELS:
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "i": name[own], "first": first, "n": n}))
                continue
            mid, left = split(lo, hi, n, seed)
            todo += [(lo, mid, level + 1, own, first, left), (mid, hi, level + 1, own, first + left, n - left)]
        return pd.concat(out)

    for _ in range(max(1, -(-(shards - 1).bit_length() // LEVELS))):
        nodes = save(spark, nodes.groupBy("lo", "hi").applyInPandas(down, kind), "dealt")
    return nodes.select("i", F.col("lo").alias("shard"), "first", "n")


def keyed_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of a row's identity: its integer doc_id, its text, and its source."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), F.col("source"))


def rest_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all other columns but maps, which can't be hashed."""
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text", "source") and "map<" not in kind))


def mix(spark: SparkSession, docs: DataFrame, **more) -> DataFrame:
    """docs, mixed: all of its columns, with `__lw_shard` and `__lw_place`, the shard and a row's sort key within it."""
    return dealt(spark, docs, **more)[0]


def dealt(spark: SparkSession, docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, scarce: float = 0.05, total: int | None = None, block: int = 16, shard_rows: int = 16384, least_shards: int = 16, seed: int = 17) -> tuple[DataFrame, int]:
    """The mixture, see mix(), and its number of shards."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE))
    counts = {r[0]: r[1] for r in docs.select(source.alias("s")).groupBy("s").count().toLocalIterator()}
    quota = quotas(counts, weights, alpha=alpha, scarce=scarce, total=total)
    names = sorted(s for s in quota if quota[s])
    drawn = sum(quota.values())
    if not drawn:
        return docs.withColumns({P + "shard": F.lit(0), P + "place": F.lit(0).cast("long")}).where("false"), 1
    blocks = [-(-quota[s] // block) for s in names]
    shards = max(-(-drawn // shard_rows), min(least_shards, sum(blocks)))
    info = spark.createDataFrame([(s, i, quota[s], max(1, counts[s] // BUCKET_ROWS)) for i, s in enumerate(names)], f"{P}s string, {P}i int, {P}quota long, {P}buckets long")
    few = F.broadcast if len(names) <= BROADCAST_SOURCES else lambda df: df

    def keyed(info: DataFrame) -> DataFrame:
        out = docs.withColumns({P + "s": source, P + "h": keyed_hash(docs, seed)}).join(few(info), P + "s")
        # the permutation's leading bits choose a bucket of bounded size
        return out.withColumn(P + "bucket", F.expr(f"shiftrightunsigned({P}h, 32) * {P}buckets div 4294967296"))

    # rows before each bucket: summed along runs of buckets, and within each run
    runs = Window.partitionBy(P + "i").orderBy(P + "run").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(P + "i", P + "run").orderBy(P + "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = save(spark, keyed(info).groupBy(P + "i", P + "bucket").agg(F.count(F.lit(1)).alias(P + "n")).withColumn(P + "run", F.expr(f"{P}bucket div 4096")), "bucket-sizes")
    start = sizes.groupBy(P + "i", P + "run").agg(F.sum(P + "n").alias(P + "m")).select(P + "i", P + "run", F.coalesce(F.sum(P + "m").over(runs), F.lit(0)).alias(P + "start"))
    before = sizes.join(start, [P + "i", P + "run"]).withColumn(P + "before", F.col(P + "start") + F.coalesce(F.sum(P + "n").over(inner), F.lit(0)))
    before = before.join(few(info.select(P + "i", P + "quota")), P + "i").where(f"{P}before < {P}quota")
    # the shards of the blocks that each bucket covers
    covers = before.select(P + "i", P + "bucket", P + "before", F.explode(F.expr(f"sequence({P}before div {block}, (least({P}before + {P}n, {P}quota) - 1) div {block})")).alias(P + "b"))
    owned = deal(spark, blocks, shards, seed).select(F.col("i").alias(P + "i"), F.explode(F.expr("sequence(first, first + n - 1)")).alias(P + "b"), F.col("shard").alias(P + "shard"))
    reached = covers.join(owned, [P + "i", P + "b"]).groupBy(P + "i", P + "bucket", P + "before").agg(F.transform(F.array_sort(F.collect_list(F.struct(P + "b", P + "shard"))), lambda x: x[P + "shard"]).alias(P + "shards"))
    reached = save(spark, reached, "bucket-shards")
    # rows in buckets beyond the quota go before anything is shuffled
    last = reached.groupBy(P + "i").agg(F.max(P + "bucket").alias(P + "last"))
    wanted = keyed(info.join(few(last), P + "i")).where(f"{P}bucket <= {P}last").drop(P + "last")
    order = Window.partitionBy(P + "i", P + "bucket").orderBy(P + "h", rest_hash(docs, seed))
    ranked = wanted.join(reached.hint("shuffle_hash"), [P + "i", P + "bucket"]).withColumn(P + "r", F.row_number().over(order) - 1 + F.col(P + "before")).where(f"{P}r < {P}quota")
    placed = ranked.withColumn(P + "shard", F.expr(f"{P}shards[cast({P}r div {block} - {P}before div {block} as int)]")).withColumn(P + "place", F.xxhash64(F.lit(seed + 1), P + "h", P + "r"))
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), P + "shard", P + "place"), shards


def shuffled(mixed: DataFrame, shards: int) -> DataFrame:
    """Every shard's rows together, in their places."""
    return by_shard(mixed, P + "shard", shards, P + "place")


def mixed_documents(spark: SparkSession, docs: DataFrame, **more) -> DataFrame:
    """docs, mixed and shuffled: the columns of docs only."""
    return shuffled(*dealt(spark, docs, **more)).select(*(F.col(f"`{c}`") for c in docs.columns))
