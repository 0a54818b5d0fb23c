"""Sharding by a k-d tree over the rows' metadata.

A row is a point with integer coordinates, one for each metadata dimension: source and language by a
hash of the name (below 2**16), and size by the logarithm of the text's bytes. A leaf that holds more than the target bytes is
split at the weighted median (the weights are bytes) along its widest dimension; of equally wide ones
the first. Dimensions are measured by their range over the whole table, so that a width of 1 is all of it. Rows that agree
in all metadata are told apart by a hash of the row, in 2**16 steps of the leaf's range; it is used only where
nothing else can split a leaf. A leaf all of whose rows share one point can't be split and stays, whatever its size.
The cut is the coordinate at which the bytes up to it come closest to one half; of two such the lesser.

Leaves of more than LOCAL_POINTS points are split level by level: their extents and then their medians
come from distributed aggregations (bytes by leaf and coordinate, summed map-side, cumulated within each leaf, which has at
most 2**16 coordinates). Every point carries its leaf along. Smaller leaves are finished by one task each, by the same rule.
The driver sees one row for each leaf of the first kind, and the finished tree if it has at most `BROADCAST_LEAVES` leaves; then
the tasks get it and place the rows by it. A larger tree stays a table of points with their shards, to which the rows are joined.

The target is `target_bytes`, or less if the table would have fewer than `least_shards` shards with it: as many readers get
one each.

Defined results: null metadata counts as a value of its own, a null text as 0 bytes; a row of 0
bytes weighs 1 byte, so that empty rows are spread as well. Equal rows share a shard. An empty table
has no shards and gives an empty result. Columns of any name pass through; helper columns start
with `__lw_`. Shards are numbered from 0 in the order of the tree's leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import P, by_shard, save, text_bytes

STEPS_LOG, ROW_LOG = 16, 31
DIMS = ("source", "lang", "size", "row")
ROW = len(DIMS) - 1
LOCAL_POINTS, BROADCAST_LEAVES = 1 << 17, 1 << 20


@dataclass
class KdTree:
    """Node k goes left where coordinate dim[k] <= cut[k]; leaves have dim -1 and a number."""

    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])

    def divide(self, node: int, dim: int, cut: int) -> int:
        """Splits a leaf; returns its left child, which the right one follows."""
        self.dim[node], self.cut[node], self.left[node] = dim, cut, len(self.dim)
        for _ in range(2):
            self.dim.append(-1)
            self.cut.append(0)
            self.left.append(-1)
        return self.left[node]

    def leaves(self) -> dict[int, int]:
        """Number of every leaf, from left to right."""
        out, todo = {}, [0]
        while todo:
            k = todo.pop()
            if self.dim[k] < 0:
                out[k] = len(out)
            else:
                todo += [self.left[k] + 1, self.left[k]]
        return out


@dataclass
class Placing:
    """A tree as arrays, with the shard of each leaf."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    shard: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while True:
            rows = rows[self.dim[at[rows]] >= 0]
            if not len(rows):
                return self.shard[at]
            k = at[rows]
            at[rows] = self.left[k] + (points[rows, self.dim[k]] > self.cut[k])


def weight() -> Column:
    return F.greatest(text_bytes(), F.lit(1).cast("long"))


def coordinates(seed: int = 23) -> dict[str, Column]:
    def named(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(c).cast("string"), F.lit("\0null"))), F.lit(1 << STEPS_LOG)).cast("int")

    size = F.least(F.floor(F.log2(text_bytes() + 1) * 2048), F.lit((1 << STEPS_LOG) - 1)).cast("int")
    row = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(1 << ROW_LOG)).cast("int")
    return dict(zip(DIMS, (named("source"), named("lang"), size, row)))


def widest(lo: np.ndarray, hi: np.ndarray, extent: np.ndarray) -> int:
    """The dimension to split, or -1. extent: the ranges over the whole table."""
    width = (hi - lo)[:ROW] / np.maximum(extent[:ROW], 1)
    if width.max() > 0:
        return int(np.argmax(width))
    return ROW if hi[ROW] > lo[ROW] else -1


def steps(dim: int, lo: int, hi: int) -> tuple[int, int]:
    """(from, shift): the coordinates of a leaf are taken as (x - from) >> shift, so that there are few enough of them."""
    return (lo, max(0, (hi - lo).bit_length() - STEPS_LOG)) if dim == ROW else (0, 0)


def grow(points: np.ndarray, weights: np.ndarray, target: int, extent: np.ndarray) -> tuple[KdTree, np.ndarray]:
    """The tree over some points, and the number of each one's leaf."""
    tree, leaf, todo = KdTree(), np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        p, w = points[rows], weights[rows]
        dim = widest(lo := p.min(0), hi := p.max(0), extent) if w.sum() > target else -1
        if dim < 0:
            leaf[rows] = node
            continue
        start, shift = steps(dim, int(lo[dim]), int(hi[dim]))
        value, code = np.unique((p[:, dim] - start) >> shift, return_inverse=True)
        upto = np.cumsum(np.bincount(code, w).astype(np.int64))[:-1]
        cut = start + ((int(value[np.argmin(np.abs(2 * upto - w.sum()))]) + 1) << shift) - 1
        left, right = tree.divide(node, dim, cut), p[:, dim] > cut
        todo += [(left, rows[~right]), (left + 1, rows[right])]
    number = np.zeros(len(tree.dim), np.int64)
    for k, i in tree.leaves().items():
        number[k] = i
    return tree, number[leaf]


def table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf[list(DIMS)].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)


def build(spark: SparkSession, docs: DataFrame, *, target_bytes: int, least_shards: int) -> tuple[int, Placing | DataFrame]:
    """Number of shards, and the tree, or a table of points with their `__lw_shard`."""
    points = docs.select(*(x.alias(c) for c, x in coordinates().items()), weight().alias("w")).groupBy(*DIMS).agg(F.sum("w").alias("w")).withColumn("leaf", F.lit(0))
    top, target, extent, fresh = KdTree(), target_bytes, None, [0]
    while True:
        points = save(spark, points, "points")
        if not fresh:
            break
        own = points if len(top.dim) == 1 else points.join(few(spark.createDataFrame([(x,) for x in fresh], "leaf int")), "leaf")
        ends = [F.min(c).alias(f"lo_{c}") for c in DIMS] + [F.max(c).alias(f"hi_{c}") for c in DIMS]
        choice, fresh = [], []
        for r in own.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *ends).toLocalIterator():
            lo, hi = (np.array([r[f"{x}_{c}"] for c in DIMS]) for x in ("lo", "hi"))
            if extent is None:
                extent, target = hi - lo, max(1, min(target_bytes, -(-r["w"] // max(1, least_shards))))
            dim = widest(lo, hi, extent)
            if r["n"] > LOCAL_POINTS and r["w"] > target and dim >= 0:
                choice.append((r["leaf"], dim, *steps(dim, int(lo[dim]), int(hi[dim]))))
        if not choice:
            break
        chosen = own.join(few(spark.createDataFrame(choice, "leaf int, dim int, start int, shift int")), "leaf")
        value = coordinate()
        step = ((value - F.col("start")) / F.pow(F.lit(2.0), F.col("shift"))).cast("long")
        sums = chosen.groupBy("leaf", "dim", "start", "shift", step.alias("x")).agg(F.sum("w").alias("w"))
        upto, all_of = Window.partitionBy("leaf").orderBy("x"), Window.partitionBy("leaf")
        run = sums.withColumns({"upto": F.sum("w").over(upto), "all": F.sum("w").over(all_of), "last": F.max("x").over(all_of)})
        # the last coordinate can't be the cut
        cuts = run.where("x < last").groupBy("leaf", "dim", "start", "shift").agg(F.min_by("x", F.struct(F.abs(2 * F.col("upto") - F.col("all")), F.col("x"))).alias("x"))
        done = []
        for r in sorted(cuts.toLocalIterator()):
            cut = r["start"] + ((r["x"] + 1) << r["shift"]) - 1
            done.append((r["leaf"], r["dim"], cut, left := top.divide(r["leaf"], r["dim"], cut)))
            fresh += [left, left + 1]
        moved = points.join(few(spark.createDataFrame(done, "leaf int, dim int, cut long, left int")), "leaf", "left")
        points = moved.withColumn("leaf", F.when(F.col("dim").isNull(), F.col("leaf")).otherwise(F.col("left") + (value > F.col("cut")).cast("int"))).select(*DIMS, "w", "leaf")
    if extent is None:
        return 0, Placing(np.array([-1]), np.zeros(1, np.int64), np.array([-1]), np.zeros(1, np.int64))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, number = grow(*table(pdf), target, extent)
        shard = np.full(len(tree.dim), -1)
        for k, i in tree.leaves().items():
            shard[k] = i
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "leaves": [int(number.max()) + 1], "dim": [tree.dim], "cut": [tree.cut], "left": [tree.left], "shard": [shard]})

    parts = save(spark, points.groupBy("leaf").applyInPandas(finish, "leaf int, leaves long, dim array<int>, cut array<long>, left array<int>, shard array<int>"), "subtrees")
    size = {r[0]: r[1] for r in parts.select("leaf", "leaves").toLocalIterator()}
    offset, shards = {}, 0
    for k in top.leaves():
        offset[k], shards = shards, shards + size[k]
    if shards > BROADCAST_LEAVES:

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[list(DIMS)].assign(**{P + "shard": grow(*table(pdf), target, extent)[1] + offset[int(pdf["leaf"].iloc[0])]})

        return shards, save(spark, points.groupBy("leaf").applyInPandas(place, ", ".join(f"{c} int" for c in DIMS) + f", {P}shard int"), "places")
    # the subtrees take the places of the top's leaves
    dim, cut, left, shard, n = [np.array(top.dim)], [np.array(top.cut)], [np.array(top.left)], [np.full(len(top.dim), -1)], len(top.dim)
    for r in parts.toLocalIterator():
        own = [np.array(r[c], np.int64) for c in ("dim", "cut", "left", "shard")]
        own[2] = np.where(own[0] >= 0, own[2] + n - 1, -1)
        own[3] = np.where(own[0] < 0, own[3] + offset[r["leaf"]], -1)
        for whole, x in zip((dim, cut, left, shard), own):
            whole[0][r["leaf"]] = x[0]
            whole.append(x[1:])
        n += len(own[0]) - 1
    return shards, Placing(*(np.concatenate(x) for x in (dim, cut, left, shard)))


def few(df: DataFrame) -> DataFrame:
    """df has one row for each leaf of the tree's top, of which there is about one to LOCAL_POINTS points."""
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def coordinate() -> Column:
    """The one in dimension `dim`."""
    return F.coalesce(*(F.when(F.col("dim") == i, F.col(c)) for i, c in enumerate(DIMS)))


def assign(docs: DataFrame, placing: Placing | DataFrame, column: str = "shard") -> DataFrame:
    """docs with the number of each row's shard."""
    if isinstance(placing, DataFrame):
        named = docs.withColumns({P + c: x for c, x in coordinates().items()})
        return named.join(placing.withColumnsRenamed({c: P + c for c in DIMS}), [P + c for c in DIMS]).select(*(F.col(f"`{c}`") for c in docs.columns), F.col(P + "shard").alias(column))

    @F.pandas_udf("int")
    def shard_of(a, b, c, d):
        return pd.Series(placing.of(np.stack([x.to_numpy() for x in (a, b, c, d)], axis=1)).astype(np.int32))

    return docs.withColumn(column, shard_of(*coordinates().values()))


def shard(spark: SparkSession, docs: DataFrame, *, target_bytes: int = 16 << 20, least_shards: int = 32, column: str = "shard") -> DataFrame:
    """All columns of docs and the shard of each row, each shard together and in the order of doc_id.
    A column of docs that has the name of the new one is replaced."""
    shards, placing = build(spark, docs, target_bytes=target_bytes, least_shards=least_shards)
    return by_shard(assign(docs.drop(column), placing, column), column, max(1, shards), "doc_id")
