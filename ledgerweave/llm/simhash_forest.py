"""SimHash near-duplicates by an LSH forest.

Fingerprint: 256 bits, each the majority of one bit of the hashes of the document's features;
these are its words, each once for its 1st, 2nd, 4th, 8th, ... occurrence. Each of several trees sorts the fingerprints by
randomly permuted bits. The search of a tree begins at long prefixes and climbs to shorter ones. It climbs, for every
fingerprint, at least to the depth at which the trees together find a pair at `design_distance`, the greatest that is accepted,
with probability `recall`: there all pairs of a node (the fingerprints with one prefix) are compared, however many. Where the
density is low it climbs on, as long as the node holds at most `leaf` fingerprints. Nodes that lower levels have already
made one component aren't compared again. Pairs are verified by their Hamming distance over all bits: `max_distance` at most, or
`short_distance` if either document has fewer than SHORT features, for which the fingerprint tells less. The groups are the
connected components of the verified pairs.

Depth and number of trees follow from the number n of fingerprints, as a fixed number of trees can't do: for a pair at
distance d the chance that a prefix of log2(n / leaf) bits agrees falls as n ** log2(1 - d / 256), so that with fewer trees either
recall is lost or nodes grow with n, and the pairs with its square.

In a node of more than `DENSE` fingerprints the pairs aren't all built: those within the distance
of a leader are linked to it, the others are compared with them and then treated alike, which
leaves the same components. Subtrees of more than `HOT` fingerprints are cut into parts, and every two parts go to a task.

A document's key is (doc_id, hash of its text). Of each group the key that is least stays, null
doc_ids last; of rows with equal keys one stays. Defined results: a null text is no one's
duplicate; texts without any word are duplicates only of equal texts; an empty table gives an
empty result; columns beside doc_id and text don't matter. doc_id must be castable to long. Texts are told apart by
64-bit hashes only among rows of one doc_id; fingerprints are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import P, log2_ceil, save
from ledgerweave.llm.textnp import mix, slices, words

BITS, LANES, DENSE, SHORT, HOT = 256, 4, 4096, 64, 1 << 17
FP = [f"f{i}" for i in range(LANES)]
_LANE_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def fingerprint_array(arr: pa.Array, text_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LANES unsigned integers for every text, and its number of features; a text without words gets bits of its own hash."""
    out, features = np.empty((len(arr), LANES), np.uint64), np.zeros(len(arr), np.int64)
    for i, j, data, offs in slices(arr, 1 << 20):
        n = j - i
        for q in range(LANES):
            out[i:j, q] = mix(text_hash[i:j].view(np.uint64) ^ _LANE_SEEDS[q])
        h, text, _, _ = words(data, offs)
        if not len(h):
            continue
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        time = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        counted = (time & (time + 1)) == 0
        h, text = h[counted] ^ mix(time[counted].astype(np.uint64)), text[counted]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        own, count = text[first], np.diff(np.r_[first, len(text)])
        features[i + own] = count
        for q in range(LANES):
            for a in range(0, len(first), 256):
                b = min(a + 256, len(first))
                lo, hi = first[a], first[b] if b < len(first) else len(h)
                bits = np.unpackbits(mix(h[lo:hi] ^ _LANE_SEEDS[q]).view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, first[a:b] - lo, axis=0, dtype=np.int32)
                twice, tie = 2 * ones - count[a:b, None], bits[first[a:b] - lo]
                packed = np.packbits(np.where(twice == 0, tie, twice > 0).astype(np.uint8), axis=1)
                out[i + own[a:b], q] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
    return out, features


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, th, short, f0..f3) of every row whose text isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th = b.column(1).to_numpy(zero_copy_only=False)
            fp, features = fingerprint_array(b.column(2), th)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(features < SHORT), *(pa.array(fp[:, q].view(np.int64)) for q in range(LANES))], names=["doc_id", "th", "short", *FP])

    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, short boolean, " + ", ".join(f"{f} long" for f in FP))


def plan(n: int, leaf: int, recall: float, design_distance: int) -> tuple[int, int]:
    """(depth, trees) for n fingerprints."""
    depth = max(1, log2_ceil(n / leaf))
    hit = (1 - design_distance / BITS) ** depth
    return depth, max(4, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a to all rows of b."""
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for q in range(1, LANES):
        total += np.bitwise_count(a[:, None, q] ^ b[None, :, q])
    return total


def close_pairs(fp: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j within the lesser of their limits; of a dense set, enough of them for the same components."""
    n = len(fp)
    if n > DENSE:
        d = distances(fp[:1], fp)[0]
        within = d <= np.minimum(limit[0], limit)
        inside, most = np.flatnonzero(within), int(limit.max())
        if len(inside) * 16 >= n:
            rest = np.flatnonzero(~within)
            a, b = [np.zeros(len(inside) - 1, np.int64)], [inside[1:]]
            near = rest[d[rest] <= 2 * most]
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                for to in range(0, len(inside), 8192):
                    other = inside[to : to + 8192]
                    x, y = np.nonzero(distances(fp[part], fp[other]) <= np.minimum(limit[part][:, None], limit[other]))
                    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
                    a.append(part[x[first]])
                    b.append(other[y[first]])
            x, y = close_pairs(fp[rest], limit[rest])
            return np.concatenate([*a, rest[x]]), np.concatenate([*b, rest[y]])
    left, right, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], int(limit.max(initial=0))
    rows, half = max(1, min((1 << 20) // max(n, 1), -(-n // 4))), LANES // 2
    for at in range(0, n, rows):
        a, b = fp[at : at + rows], fp[at:]
        # half of the bits for all, the others for the few pairs that may still be close
        d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
        for q in range(1, half):
            d += np.bitwise_count(a[:, None, q] ^ b[None, :, q])
        x, y = np.nonzero(d <= most)
        keep = y > x
        x, y = x[keep], y[keep]
        total = d[x, y].astype(np.uint16)
        for q in range(half, LANES):
            total += np.bitwise_count(a[x, q] ^ b[y, q])
        keep = total <= np.minimum(limit[at + x], limit[at + y])
        left.append(at + x[keep])
        right.append(at + y[keep])
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n items."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def nodes_at(key: np.ndarray, depth: int) -> np.ndarray:
    """First places of the nodes at a depth, and the end; key is sorted."""
    if depth <= 0:
        return np.array([0, len(key)])
    prefix = key >> np.uint32(32 - depth)
    return np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1], True])


def tree_edges(v: np.ndarray, key: np.ndarray, fp: np.ndarray, limit: np.ndarray, base: int, depth: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (vertex, root) of one subtree, whose fingerprints share `base` bits of the 32 in key."""
    order = np.lexsort((v, key))
    v, key, fp, limit = v[order], key[order], fp[order], limit[order]
    root = np.arange(len(v))

    def compare(nodes: list[tuple[int, int]], root: np.ndarray) -> np.ndarray:
        a, b = [np.arange(len(v))], [root]
        for lo, hi in nodes:
            if hi - lo > 1 and (root[lo:hi] != root[lo]).any():
                x, y = close_pairs(fp[lo:hi], limit[lo:hi])
                a.append(lo + x)
                b.append(lo + y)
        return local_roots(len(v), np.concatenate(a), np.concatenate(b)) if len(a) > 1 else root

    # long prefixes first: neighbours in the order of the keys
    near = np.uint32(max(0, 32 - depth - 8))
    for k in (1, 2):
        if len(v) > k:
            apart = sum(np.bitwise_count(fp[k:, q] ^ fp[:-k, q]).astype(np.uint16) for q in range(LANES))
            x = np.flatnonzero((key[k:] >> near == key[:-k] >> near) & (apart <= np.minimum(limit[k:], limit[:-k])))
            if len(x):
                root = local_roots(len(v), np.r_[np.arange(len(v)), x], np.r_[root, x + k])
    # then those at the depth that the recall asks for, or as far up as there are at most `leaf` fingerprints
    last = nodes_at(key, depth)
    final = set(zip(last[:-1].tolist(), last[1:].tolist()))
    for d in range(depth - 1, base - 1, -1):
        cut = nodes_at(key, d)
        below = np.searchsorted(last, cut)
        for lo, hi, x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), below[:-1].tolist(), below[1:].tolist()):
            if hi - lo <= leaf and y - x > 1:
                final -= {(int(last[k]), int(last[k + 1])) for k in range(x, y)}
                final.add((lo, hi))
        last = np.array(sorted({lo for lo, _ in final} | {len(v)}))
    root = compare(sorted(final), root)
    own = np.flatnonzero(root != np.arange(len(v)))
    return v[own], v[root[own]]


def edges(spark: SparkSession, nodes: DataFrame, *, leaf: int, recall: float, design_distance: int, most: int, most_short: int, seed: int = 11) -> DataFrame:
    """(u, v) with u > v: links that leave the components of all pairs found. nodes: (v, short, f0..f3), saved, distinct; v less than 2**62."""
    depth, trees = plan(nodes.count(), leaf, recall, design_distance)
    base = max(0, depth - 4)
    rng = np.random.default_rng(seed)
    permuted = [rng.choice(BITS, 32, replace=False) for _ in range(trees)]

    def keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
        for t, own in enumerate(permuted):
            key = np.ascontiguousarray(np.packbits(bits[:, own], axis=1)).view(">u4")[:, 0].astype(np.uint32)
            yield key, (key >> np.uint32(32 - base)).astype(np.int64) * trees + t if base else np.full(len(key), t, np.int64)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                for key, g in keys(np.stack([b.column(1 + q).to_numpy() for q in range(LANES)], axis=1)):
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(key.view(np.int32)), *b.columns], names=["g", "key", "v", *FP])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                g, n = np.unique(np.concatenate([g for _, g in keys(np.stack([b.column(1 + q).to_numpy() for q in range(LANES)], axis=1))]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    def search(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in group.column_names}
        limit = np.where(col["v"] & 1, most_short, most).astype(np.uint16)
        u, v = tree_edges(col["v"] >> 1, col["key"].view(np.uint32), np.stack([col[f] for f in FP], axis=1).view(np.uint64), limit, base, depth, leaf)
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    thin = nodes.select((F.col("v") * 2 + F.col("short").cast("long")).alias("v"), *FP)
    grown = thin.mapInArrow(grow, "g long, key int, v long, " + ", ".join(f"{f} long" for f in FP))
    hot = save(spark, thin.mapInArrow(sizes, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("g", F.ceil(F.col("n") / (HOT // 2)).alias("parts")), "hot-subtrees")
    by = ["g"]
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("v"), F.col("parts"))
        pair = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other)))
        grown, by = grown.join(hot, "g", "left").withColumn("pair", F.explode(pair)).drop("parts"), ["g", "pair"]
    return grown.groupBy(*by).applyInArrow(search, "u long, v long").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(v, c): the least vertex of the component of every vertex in a link, by alternating large and small stars.
    Every round is written to the shared folder."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    now, before = save(spark, links, "links"), None
    while True:
        now = save(spark, stars(stars(now, True), False), "links")
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("v"), F.col("v").alias("c"))


def decisions(spark: SparkSession, documents: DataFrame, *, leaf: int = 256, recall: float = 0.95, design_distance: int | None = None, max_distance: int = 56, short_distance: int = 44, seed: int = 11) -> DataFrame:
    """A saved table with a row for each key (doc_id, th): n, its rows; keep_id, keep_th, the key that stays in
    its place (itself, if it stays); distance, between the two fingerprints. design_distance: by default, the greatest accepted."""
    design_distance = max(max_distance, short_distance) if design_distance is None else design_distance
    fp = save(spark, fingerprints(documents).groupBy("doc_id", "th", "short", *FP).agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    nodes = save(spark, fp.groupBy(*FP).agg(F.max("short").alias("short")).withColumn("v", F.monotonically_increasing_id()), "nodes")
    found = components(spark, edges(spark, nodes, leaf=leaf, recall=recall, design_distance=design_distance, most=max_distance, most_short=short_distance, seed=seed))
    placed = fp.join(nodes.select("v", *FP), FP).join(found, "v", "left").withColumn("c", F.coalesce("c", "v"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", *FP)
    stays = placed.groupBy("c").agg(F.min(rank).alias("k"))
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"k.{f}"))) for f in FP), F.lit(0))
    out = placed.join(stays, "c").select("doc_id", "th", "n", F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"), apart.cast("int").alias("distance"))
    return save(spark, out, "near-duplicates")


def duplicates(spark: SparkSession, documents: DataFrame, **more) -> DataFrame:
    """(doc_id, duplicate_of, distance): every document that goes, with the one that stays in its place.
    Repeated rows of one document that go are listed with duplicate_of = doc_id."""
    d = decisions(spark, documents, **more)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))
    gone = d.withColumn("times", F.when(same, F.col("n") - 1).otherwise(F.col("n"))).where("times > 0")
    return gone.select("doc_id", F.col("keep_id").alias("duplicate_of"), "distance", F.explode(F.expr("sequence(1L, times)")).alias("time")).drop("time")


def keep_one(spark: SparkSession, documents: DataFrame, **more) -> DataFrame:
    """documents without its near-duplicates; all of its columns."""
    d = decisions(spark, documents, **more)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))
    todo = d.select("doc_id", "th", same.alias("stays"), "n").where("not stays or n > 1").select(F.col("doc_id").alias(P + "id"), F.col("th").alias(P + "h"), F.col("stays").alias(P + "stays"))
    keyed = documents.withColumn(P + "th", F.xxhash64("text"))
    on = F.col(P + "th").eqNullSafe(F.col(P + "h")) & F.col("doc_id").cast("long").eqNullSafe(F.col(P + "id")) & F.col("text").isNotNull()
    out = keyed.join(todo.where(~F.col(P + "stays")), on, "left_anti")
    if not todo.where(P + "stays").isEmpty():
        joined = out.join(todo, on, "left")
        once = joined.where(F.col(P + "stays")).dropDuplicates([P + "id", P + "h"])
        out = joined.where(F.col(P + "stays").isNull()).unionByName(once)
    return out.select(*documents.columns)
