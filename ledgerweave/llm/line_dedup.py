"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line equals it, or, for lines of SHORT characters and more, if an earlier
one is within one edit of it (one character inserted, deleted or replaced). Earlier: lesser in
(doc_id, hash of the text, line number), null doc_ids last. Whether the earlier line itself goes
doesn't matter. The earliest such line is what the line is a copy of.

Two lines are within one edit exactly if deleting one character at the same place of both gives the
same variant, or if deleting one from the longer gives the shorter. So each line emits all variants
with at most one deletion as hashed keys (with the place), and the earliest line of each key is found by a minimum: no pairs are built however
many lines share a key. What is found is verified by the edit distance of the two lines.

So that not every character of the corpus becomes a row, a line first emits a few coarse keys: it
is cut into blocks, and a key is the line without one stretch of one to two blocks. Lines within
one edit share a key, namely one without the stretch with the edit (prefixes are counted from the
start, suffixes from the end, so an insertion shifts nothing; a length at which the cut changes is
emitted for both cuts). Only lines that share a coarse key with another line go on to finer blocks,
and only the characters of a stretch that is shared there are deleted one by one. Both filters are exact.

Lines are told apart by 128 bits of two hashes.

Defined results: blank lines stay, and a null text stays null. Rows with equal doc_id and text are
one document, and all get its result. An empty table gives an empty result. Columns beside doc_id
and text pass through; helper columns start with `__lw_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import P, save
from ledgerweave.llm.textnp import _BYTE, _RINV, powers, slices
from ledgerweave.llm.textnp import mix as mixed

SHORT = 10
_C = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_OTHER = np.random.default_rng(0x11AE5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Lines:
    """The lines of some texts, with the hash of any stretch of their characters in constant time."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, whole: bool = False):
        """whole: every text is one line."""
        n = len(data)
        self.offs = offs
        cut = np.zeros(0, np.int64) if whole else np.flatnonzero(data == 10)
        start, text = np.r_[offs[:-1], cut + 1], np.r_[np.arange(len(offs) - 1), np.searchsorted(offs, cut, "right") - 1]
        order = np.lexsort((start, text))
        self.start, self.text = start[order], text[order]
        self.end = np.r_[self.start[1:] - 1, n] if len(self.start) else self.start
        last = np.r_[self.text[1:] != self.text[:-1], True] if len(self.text) else np.zeros(0, bool)
        self.end[last] = offs[self.text[last] + 1]
        self.number = np.arange(len(self.text)) - np.searchsorted(self.text, self.text, "left")
        lead = (data & 0xC0) != 0x80
        self.place = np.append(np.flatnonzero(lead), n)
        count = np.zeros(n + 1, np.int64)
        np.cumsum(lead, out=count[1:])
        self.first, self.chars = count[self.start], count[self.end] - count[self.start]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n), out=self.prefix[1:], dtype=np.uint64)
        self.inverse = powers(n + 1, inverse=True)
        self.data = data

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.inverse[a]

    def whole(self) -> np.ndarray:
        return mixed(self.span(self.start, self.end))

    def second(self) -> np.ndarray:
        """Another hash of the whole lines, by other values of the bytes, with their length."""
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_OTHER[self.data] * powers(len(self.data)), out=prefix[1:], dtype=np.uint64)
        return mixed((prefix[self.end] - prefix[self.start]) * self.inverse[self.start] ^ (self.end - self.start).astype(np.uint64) * _C[1])

    def blank(self) -> np.ndarray:
        space = np.isin(self.data, np.frombuffer(b" \t\r\x0b\x0c", np.uint8))
        count = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~space, out=count[1:])
        return count[self.end] == count[self.start]

    def keys(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, first and last + 1 character of the stretch left out) for the lines of SHORT characters and more."""
        own = np.flatnonzero(self.chars >= SHORT)
        n = self.chars[own]
        b, m = cuts(n, parts)
        b2, m2 = cuts(n - 1, parts)
        more = ((b != b2) | (m != m2)) & (n > SHORT)
        own, b, m = np.r_[own, own[more]], np.r_[b, b2[more]], np.r_[m, m2[more]]
        line = np.repeat(np.arange(len(own)), m + 1)
        i = np.arange(len(line)) - np.repeat(np.cumsum(m + 1) - (m + 1), m + 1)
        b, m, own = b[line], m[line], own[line]
        lo, hi = i * b, self.chars[own] - (m - i) * b
        left = self.span(self.start[own], self.place[self.first[own] + lo])
        right = self.span(np.minimum(self.place[self.first[own] + hi], self.end[own]), self.end[own])
        return own, mixed(left * _C[0] + mixed(right) * _C[1] + (i.astype(np.uint64) << np.uint64(32) | m.astype(np.uint64)) * _C[2] + b.astype(np.uint64) * _C[3]), lo, hi

    def variants(self, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, place) of the lines without one of their characters lo..hi-1."""
        size = hi - lo
        line = np.repeat(own, size)
        at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        a = self.place[self.first[line] + at]
        b = np.minimum(self.place[self.first[line] + at + 1], self.end[line])
        shift = np.array([pow(int(_RINV), k, 2**64) for k in range(8)], np.uint64)[b - a]
        s, e = self.start[line], self.end[line]
        whole = ((self.prefix[a] - self.prefix[s]) + (self.prefix[e] - self.prefix[b]) * shift) * self.inverse[s]
        return line, mixed(whole), at


def cuts(n: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Block length, a power of two, and number of blocks kept, for lines of n characters."""
    b = (1 << np.ceil(np.log2(np.maximum(n, 1) / parts)).clip(0).astype(np.int64)).clip(1 if parts > 4 else 2)
    return b, np.maximum(n // b - 1, 0)


ORDER = ("d0", "d", "th", "ln")


def _positions(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(h, g, keys, p): every distinct line that isn't blank, and its earliest place p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column(2)):
                x = Lines(data, offs)
                own, key, _, _ = x.keys(4)
                order = np.argsort(own, kind="stable")
                keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[order], np.arange(len(x.text) + 1)).astype(np.int32)), pa.array(key[order].view(np.int64)))
                b = batch.slice(i, j - i)
                out = pa.RecordBatch.from_arrays([pa.array(x.whole().view(np.int64)), pa.array(x.second().view(np.int64)), keys, b.column(0).take(pa.array(x.text)), b.column(1).take(pa.array(x.text)), pa.array(x.number.astype(np.int32))], names=["h", "g", "keys", "d", "th", "ln"])
                yield out.filter(pa.array(~x.blank()))

    lines = _positions(docs).mapInArrow(run, "h long, g long, keys array<long>, d long, th long, ln int")
    place = F.struct(F.col("d").isNull().alias("d0"), "d", "th", "ln")
    return lines.groupBy("h", "g").agg(F.min(place).alias("p"), F.first("keys").alias("keys"))


def _shared(keys: DataFrame) -> DataFrame:
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "key", "left_semi")


def near_copies(spark: SparkSession, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, g, of): the lines that an earlier line is within one edit of, and the earliest such line's place."""
    survivors = _shared(first.select("h", "g", F.explode("keys").alias("key"))).select("h", "g").distinct()
    wanted = first.join(survivors, ["h", "g"], "left_semi").select("h", "g", "p.*").groupBy("d", "th").agg(F.collect_list(F.struct("ln", "h", "g")).alias("lines"))
    rows = _positions(docs).join(wanted.withColumnsRenamed({"d": "wd", "th": "wth"}), F.col("d").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wth")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("h", "g", "d", "th", "ln", "line")}
            for d, th, text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                parts = text.as_py().split("\n")
                for x in lines:
                    for c, v in (("h", x["h"]), ("g", x["g"]), ("d", d), ("th", th), ("ln", x["ln"]), ("line", parts[x["ln"]])):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("g", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("ln", pa.int32()), ("line", pa.string())]))

    fetched = rows.select("d", "th", "text", "lines").mapInArrow(fetch, "h long, g long, d long, th long, ln int, line string")
    lines = save(spark, fetched.dropDuplicates(["h", "g"]).withColumn("p", F.struct(F.col("d").isNull().alias("d0"), "d", "th", "ln")).select("h", "g", "p", "line"), "near-lines")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column(2)):
                x = Lines(data, offs, whole=True)
                own, key, lo, hi = x.keys(64)
                h, g = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([h.take(pa.array(own)), g.take(pa.array(own)), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["h", "g", "key", "lo", "hi"])

    stretches = _shared(lines.select("h", "g", "line").mapInArrow(fine, "h long, g long, key long, lo int, hi int")).groupBy("h", "g").agg(F.array_distinct(F.collect_list(F.struct("lo", "hi"))).alias("stretches"))

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column(3)):
                x = Lines(data, offs, whole=True)
                lists = batch.column(4).slice(i, j - i)
                size, flat = lists.value_lengths().to_numpy(), lists.flatten()
                own = np.repeat(np.arange(j - i), size)
                line, key, place = x.variants(own, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64))
                line, key, place = np.r_[line, np.arange(j - i)], np.r_[key, x.whole()], np.r_[place, np.full(j - i, -1)]
                b = batch.slice(i, j - i)
                at = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], names=["key", "place", "h", "g", "p"])

    kind = "struct<d0:boolean,d:bigint,th:bigint,ln:int>"
    varied = lines.join(stretches, ["h", "g"]).select("h", "g", "p", "line", "stretches").mapInArrow(vary, f"key long, place int, h long, g long, p {kind}")
    at_key, at_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    least = F.least(F.min("p").over(at_place), F.min(F.when(F.col("place") < 0, F.col("p"))).over(at_key))
    found = varied.withColumn("of", F.when(F.col("place") < 0, F.min("p").over(at_key)).otherwise(least)).where("of < p").groupBy("h", "g").agg(F.min("of").alias("of"))
    checked = found.join(lines.select("h", "g", "line"), ["h", "g"]).join(lines.select(F.col("p").alias("of"), F.col("line").alias("other")), "of")
    return checked.where(F.levenshtein("line", "other", 1).between(0, 1)).select("h", "g", "of")


def decisions(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct lines with their earliest places, and the near copies among them; both saved."""
    first = save(spark, distinct_lines(docs), "lines")
    return first, save(spark, near_copies(spark, docs, first), "near-copies")


def dedup(spark: SparkSession, docs: DataFrame, removed: str = P + "removed") -> DataFrame:
    """docs with the lines that stay, and the number of lines that went."""
    first, near = decisions(spark, docs)
    kept = first.join(near, ["h", "g"], "left_anti").select("p.*").groupBy("d", "th").agg(F.collect_list("ln").alias(P + "kept")).withColumnsRenamed({"d": P + "d", "th": P + "t"})

    @F.pandas_udf("text string, removed int")
    def rebuild(text, kept):
        import pandas as pd

        out, gone = [], []
        for t, own in zip(text, kept):
            if t is None:
                out.append(None)
                gone.append(0)
                continue
            parts = t.split("\n")
            stay = set() if own is None else set(own.tolist())
            left = [x for i, x in enumerate(parts) if i in stay or not x.strip(" \t\r\x0b\x0c")]
            out.append("\n".join(left))
            gone.append(len(parts) - len(left))
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "removed": gone})

    keyed = docs.withColumn(P + "th", F.xxhash64("text"))
    joined = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(P + "d")) & (F.col(P + "th") == F.col(P + "t")), "left")
    new = joined.withColumn(P + "new", rebuild(F.col("text").cast("string"), F.col(P + "kept")))
    return new.select(*(F.col(P + "new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns), F.col(P + "new.removed").alias(removed))


QUERY_COLUMNS = ("doc_id", "text", "lines_removed")

SQL = """
WITH lines AS (
    SELECT doc_id, i, parts[i + 1] AS line FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), place AS (
    SELECT line, min((doc_id, i)) AS p FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY line
), cut AS (
    SELECT line, p, length(line) AS n, k AS c, CAST(pow(2, ceil(log2((length(line) - k) / 4.0))) AS BIGINT) AS b
    FROM place, (VALUES (0), (1)) v(k) WHERE length(line) - k >= 10
), keys AS (
    SELECT DISTINCT line, p, md5(concat(b, ':', m, ':', i, ':', substr(line, 1, i * b), chr(10), substr(line, n - (m - i) * b + 1))) AS h
    FROM (SELECT *, unnest(range(0, m + 1)) AS i FROM (SELECT *, (n - c) // b - 1 AS m FROM cut))
), near AS (
    SELECT DISTINCT a.line FROM keys a JOIN keys z ON a.h = z.h AND z.p < a.p WHERE levenshtein(a.line, z.line) <= 1
), flagged AS (
    SELECT l.doc_id, l.i, l.line, trim(l.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = '' OR (l.doc_id = p.p[1] AND l.i = p.p[2] AND n.line IS NULL) AS stays
    FROM lines l LEFT JOIN place p ON l.line = p.line LEFT JOIN near n ON l.line = n.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS lines_removed
FROM flagged GROUP BY doc_id
"""
