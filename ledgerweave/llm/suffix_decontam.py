"""Benchmark decontamination by suffix arrays over the training text.

The training text is cut into shards, each of whole documents. A shard's words (lower-cased runs of
letters and digits, so that spacing and punctuation don't matter) get a suffix array, by prefix
doubling up to the length of the longest benchmark item: no search looks further. Every suffix of
every benchmark item is searched in it, by binary search: first the interval of the suffixes that share its
first `min_words` words (or the whole item, if it is shorter), narrowed word by word, then its own place in the
order of the interval. Those that share most with it stand next to that place, so that one look to either side
gives its longest match in each document of the interval. The work is one step for each suffix and document, not
for each pair of places, and repetitive texts stay cheap. The longest match of each document and item is
reported with its place in both, and documents with a match are removed. A suffix whose first words stand nowhere
in a shard isn't searched in it; the hashes of all runs of words of that length tell, so that the work for a shard
doesn't grow with the benchmark.

Items of fewer than `least_words` words say too little to be searched within texts: they match the documents
that consist of the same words and nothing else. Defined results: null and empty texts match nothing; null items
and items without any word are left out; of equal lengths the match earliest in the document, then in the item, is
reported; repeated rows are reported once each; a text longer than a shard is a shard of its own. Columns beside
doc_id and text pass through. Without benchmark items, nothing is removed. Words, and runs of words, are
compared by 64-bit hashes. doc_id must be castable to long in `contaminated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.textnp import mix, powers, sequence_prefix, slices, words

SHARD_BYTES, BROADCAST_BYTES, STEPS = 2 << 20, 64 << 20, 1 << 20


def bisect(lo: np.ndarray, hi: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For every row the first number in [lo, hi) that passes, or hi; test(rows, numbers) passes from some number on."""
    lo, hi = lo.copy(), hi.copy()
    while (todo := np.flatnonzero(lo < hi)).size:
        mid = (lo[todo] + hi[todo]) >> 1
        ok = test(todo, mid)
        hi[todo[ok]], lo[todo[~ok]] = mid[ok], mid[~ok] + 1
    return lo


class Sequence:
    """Tokens with the hash of any run of them in constant time."""

    def __init__(self, tokens: np.ndarray):
        self.prefix, self.inverse = sequence_prefix(tokens), powers(len(tokens) + 1, inverse=True)

    def hash(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[at + n] - self.prefix[at]) * self.inverse[at])


class SuffixArray:
    """Suffixes of tokens (unsigned 64-bit), sorted by their first `depth` tokens; token 0 separates documents."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.alphabet, code = np.unique(tokens, return_inverse=True)
        n = len(tokens)
        self.code = np.append(code.astype(np.int64), -1)
        key = (self.code[:-1] + 1 << 32) | (self.code[1:] + 1)
        sa = np.argsort(key)
        fresh = np.empty(n, bool)
        rank = np.full(n + 1, -1, np.int64)
        if n:
            ordered = key[sa]
            fresh[0], fresh[1:] = True, ordered[1:] != ordered[:-1]
            rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        k = 2
        while k < depth and n:
            alone = fresh & np.append(fresh[1:], True)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            own = sa[slots]
            key = rank[own] * (n + 2) + rank[np.minimum(own + k, n)] + 1
            order = np.argsort(key)
            sa[slots], key = own[order], key[order]
            first = np.append(True, key[1:] != key[:-1])
            fresh[slots] = first
            rank[sa[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            k *= 2
        self.sa = sa

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Codes of tokens in this array; -2 for those that don't occur."""
        at = np.minimum(np.searchsorted(self.alphabet, tokens), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == tokens, at, -2) if len(self.alphabet) else np.full(len(tokens), -2)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, ahead: int, want: np.ndarray, after: bool) -> np.ndarray:
        lo, hi, n = lo.copy(), hi.copy(), len(self.sa)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            have = self.code[np.minimum(self.sa[mid] + ahead, n)]
            right = have <= want[todo] if after else have < want[todo]
            lo[todo[right]], hi[todo[~right]] = mid[right] + 1, mid[~right]
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def intervals(self, query: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with query[start:start + depth]; query holds codes."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.sa), np.int64)
        for t in range(int(depth.max(initial=0))):
            own = np.flatnonzero((depth > t) & (lo < hi))
            if not len(own):
                break
            want = query[start[own] + t]
            a = self._bound(lo[own], hi[own], t, want, False)
            lo[own], hi[own] = a, self._bound(a, hi[own], t, want, True)
        return lo, hi


class Bench:
    """Words of the benchmark items."""

    def __init__(self, ids: list, texts: list[str], min_words: int, least_words: int):
        arr = pa.array(texts, pa.string())
        h, own = [], []
        for i, j, data, offs in slices(arr):
            x, t, _, _ = words(data, offs)
            h.append(x | np.uint64(1))
            own.append(t + i)
        self.token = np.concatenate(h) if h else np.zeros(0, np.uint64)
        item = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.count = np.bincount(item, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        end = np.cumsum(self.count)
        self.first = end - self.count
        need = np.minimum(min_words, self.count)[item]
        start = np.arange(len(item))
        fits = (end[item] - start >= need) & (self.count[item] >= least_words)
        self.start, self.need, self.item, self.end = start[fits], need[fits], item[fits], end[item[fits]]
        self.ids, self.longest, self.least_words = ids, int(self.count.max(initial=0)), least_words

    @cached_property
    def sequence(self) -> Sequence:
        return Sequence(self.token)

    @cached_property
    def grams(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words that are needed: it, the hashes of the suffixes' first words in order, whose they are, and marks for the hashes' last bits."""
        out = []
        for n in np.unique(self.need).tolist():
            rows = np.flatnonzero(self.need == n)
            key = self.sequence.hash(self.start[rows], n)
            order = np.argsort(key, kind="stable")
            mark = np.zeros(1 << 22, bool)
            mark[key & np.uint64(len(mark) - 1)] = True
            out.append((n, key[order], rows[order], mark))
        return out

    @cached_property
    def whole(self) -> dict[tuple[int, int], list[int]]:
        """(words, hash) -> items, of those that have to be the whole text."""
        out: dict[tuple[int, int], list[int]] = {}
        own = np.flatnonzero((self.count > 0) & (self.count < self.least_words))
        for i, key in zip(own.tolist(), self.sequence.hash(self.first[own], self.count[own]).tolist()):
            out.setdefault((int(self.count[i]), key), []).append(i)
        return out

    def wanted(self, shard: Sequence) -> np.ndarray:
        """The suffixes whose first words stand somewhere in the shard."""
        out = [np.zeros(0, np.int64)]
        for n, key, rows, mark in self.grams:
            have = shard.hash(np.arange(max(0, len(shard.prefix) - n)), n)
            have = np.unique(have[mark[have & np.uint64(len(mark) - 1)]])
            lo, hi = np.searchsorted(key, have), np.searchsorted(key, have, "right")
            out.append(rows[spread(lo, hi)[1]])
        return np.sort(np.concatenate(out))

    def matches(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, item number, words, first word in the text, first word in the item), the longest of each text and item."""
        h, text, _, _ = words(data, offs)
        if not len(h) or not len(self.token):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        fresh = np.r_[True, text[1:] != text[:-1]]
        cut, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        place = np.arange(len(h)) + number
        tokens, of = np.zeros(len(h) + len(cut), np.uint64), np.full(len(h) + len(cut), -1, np.int64)
        tokens[place], of[place] = h | np.uint64(1), number
        first, size, shard = place[cut], np.diff(np.r_[cut, len(h)]), Sequence(tokens)
        found = []
        short = np.flatnonzero(size < self.least_words) if self.whole else cut[:0]
        for d, n, key in zip(short.tolist(), size[short].tolist(), shard.hash(first[short], size[short]).tolist()):
            found += [(d, i, n, 0, 0) for i in self.whole.get((n, key), ())]
        out = [np.array(found, np.int64).reshape(-1, 5).T]
        own = self.wanted(shard)
        if len(own):
            array = SuffixArray(tokens, self.longest)
            query = array.codes(self.token)
            lo, hi = array.intervals(query, self.start[own], self.need[own])
            hit = np.flatnonzero(lo < hi)
            own, lo, hi = own[hit], lo[hit], hi[hit]
            # all suffixes of an item together; a portion has about STEPS pairs of a suffix and a document
            _, size = documents_in(array, of, lo, hi)
            total = np.cumsum(size)
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + STEPS, "right")))
                to = int(np.searchsorted(self.item[own], self.item[own[to - 1]], "right"))
                out.append(self.longest_matches(array, query, shard, of, first, own[at:to], lo[at:to], hi[at:to]))
                at = to
        doc, item, n, x, y = np.concatenate(out, axis=1)
        return text[cut][doc], item, n, x, y

    def longest_matches(self, array: SuffixArray, query: np.ndarray, shard: Sequence, of: np.ndarray, first: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The longest match of each document and item. own: suffixes of the benchmark, [lo, hi): their intervals, of: each token's document, first: each document's first token."""
        q, end, need, n = self.start[own], self.end[own], self.need[own], len(of)

        def shared(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Words that suffixes own[rows] have in common with the shard from `at`, need at least."""
            most = np.minimum(end[rows] - q[rows], n - at)
            return bisect(need[rows], most, lambda r, k: self.sequence.hash(q[rows[r]], k + 1) != shard.hash(at[r], k + 1))

        def not_less(r: np.ndarray, slot: np.ndarray) -> np.ndarray:
            at = array.sa[slot]
            k = shared(r, at)
            return (q[r] + k >= end[r]) | (array.code[np.minimum(at + k, n)] > query[np.minimum(q[r] + k, len(query) - 1)])

        place = bisect(lo, hi, not_less)
        docs, size = documents_in(array, of, lo, hi)
        s, d = np.repeat(np.arange(len(own)), size), docs
        # the array's slots in the intervals, document by document
        slot = np.unique(spread(*np.unique(np.c_[lo, hi], axis=0).T)[1])
        key = np.sort(of[array.sa[slot]] * n + slot)
        spot = array.sa[key % n]
        mid, a, b = (np.searchsorted(key, d * n + x[s]) for x in (place, lo, hi))
        best = np.zeros(len(s), np.int64)
        for at, ok in ((mid - 1, mid > a), (mid, mid < b)):
            best[ok] = np.maximum(best[ok], shared(s[ok], spot[at[ok]]))
        group = self.item[own[s]] * (int(of.max()) + 1) + d
        order = np.lexsort((-best, group))
        lead = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        top = np.empty(len(s), np.int64)
        top[order] = np.repeat(best[order][lead], np.diff(np.r_[lead, len(s)]))
        s, d, best, mid, a, b, group = (x[best == top] for x in (s, d, best, mid, a, b, group))

        def same(r: np.ndarray, k: np.ndarray) -> np.ndarray:
            fits = spot[k] + best[r] <= n
            return fits & (self.sequence.hash(q[s[r]], best[r]) == shard.hash(np.where(fits, spot[k], 0), np.where(fits, best[r], 0)))

        # the document's places with the whole match lie side by side; the earliest is wanted
        a, b = bisect(a, mid, same), bisect(mid, b, lambda r, k: ~same(r, k))
        earliest = np.minimum.reduceat(np.append(spot, n), np.c_[a, b].ravel())[::2]
        order = np.lexsort((q[s], earliest, group))
        win = order[np.r_[True, group[order][1:] != group[order][:-1]]]
        item = self.item[own[s[win]]]
        return np.stack([d[win], item, best[win], earliest[win] - first[d[win]], q[s[win]] - self.first[item]])


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the interval, number in it) for all numbers of the intervals [lo, hi)."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[row]


def documents_in(array: SuffixArray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of each interval, one after the other, and their numbers. Equal intervals are looked at once, and those of one
    depth don't overlap."""
    kinds, kind = np.unique(np.c_[lo, hi], axis=0, return_inverse=True)
    row, slot = spread(kinds[:, 0], kinds[:, 1])
    docs = int(of.max()) + 1
    seen = np.unique(row * docs + of[array.sa[slot]])
    begin = np.searchsorted(seen, np.arange(len(kinds) + 1) * docs)
    kind = kind.ravel()
    _, at = spread(begin[kind], begin[kind + 1])
    return seen[at] % docs, np.diff(begin)[kind]


def benches(benchmark: DataFrame, min_words: int, least_words: int) -> list[Bench]:
    """The benchmark in portions of at most BROADCAST_BYTES of text: each is sent to the tasks and takes one pass."""
    out, ids, texts, size = [], [], [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if size > BROADCAST_BYTES:
            out.append(Bench(ids, texts, min_words, least_words))
            ids, texts, size = [], [], 0
    if ids or not out:
        out.append(Bench(ids, texts, min_words, least_words))
    return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_words: int = 13, least_words: int = 5) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): for each affected document and item the longest verbatim match."""
    parts = []
    for bench in benches(benchmark, min_words, least_words):
        sent = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            ids = pa.array(b.ids, pa.int64())
            for batch in batches:
                for i, _, data, offs in slices(batch.column(1), SHARD_BYTES):
                    doc, item, n, x, y = b.matches(data, offs)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), ids.take(pa.array(item)), *(pa.array(v) for v in (n, x, y))], names=["doc_id", "item_id", "words", "doc_word", "item_word"])

        rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        parts.append(rows.mapInArrow(run, "doc_id long, item_id long, words long, doc_word long, item_word long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_words: int = 13, least_words: int = 5) -> DataFrame:
    """docs without the affected ones; all of its columns."""
    for bench in benches(benchmark, min_words, least_words):
        sent = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, offs in slices(batch.column(batch.schema.get_field_index("text")), SHARD_BYTES):
                    keep[i + b.matches(data, offs)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"


def _grams(table: str, key: str) -> str:
    following = ", ".join(f"lead(w, {k}) OVER x" for k in range(1, 5))
    return f"""SELECT *, CASE WHEN lead(w, 4) OVER x IS NOT NULL THEN concat_ws(' ', w, {following}) END AS g
    FROM (SELECT r, {key}, n, unnest(w) AS w, unnest(range(n)) AS i FROM (SELECT r, {key}, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL)))
    WINDOW x AS (PARTITION BY r ORDER BY i)"""


#: For the default parameters: runs of matching 5-grams along a diagonal are verbatim matches.
SQL = f"""
WITH d AS ({_grams("documents", "doc_id")}), b AS ({_grams("benchmark", "item_id")}),
hits AS (SELECT d.r AS dr, b.r AS br, d.doc_id, b.item_id, b.n, d.i, d.i - b.i AS diagonal FROM d JOIN b ON d.g = b.g WHERE b.n >= 5),
runs AS (
    SELECT dr, br, doc_id, item_id, n, diagonal, min(i) AS doc_word, count(*) + 4 AS words
    FROM (SELECT *, i - row_number() OVER (PARTITION BY dr, br, diagonal ORDER BY i) AS island FROM hits)
    GROUP BY dr, br, doc_id, item_id, n, diagonal, island
)
SELECT doc_id, item_id, words, doc_word, doc_word - diagonal AS item_word FROM runs WHERE words >= least(13, n)
QUALIFY row_number() OVER (PARTITION BY dr, br ORDER BY words DESC, doc_word, doc_word - diagonal) = 1
UNION ALL SELECT doc_id, item_id, len(b.w), 0, 0
FROM (SELECT doc_id, {_WORDS} AS w FROM documents) d JOIN (SELECT item_id, {_WORDS} AS w FROM benchmark) b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND 4
"""
