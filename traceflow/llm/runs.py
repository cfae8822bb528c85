"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words that repeats with a smallest period q at least twice over and can't be made longer keeping q. The suffixes
of all texts of a slice are sorted by prefix doubling; the ranks of each doubling are kept and give the LCP array. Each LCP interval of depth d
is a branching word of d symbols; its child intervals but the largest are walked, and a suffix i is looked up at ISA[i + d] and ISA[i - d]: where that
lies in the interval but in another child, a square with a root of d words begins at i (or i - d), and its right end can't move on. A square
is then rotated to the left, 2^k words at a time where the kept ranks agree, which gives its run; runs of the same
stretch are merged under the smallest period. There are no tree nodes: children are ranges of the arrays.

Words run between the white space of ASCII and are compared as they are. A text is looked at whole, in the task that reads it: nothing is shuffled.
Memory of a task is that of a slice of SLICE_WORDS words, or of one longer text: about 4 bytes for each word and doubling, and 20 arrays.

Defined results: null and empty texts have no words and no runs, and stay null or empty; rows that repeat an id are reported each, null ids too;
ties between runs are kept, all runs are returned in order of start and period; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spread

#: Words that are sorted together (one longer text is taken alone), and suffixes of smaller children that are looked up at once.
SLICE_WORDS, LOOK = 1 << 18, 1 << 20
SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """The words of a text; none of a null."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def _heads(x: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


class SuffixArray:
    """Suffixes of symbols, of which the last of each text occurs once.

    levels[k]: ranks by the first 2^k symbols (a rank is the first place of its group); sa, isa: places; lcp[p]: common symbols of the suffixes at p - 1 and p, with a 0 at both ends.
    """

    def __init__(self, symbol: np.ndarray):
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")
        head = _heads(symbol[order])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels = [rank]
        left = order[~(head & np.append(head[1:], True))]
        while len(left):
            key = rank[left].astype(np.int64) * n + rank[left + (1 << len(self.levels) - 1)]
            by = np.argsort(key, kind="stable")
            left, key = left[by], key[by]
            head, at = _heads(key), np.arange(len(left))
            within = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(_heads(rank[left]), at, 0))
            fresh = rank[left] + within
            rank = rank.copy()
            rank[left] = fresh
            self.levels.append(rank)
            left = left[~(head & np.append(head[1:], True))]
        self.isa = rank
        self.sa = np.empty(n, np.int32)
        self.sa[rank] = np.arange(n, dtype=np.int32)
        self.lcp = np.zeros(n + 1, np.int32)
        p = np.flatnonzero(self.levels[0][self.sa[1:]] == self.levels[0][self.sa[:-1]]) + 1
        self.lcp[p] = self.common(self.sa[p - 1].astype(np.int64), self.sa[p].astype(np.int64))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes i and j, which differ, have in common."""
        d = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            d[rank[i + d] == rank[j + d]] += 1 << k
        return d

    def rotated(self, start: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Where squares of root d at start come to when they are rotated to the left as far as they stay squares."""
        start = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, at = self.levels[k], start - (1 << k)
            ok = np.flatnonzero(at >= 0)
            ok = ok[rank[at[ok]] == rank[at[ok] + d[ok]]]
            start[ok] = at[ok]
        return start

    def _intervals(self) -> tuple[np.ndarray, ...]:
        """Each place p of the LCP array with lcp[p] > 0, in order of its interval and place: p, and the interval's first and behind-last suffix."""
        inside = self.lcp > 0
        near = inside.copy()
        near[:-1] |= inside[1:]
        near[1:] |= inside[:-1]
        place = np.flatnonzero(near)  # stretches of common symbols, with the 0 at both ends of each
        c = self.lcp[place]
        x = np.flatnonzero(c)
        longest = int(np.diff(np.flatnonzero(c == 0)).max(initial=1))
        least = [c]
        while (2 << len(least) - 1) <= longest:
            half = 1 << len(least) - 1
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        low, high = x.copy(), x + 1
        for k in range(len(least) - 1, -1, -1):
            at = low - (1 << k)
            ok = np.flatnonzero(at >= 0)
            ok = ok[least[k][at[ok]] >= c[x[ok]]]
            low[ok] = at[ok]
            ok = np.flatnonzero(high + (1 << k) <= len(c))
            ok = ok[least[k][high[ok]] >= c[x[ok]]]
            high[ok] += 1 << k
        first, end = place[low - 1], place[low - 1] + (high - low + 1)
        by = np.argsort(first * np.int64(len(self.lcp) + 1) + end, kind="stable")
        return place[x[by]], first[by], end[by]

    def children(self) -> tuple[np.ndarray, ...]:
        """Child intervals but the largest of each interval: from, to, the interval's from, to and depth."""
        p, first, end = self._intervals()
        if not len(p):
            return (p,) * 5
        head = _heads(first) | _heads(end)
        group = np.cumsum(head) - 1
        lead = np.flatnonzero(head)
        a = np.empty(len(p) + len(lead), np.int64)
        z = a.copy()
        at = np.arange(len(p)) + group
        a[at + 1], z[at] = p, p
        begin = lead + np.arange(len(lead))
        a[begin] = first[lead]
        z[np.append(begin[1:], len(a)) - 1] = end[lead]
        owner = np.repeat(np.arange(len(lead)), np.diff(np.append(begin, len(a))))
        big = np.flatnonzero((z - a) == np.maximum.reduceat(z - a, begin)[owner])
        keep = np.ones(len(a), bool)
        keep[big[_heads(owner[big])]] = False
        owner = owner[keep]
        return a[keep], z[keep], first[lead][owner], end[lead][owner], self.lcp[p[lead]][owner].astype(np.int64)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and root length of the squares whose right end can't move on."""
        a, z, first, end, depth = self.children()
        total = np.append(0, np.cumsum(z - a))
        starts, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, total[i] + LOOK, "right")) - 1)
            n = (z - a)[i:j]
            of = np.repeat(np.arange(i, j), n)
            suffix = self.sa[np.repeat(a[i:j] - (total[i:j] - total[i]), n) + np.arange(total[j] - total[i])].astype(np.int64)
            for side in (1, -1):
                other = suffix + side * depth[of]
                ok = np.flatnonzero((other >= 0) & (other < len(self.isa)))
                o, at = of[ok], self.isa[other[ok]]
                ok = ok[(at >= first[o]) & (at < end[o]) & ((at < a[o]) | (at >= z[o]))]
                starts.append(np.minimum(suffix[ok], other[ok]))
                roots.append(depth[of[ok]])
            i = j
        return np.concatenate(starts), np.concatenate(roots)

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and period of the runs of at least `least` symbols, in order of start and period."""
        start, root = self.squares()
        end = start + 2 * root
        start = self.rotated(start, root)
        long = end - start >= least
        start, end, root = start[long], end[long], root[long]
        by = np.lexsort((root, end, start))
        start, end, root = start[by], end[by], root[by]
        new = _heads(start) | _heads(end)
        start, end, root = start[new], end[new], root[new]
        by = np.lexsort((root, start))
        return start[by], end[by], root[by]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_WORDS, "right")) - 1)
        yield a, b
        a = b


def find_runs(values: pa.Array, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of texts whose words are values[offsets[i]:offsets[i + 1]]: text, start (from the text's beginning), length, period."""
    rows = len(offsets) - 1
    code = values.dictionary_encode()
    n = len(code.dictionary) + 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    symbol = np.empty(len(values) + rows, np.int64)
    symbol[np.arange(len(values)) + row] = row * n + code.indices.to_numpy()
    last = offsets[1:] + np.arange(rows)
    symbol[last] = np.arange(rows) * n + n - 1  # a text's end occurs once
    start, end, period = SuffixArray(symbol).runs(least)
    of = np.searchsorted(last, start)
    return of, start - offsets[of] - of, end - start, period


def _kept(values: int, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run covers after its first period."""
    step = np.zeros(values + 1, np.int64)
    np.add.at(step, at + period, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step)[:values] == 0


_RUN = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, runs (start, length, period in words), and text with each run cut
    to its first period, its words joined by one space."""

    def collapse(batches):
        for batch in batches:
            column = batch.column("w")
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, offsets = column.flatten(), np.append(0, np.cumsum(size))
            for a, b in _slices(offsets):
                own, at = values.slice(offsets[a], offsets[b] - offsets[a]), offsets[a : b + 1] - offsets[a]
                row, start, length, period = find_runs(own, at, least)
                keep = _kept(len(own), at[row] + start, length, period)
                left = np.append(0, np.cumsum(keep))[at].astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), own.filter(pa.array(keep))), " ")
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at)), lists, text], names=["doc_id", "n_words", "runs", "text"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", words("text").alias("w")).mapInArrow(collapse, _RUN)


def looped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a period put into about a tenth of the texts, chosen by the checksum of doc_id: from word a on,
    word i becomes word a + (i - a) % p. The words of these texts are joined by one space; texts of a null id stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words("text")).alias("w"), g.alias("g")).withColumn("n", F.size("w"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    cut = cut.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    places = F.sequence(F.lit(0), F.col("n") - 1)
    moved = F.transform(places, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir: str) -> DataFrame:
    found = collapse_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet")), least=12)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("a"), r.start.alias("b"), r.period.alias("c"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = -F.col("x.a"), F.col("x.c")
    return out.select("doc_id", "n_runs", F.col("x.b").alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * -x.a) div x.c").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
