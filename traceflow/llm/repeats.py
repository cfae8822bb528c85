"""Finding fixed-length windows that occur more than once, from anchors that depend on content only.

A window is L consecutive units (words or bytes) of one document. Its anchor is the k-gram in it with the smallest hash, the
leftmost of equals; so equal windows have equal anchors at equal places, and the windows of a document fall into runs of one
anchor each. Three passes share the work:

1. anchors: which anchors occur more than once in the corpus. A task counts its own repeats first and sends an anchor
   once, so a frequent anchor costs a row a task;
2. windows: documents meet their repeated anchors, and the runs around them go, by anchor, to tasks that find
   earlier occurrences; what a task can tell from its own documents stays out of the shuffle. Runs of a hot anchor would be too many for
   one task: they are taken apart into windows, which are dealt by their whole content, so that only equal ones meet;
3. removal: documents meet their covered spans.

Entries travel as packed arrays, one row for each pair of tasks' groups. doc_id stands for one text; null doc_ids come first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs, constants, dealt, fan_out, mix, text_bytes, written

#: The id that stands for a null doc_id.
NULL_ID = -(1 << 62)
#: An anchor of more occurrences than this is hot; at most so many hot anchors, the most frequent first, are told to the tasks (8 MB).
#: Either way gives the same windows: what isn't told is at most a 2^20th of all.
HOT, MOST_HOT = 4096, 1 << 20
_SPAN = "chunk int, d binary, s binary, e binary"
_SALT = constants(3, 53)


class Runs:
    """Runs of windows with one anchor, of the texts of an Arrow column: row, anchor, first and last (window starts, from the text's beginning), place (of the anchor)."""

    def __init__(self, row: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray):
        self.row, self.anchor, self.first, self.last, self.place = row, anchor, first, last, place


def runs_of(gram: np.ndarray, row: np.ndarray, begin: np.ndarray, length: int, k: int, argmin: Callable) -> Runs:
    """gram: hash at each unit's place; row: the text of each unit; begin: the first unit of each text."""
    n = len(row)
    if n < length:
        z = np.zeros(0, np.int64)
        return Runs(z, np.zeros(0, np.uint64), z, z, z)
    q = argmin(gram, length - k + 1)
    s = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    at = q[s]
    new = np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)) if len(s) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(s)) - 1
    r = row[s[a]] if len(s) else np.zeros(0, np.int64)
    base = begin[r]
    return Runs(r, gram[at[a]], s[a] - base, s[z] - base, at[a] - base)


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) * _SALT[0]) % np.uint64(chunks)).astype(np.int64)


def mark(anchor: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One hash for an anchor in a document; equal hashes by chance only bring a window more to look at."""
    return mix(anchor * _SALT[1] + mix(ids.astype(np.int64).view(np.uint64) * _SALT[2]))


def _rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id as a number that is never null, and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")


def _repeated_anchors(docs: DataFrame, runs: Callable, buckets: int, chunks: int) -> DataFrame:
    """chunk, m: marks of the repeated anchors of each chunk's documents; and rows of chunk -1 with hot anchors in m and their numbers in n."""

    def emit(batches):
        for b in batches:
            for ids, found in runs(b):
                d, a = ids[found.row], found.anchor
                if not len(a):
                    continue
                u, first, at, n = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
                many = n[at] > 1
                # what repeats here is known to repeat: it goes to its document; one of it is counted elsewhere
                rows = [[-1 - c, b"", m, b""] for c, m in dealt(chunk_of(d[many], chunks), [mark(a[many], d[many])])]
                if len(u):
                    rows += dealt((u % np.uint64(buckets)).astype(np.int64), [u, np.where(n > 1, np.int64(NULL_ID - 1), d[first]).view(np.uint64), n.astype(np.uint64)])
                yield _rows(rows, ["bucket", "a", "d", "n"])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"chunk": pa.array([-1 - bucket], pa.int32()), "m": pa.array([blobs(table, "d").tobytes()], pa.binary()), "n": pa.array([b""], pa.binary())})
        a, d = blobs(table, "a"), blobs(table, "d").view(np.int64)
        u, at, n = np.unique(a, return_inverse=True, return_counts=True)
        total = np.bincount(at, blobs(table, "n").astype(np.int64), minlength=len(u)).astype(np.int64)
        take = (n[at] > 1) & (d != NULL_ID - 1)
        rows = dealt(chunk_of(d[take], chunks), [mark(a[take], d[take])])
        rows = [[*r, b""] for r in rows] + [[-1, u[total > HOT].tobytes(), total[total > HOT].tobytes()]] * bool((total > HOT).any())
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "m": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary())})

    return docs.mapInArrow(emit, "bucket int, a binary, d binary, n binary").groupBy("bucket").applyInArrow(count, "chunk int, m binary, n binary")


def _hot_anchors(marks: DataFrame) -> np.ndarray:
    """The most frequent hot anchors, sorted; at most MOST_HOT."""

    def unpack(batches):
        for b in batches:
            for m, n in zip(b.column("m"), b.column("n")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (m, n)], names=["anchor", "n"])

    found = marks.where("chunk = -1").select("m", "n").mapInArrow(unpack, "anchor long, n long").orderBy(F.desc("n"), "anchor").limit(MOST_HOT).toArrow()
    return np.sort(found.column("anchor").to_numpy().astype(np.int64).view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def interval_rows(ids: np.ndarray, start: np.ndarray, end: np.ndarray, chunks: int) -> list[list]:
    """Spans (document, from, to) for the chunks of their documents; they may overlap."""
    return dealt(chunk_of(ids, chunks), [x.astype(np.int64) for x in (ids, start, end)])


def spans(ids: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered windows (document, start) as maximal spans: document, from, to."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + 1)) if len(ids) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(ids)) - 1
    return ids[a], at[a], (at[z] + length) if len(a) else at[a]


def span_rows(ids: np.ndarray, at: np.ndarray, length: int, chunks: int) -> list[list]:
    d, s, e = spans(ids, at, length)
    return dealt(chunk_of(d, chunks), [d.astype(np.int64), s.astype(np.int64), e.astype(np.int64)])


def covered(row_ids: np.ndarray, units: np.ndarray, table: pa.Table) -> list[np.ndarray]:
    """For each document, with its number of units, which of them a span covers."""
    d, s, e = (blobs(table, c, np.int64) for c in "dse")
    order = np.argsort(d, kind="stable")
    d, s, e = d[order], s[order], e[order]
    low, high = np.searchsorted(d, row_ids, "left"), np.searchsorted(d, row_ids, "right")
    out = []
    for n, a, z in zip(units.tolist(), low, high):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.minimum(s[a:z], n), 1)
        np.add.at(step, np.minimum(e[a:z], n), -1)
        out.append(np.cumsum(step)[:n] > 0)
    return out


def remove_repeats(docs: DataFrame, runs: Callable, look: Callable, resolve: Callable, finish: Callable, schema: str, group_bytes: int = 4 << 20) -> DataFrame:
    """runs(batch) yields (ids, Runs) by slices. look(table, marks, hot, chunks, buckets) gives the rows (bucket, payload...) of a chunk's
    flagged runs, windows of hot anchors with `buckets` added to their bucket; rows of bucket -1 - chunk hold spans already. resolve(table, chunks) gives the span rows of a bucket.
    finish(table of documents, table of spans) gives the result's rows."""
    docs = keyed(docs)
    size = text_bytes(docs)
    buckets = chunks = fan_out(size, group_bytes)

    def number(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(chunk_of(ids, chunks), pa.int32()), b.column("doc_id"), b.column("text")], names=["chunk", "doc_id", "text"])

    numbered = docs.mapInArrow(number, "chunk int, doc_id long, text string")
    marks = written(_repeated_anchors(docs, runs, buckets, chunks), "marks")
    hot = _hot_anchors(marks)
    marks = marks.where("chunk >= 0")

    def window(docs_: pa.Table, marks_: pa.Table) -> pa.Table:
        known = np.unique(blobs(marks_, "m")) if marks_.num_rows else np.zeros(0, np.uint64)
        rows = [r for r in look(docs_, known, hot, chunks, buckets)] if docs_.num_rows and len(known) else []
        cols = list(zip(*rows)) or [(), (), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.binary()] * 4)], names=["bucket", "a", "b", "c", "x"])

    entries = numbered.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(window, "bucket int, a binary, b binary, c binary, x binary")
    entries = written(entries, "windows")
    local = entries.where("bucket < 0").select((-F.col("bucket") - 1).cast("int").alias("chunk"), F.col("a").alias("d"), F.col("b").alias("s"), F.col("c").alias("e"))

    def solve(table: pa.Table) -> pa.Table:
        rows = resolve(table, chunks)
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.binary()] * 3)], names=["chunk", "d", "s", "e"])

    found = written(local.unionByName(entries.where("bucket >= 0").groupBy("bucket").applyInArrow(solve, _SPAN)), "spans")
    return numbered.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)
