"""Substring dedup over words: seed and extend.

Documents are joined on winnowed anchors (repeats.py): a shared anchor of SEED words is a seed, and comes with the words around it, as far
as the windows reach that it stands for. Occurrences of a seed with the same words around are one class, in which all but the first are repeats
as a whole; of each two classes the first members are compared word by word from the seed to the left and to the right, as far as they
agree. A match of `length` words or more is a repeat, and repeats that overlap make one maximal repeat. Where a seed has more than
MOST_CLASSES classes, and for hot anchors, windows are grouped by their hash instead, which finds the same in linear time.

Words are compared by 64-bit hashes, one for one; windows that are grouped, by one 64-bit hash of these. Every window has a seed, so extending
finds all that repeats.

A stretch is removed where the same words also start earlier (in a smaller doc_id, or earlier in the same document).

Defined results: null and empty texts have no words; texts of fewer than `length` words lose nothing; repeated rows of a doc_id are
one document and keep their first occurrence each; null doc_ids come first; an empty table gives no row; further columns are ignored;
a text of 2^28 words or more is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import NULL_ID, among, covered, interval_rows, mark, remove_repeats, runs_of, span_rows
from .shared import Words, blobs, buffers, constants, dealt, grams, mix, sliding_argmin, slices

SEED = 5
#: Classes of a seed that are compared in pairs.
MOST_CLASSES = 64


def _slices(ids: np.ndarray, column: pa.Array):
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        off = offsets[a : b + 1] - offsets[a]
        yield ids[a:b], Words(data[offsets[a] : offsets[b]], off)


def _runs(words: Words, length: int):
    g = grams(words.h, SEED)
    return runs_of(g, words.row, words.first, length, SEED, sliding_argmin)


def _ids(column) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64)


class Around:
    """Occurrences of seeds: the anchor's hash, its document, the first word (from the text's beginning) and the number of words around
    it, how many of these stand before the seed, and their hashes, one after another."""

    def __init__(self, anchor: np.ndarray, d: np.ndarray, s: np.ndarray, left: np.ndarray, n: np.ndarray, words: np.ndarray):
        self.anchor, self.d, self.s, self.left, self.n, self.words = anchor, d.astype(np.int64), s, left, n, words
        self.begin = np.cumsum(n) - n

    def _inside(self) -> np.ndarray:
        """The place of each word among those of its occurrence."""
        return np.arange(len(self.words)) - np.repeat(self.begin, self.n)

    def take(self, which: np.ndarray) -> Around:
        which = np.flatnonzero(which) if which.dtype == bool else which
        n = self.n[which]
        at = np.repeat(self.begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Around(self.anchor[which], self.d[which], self.s[which], self.left[which], n, self.words[at])

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which occurrences have the same words around the same seed as an earlier one, and which are the first of their class."""
        if not len(self.d):
            return np.zeros(0, bool), np.zeros(0, bool)
        slot = np.repeat(length - self.left, self.n) + self._inside()
        code = mix(np.add.reduceat(self.words * constants(3 * length, 37)[slot], self.begin) + self.anchor)
        order = np.lexsort((self.s, self.d, code))
        new = np.append(True, code[order][1:] != code[order][:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        first[order[new]] = True
        later[order] = (self.d[order] != self.d[lead]) | (self.s[order] != self.s[lead])
        return later, first

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.d, self.s, self.s + self.n

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and start of each window of `length` words."""
        n = np.maximum(self.n - length + 1, 0)
        which = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        g = grams(self.words, length, 71)
        return g[self.begin[which] + i] if len(which) else np.zeros(0, np.uint64), self.d[which], self.s[which] + i

    def rows(self, buckets: int):
        """Rows (bucket, anchors, documents, numbers, words) for the tasks of the anchors."""
        bucket = (self.anchor % np.uint64(buckets)).astype(np.int64)
        own = self.take(np.argsort(bucket, kind="stable"))
        bucket = np.sort(bucket)
        keys, at = np.unique(bucket, return_index=True)
        for k, a, z in zip(keys.tolist(), at, np.append(at[1:], len(bucket))):
            words = own.words[own.begin[a] : own.begin[z - 1] + own.n[z - 1]]
            yield [k, own.anchor[a:z].tobytes(), own.d[a:z].tobytes(), np.stack([x[a:z].astype(np.int64) for x in (own.s, own.left, own.n)], 1).tobytes(), words.tobytes()]


def first_windows(h: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of windows (hash, document, start): document and start of those that have an earlier equal one, and of each hash the first."""
    order = np.lexsort((s, d, h))
    h, d, s = h[order], d[order], s[order]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = (d != d[lead]) | (s != s[lead])
    return (d[later], s[later]), (h[first], d[first], s[first])


def extended(every: Around, length: int, pairs: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, from, to of what each occurrence shares with an earlier one of its seed, extended to both sides; every is sorted by anchor."""
    side, m = length - SEED, len(every.d)
    words = np.zeros((m, 2 * length - SEED), np.uint64)  # the seed in the middle, 0 beyond an occurrence's words
    words[np.repeat(np.arange(m), every.n), np.repeat(side - every.left, every.n) + every._inside()] = every.words
    place = every.s + every.left
    _, first, size = np.unique(every.anchor, return_index=True, return_counts=True)
    nth, size = np.arange(m) - np.repeat(first, size), np.repeat(size, size)
    found = [[np.zeros(0, np.int64)] for _ in range(3)]
    for step in range(1, int(size.max(initial=0))):
        every_pair = np.flatnonzero(nth + step < size)
        for i in (every_pair[k : k + pairs] for k in range(0, len(every_pair), pairs)):
            j = i + step
            same = (words[i] == words[j]) & (words[i] != 0)
            left = np.logical_and.accumulate(same[:, side - 1 :: -1], axis=1).sum(1) if side else np.zeros(len(i), np.int64)
            right = np.logical_and.accumulate(same[:, side + SEED :], axis=1).sum(1)
            ok = same[:, side : side + SEED].all(1) & (left + SEED + right >= length)
            other = (every.d[i] == every.d[j]) & (place[i] == place[j])  # rows that repeat a document
            later = np.where((every.d[i] > every.d[j]) | (every.d[i] == every.d[j]) & (place[i] > place[j]), i, j)
            keep = ok & ~other
            later, left, right = later[keep], left[keep], right[keep]
            for out, x in zip(found, (every.d[later], place[later] - left, place[later] + SEED + right)):
                out.append(x)
    return tuple(np.concatenate(x) for x in found)


def remove_repeated_words(docs: DataFrame, length: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces), and the kept text if asked for."""

    def runs(batch):
        for ids, words in _slices(_ids(batch.column("doc_id")), batch.column("text")):
            yield ids, _runs(words, length)

    def look(table, marks, hot, chunks, buckets):
        held = []
        for ids, words in _slices(_ids(table.column("doc_id")), table.column("text")):
            r = _runs(words, length)
            d = ids[r.row]
            keep = np.flatnonzero(among(mark(r.anchor, d), marks))
            n = (r.last - r.first)[keep] + length
            base = words.first[r.row[keep]]
            at = np.repeat(base + r.first[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held.append((r.anchor[keep], d[keep], r.first[keep], (r.place - r.first)[keep], n, words.h[at] if len(at) else np.zeros(0, np.uint64)))
        every = Around(*(np.concatenate(x) for x in zip(*held)))
        apart = among(every.anchor, hot)
        later, (h, d, s) = first_windows(*every.take(apart).windows(length))
        yield from ([-1 - c, *x, b""] for c, *x in span_rows(*later, length, chunks))
        yield from ([buckets + b, *x, b""] for b, *x in dealt((h % np.uint64(buckets)).astype(np.int64), [h, d, s]))
        every = every.take(~apart)
        later, first = every.classes(length)
        yield from ([-1 - c, *x, b""] for c, *x in interval_rows(*every.take(later).whole(), chunks))
        yield from every.take(first).rows(buckets)

    def resolve(table, chunks):
        if not any(table.column("x").to_pylist()):  # windows of hot anchors
            later, _ = first_windows(blobs(table, "a"), blobs(table, "b", np.int64), blobs(table, "c", np.int64))
            return span_rows(*later, length, chunks)
        every = Around(blobs(table, "a"), blobs(table, "b", np.int64), *blobs(table, "c", np.int64).reshape(-1, 3).T, blobs(table, "x"))
        later, first = every.classes(length)
        out = interval_rows(*every.take(later).whole(), chunks)
        every = every.take(first)
        every = every.take(np.argsort(every.anchor, kind="stable"))
        _, group, size = np.unique(every.anchor, return_inverse=True, return_counts=True)
        many = size[group] > MOST_CLASSES
        later, _ = first_windows(*every.take(many).windows(length))
        out += span_rows(*later, length, chunks)
        return out + interval_rows(*extended(every.take(~many & (size[group] > 1)), length), chunks)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text

    def finish(docs_, found):
        out = []
        if docs_.num_rows:
            ids, column = _ids(docs_.column("doc_id")), docs_.column("text").combine_chunks()
            data, offsets = buffers(column)
            n, places = [], []
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n += np.diff(w.first).tolist()
                places += [(w.start[w.first[i] : w.first[i + 1]] + offsets[a], w.end[w.first[i] : w.first[i + 1]] + offsets[a]) for i in range(b - a)]
            raw = data.tobytes()
            for i, (key, gone) in enumerate(zip(ids.tolist(), covered(ids, np.array(n), found))):
                start, end = places[i]
                kept = b" ".join(raw[x:y] for x, y in zip(start[~gone].tolist(), end[~gone].tolist()))
                out.append([None if key == NULL_ID else key, n[i], int(gone.sum()), hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "replace")] * with_text)
        cols = list(zip(*out)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2)], names=names)

    return remove_repeats(docs, runs, look, resolve, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


