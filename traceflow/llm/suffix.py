"""Suffix-array dedup over bytes by blockwise construction with a difference cover.

Every 50-byte stretch belongs to one block, chosen by its content (the anchor of repeats.py; stretches of hot anchors by their whole
content), so equal stretches meet in one block. Of a block, first the ranks of a difference-cover sample are computed; then suffixes are
dealt to buckets by their first two bytes, and one bucket after another is sorted: by 16 bytes, longer ties by the
cover's ranks, since any two suffixes reach sample positions within 7 bytes at a common distance. So beside the block's bytes and the sample's
ranks only one bucket's keys are held at a time. Neighbours in suffix order with a common prefix of `length` bytes are equal stretches.
Pieces of a block that are equal as a whole are sorted once.

A byte is removed if a stretch over it also starts in a document with a smaller doc_id.

Defined results: null and empty texts have no bytes; texts under `length` bytes lose nothing; a stretch that repeats only within one
document (or rows of one doc_id) stays; null doc_ids come first; an empty table gives no row; further columns are ignored; a text of
2^28 bytes or more is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import NULL_ID, among, covered, mark, remove_repeats, runs_of, span_rows
from .shared import blobs, buffers, constants, dealt, mix, sliding_argmin, slices

#: Bytes of an anchor.
SEED = 24
#: A difference cover modulo 7: each distance modulo 7 is one between two of its members.
PERIOD, COVER = 7, (0, 1, 3)
_C = constants(8, 19)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A hash of each run of SEED = 24 bytes, built by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    if len(h) < SEED:
        return np.zeros(0, np.uint64)
    for i, d in enumerate((1, 2, 4)):
        h = h[:-d] * _C[i] + h[d:]
    h8, h16 = h, h[:-8] * _C[3] + h[8:]
    return mix(h8[: len(h8) - 16] * _C[4] + h16[8 : 8 + len(h8) - 16])


def big_endian(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts like them (text must go on for 8 bytes)."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | text[at + i].astype(np.uint64)
    return out


class Cover:
    """Ranks of the sample suffixes by their first 56 bytes."""

    def __init__(self, text: np.ndarray):
        self.n = -(-len(text) // PERIOD) + 10
        t = np.concatenate([text, np.zeros(self.n * PERIOD + 8 - len(text), np.uint8)])
        at = (np.arange(self.n)[:, None] * PERIOD + np.array(COVER)[None, :]).ravel()
        rank = self._dense(big_endian(t, at) >> np.uint64(8))
        for periods in (1, 2, 4):  # 7 -> 14 -> 28 -> 56 bytes: a sample position plus whole periods is one again
            ahead = np.append(rank[len(COVER) * periods :], np.zeros(len(COVER) * periods, np.int64))
            rank = self._dense((rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64))
        self.rank = rank
        self.code = np.full(PERIOD, -1)
        self.code[list(COVER)] = np.arange(len(COVER))

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + self.code[places % PERIOD]]

    def distance(self, a: int, b: int) -> int:
        """The smallest distance at which places of residues a and b are both in the sample."""
        return next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)


def suffix_order(text: np.ndarray, places: np.ndarray, bucket: int = 1 << 16) -> np.ndarray:
    """places in the order of their suffixes, exact for the first 56 bytes; text goes on for 64 bytes after the last place.

    Buckets are those of the first two bytes, small ones together up to about `bucket` suffixes.
    """
    if not len(places):
        return places
    cover = Cover(text)
    head = (text[places].astype(np.uint16) << np.uint16(8)) | text[places + 1]
    order = np.argsort(head, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(head[order])) + 1, len(places))
    out, a = np.empty_like(places), 0
    while a < len(places):
        z = int(ends[min(np.searchsorted(ends, a + bucket), len(ends) - 1)])
        out[a:z] = bucket_order(text, places[order[a:z]], cover)
        a = z
    return out


def bucket_order(text: np.ndarray, places: np.ndarray, cover: Cover) -> np.ndarray:
    """suffix_order of one bucket."""
    k1, k2 = big_endian(text, places), big_endian(text, places + 8)
    order = np.lexsort((k2, k1))
    p, k1, k2 = places[order], k1[order], k2[order]
    tie = np.cumsum(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) - 1 if len(p) else np.zeros(0, np.int64)
    long_ = np.bincount(tie, minlength=1)[tie] > 1 if len(p) else np.zeros(0, bool)
    if not long_.any():
        return p
    q, group = p[long_], tie[long_]
    residue = q % PERIOD
    top = np.int64(len(cover.rank) + 1)
    lists = {}
    for r in range(PERIOD):
        own = np.flatnonzero(residue == r)
        if len(own):
            lists[r] = own[np.argsort(group[own] * top + cover.at(q[own] + cover.distance(r, r)), kind="stable")]
    # a suffix's place among the ties: those before it in each residue's sorted list
    before = np.zeros(len(q), np.int64)
    for r, own in lists.items():
        for s, other in lists.items():
            if r == s:
                start = np.searchsorted(group[own], group[own], "left")
                before[own] += np.arange(len(own)) - start
            else:
                d = cover.distance(r, s)
                theirs = group[other] * top + cover.at(q[other] + d)
                mine = group[own] * top + cover.at(q[own] + d)
                before[own] += np.searchsorted(theirs, mine, "left" if r < s else "right") - np.searchsorted(group[other], group[own], "left")
    p[long_] = q[np.lexsort((before, group))]
    return p


def equal_stretches(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """places in suffix order, and for each the number of its class of equal stretches (length <= 56)."""
    text = np.append(text, np.zeros(80, np.uint8))
    p = suffix_order(text, places)
    same = np.ones(max(0, len(p) - 1), bool)
    for d in [*range(0, length - 7, 8), length - 8]:
        k = big_endian(text, p + d)
        same &= k[1:] == k[:-1]
    return p, np.concatenate([[0], np.cumsum(~same)]) if len(p) else np.zeros(0, np.int64)


def _slices(ids: np.ndarray, column):
    data, offsets = buffers(column)
    for a, b in slices(offsets, 1 << 20):
        yield ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return runs_of(byte_grams(data), row, offsets, length, SEED, sliding_argmin)


def _ids(column) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64)


def _expand(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the places starts[i] .. starts[i] + n[i] - 1; and the i of each."""
    which = np.repeat(np.arange(len(n)), n)
    return starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def remove_repeated_bytes(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for. SEED < length <= 56."""
    if not SEED < length <= 56:
        raise ValueError("length must be 25 to 56")

    def runs(batch):
        for ids, data, offsets in _slices(_ids(batch.column("doc_id")), batch.column("text")):
            yield ids, _runs(data, offsets, length)

    def look(table, marks, hot, chunks, buckets):
        held: list[tuple] = []
        for ids, data, offsets in _slices(_ids(table.column("doc_id")), table.column("text")):
            r = _runs(data, offsets, length)
            d = ids[r.row]
            m = mark(r.anchor, d)
            at = np.minimum(np.searchsorted(marks, m), len(marks) - 1)
            keep = np.flatnonzero(marks[at] == m)
            start = offsets[r.row[keep]] + r.first[keep]
            held.append((r.anchor[keep], d[keep], r.first[keep], r.last[keep] - r.first[keep] + length, start, data))
        a, d, s, n = (np.concatenate([h[i] for h in held]) for i in range(4))
        pieces = []
        for _, _, _, size, start, data in held:
            raw = data.tobytes()
            pieces += [raw[x : x + y] for x, y in zip(start.tolist(), size.tolist())]
        # of a piece that several documents of this chunk have, all but the smallest doc_id lose it here
        kinds: dict[bytes, int] = {}
        kind = np.array([kinds.setdefault(x, len(kinds)) for x in pieces], np.int64)
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, d)
        later = d > least[kind] if len(kind) else np.zeros(0, bool)
        at, which = _expand(s[later], n[later] - length + 1)
        for c, *x in span_rows(d[later][which], at, length, chunks):
            yield [-1 - c, *x, b""]
        own = np.flatnonzero(~later)
        apart = among(a[own], hot)
        if apart.any():  # windows of hot anchors, each different one once, for buckets of their own
            from_hot = own[apart]
            at, which = _expand(np.zeros(len(from_hot), np.int64), n[from_hot] - length + 1)
            which = from_hot[which]
            windows = [pieces[j][i : i + length] for j, i in zip(which.tolist(), at.tolist())]
            dw, sw = d[which], s[which] + at
            code = np.array([xxhash.xxh3_64_intdigest(w) for w in windows], np.uint64)
            order = np.lexsort((dw, code))
            lead = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
            least = np.repeat(dw[order][lead], np.diff(np.append(lead, len(order))))
            gone = dw[order] > least
            for c, *x in span_rows(dw[order][gone], sw[order][gone], length, chunks):
                yield [-1 - c, *x, b""]
            rest = order[~gone]
            for k, *x in dealt((code[rest] % np.uint64(buckets)).astype(np.int64), [dw[rest], sw[rest], np.full(len(rest), length, np.int64), np.array([windows[i] for i in rest.tolist()], f"V{length}")]):
                yield [k + buckets, *x]
            own = own[~apart]
        bucket = (a[own] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, first = np.unique(bucket[order], return_index=True)
        cuts = np.append(first, len(order))
        for i, k in enumerate(keys.tolist()):
            rows = own[order[cuts[i] : cuts[i + 1]]]
            yield [k, d[rows].astype(np.int64).tobytes(), s[rows].astype(np.int64).tobytes(), n[rows].astype(np.int64).tobytes(), b"".join(pieces[j] for j in rows.tolist())]

    def resolve(table, chunks):
        d, s, n = (blobs(table, c, np.int64) for c in "abc")
        raw = blobs(table, "x", np.uint8).tobytes()
        end = np.cumsum(n)
        kinds: dict[bytes, int] = {}
        kind = np.array([kinds.setdefault(raw[x:y], len(kinds)) for x, y in zip((end - n).tolist(), end.tolist())], np.int64)
        size = np.array([len(x) for x in kinds], np.int64)
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, d)
        # the block's suffixes: each stretch of each different piece
        base = np.cumsum(size) - size
        places, _ = _expand(base, size - length + 1)
        p, group = equal_stretches(np.frombuffer(b"".join(kinds), np.uint8), places, length)
        piece = np.searchsorted(base, p, "right") - 1
        low = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, group, least[piece])
        lowest = np.zeros(int(size.sum()), np.int64)
        lowest[p] = low[group]
        at, which = _expand(base[kind], n - length + 1)
        gone = d[which] > lowest[at]
        return span_rows(d[which][gone], (s[which] + at - base[kind[which]])[gone], length, chunks)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def finish(docs_, found):
        out = []
        if docs_.num_rows:
            ids = _ids(docs_.column("doc_id"))
            data, offsets = buffers(docs_.column("text"))
            for i, (key, gone) in enumerate(zip(ids.tolist(), covered(ids, np.diff(offsets), found))):
                kept = data[offsets[i] : offsets[i + 1]][~gone].tobytes()
                runs_ = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append([None if key == NULL_ID else key, len(gone), int(gone.sum()), runs_, hashlib.sha256(kept).hexdigest()] + [kept] * with_text)
        cols = list(zip(*out)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string(), pa.binary()])], names=names)

    return remove_repeats(docs, runs, look, resolve, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
