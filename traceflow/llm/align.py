"""Alignment of two tokenizers' tokens by the bytes they cover, with token-byte incidence matrices in CSR.

A is the byte-level BPE of a space and the text, B the piece BPE of the text, which puts that space before it itself; both then cover the same
bytes. Row i of an incidence matrix holds a one for each byte of token i. Gustavson's row products of A and the transpose of B give the
overlap links; their values are the bytes shared. Byte offsets where tokens of both end cut them into groups: the group-incidence matrices G_A and G_B, whose
product by groups holds the shared-group links; that product is kept in factors, since a group may have many tokens of both.

Pairs of ids are counted in each slice of texts first, then summed over the corpus; the slices' distinct pairs come back with
their counts, and the texts' links, kept as numbers of their slice's pairs, look them up. No row is made per link.

Defined results: null and empty texts, and texts whose tokens don't spell the space and the text, have no tokens: zeros, and '' for
groups; strings of special tokens are plain text; rows that repeat an id are reported, and counted, each; null ids are kept; an empty table gives no row; further columns are ignored.
A slice holds SLICE bytes of text, or one longer text; a product is made in blocks of rows of BLOCK entries.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import buffers, slices, spread, written
from .tokens import _LETTERS, ByteLevel, encoder, vocabulary

#: Bytes of text of a slice, and entries of a product that are made at once.
SLICE, BLOCK = 1 << 21, 1 << 20


class CSR:
    """A sparse matrix by rows: row i has values[indptr[i]:indptr[i + 1]] in the columns indices[...], in ascending order."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, columns: int):
        self.indptr, self.indices, self.values, self.columns = indptr, indices, values, columns

    @classmethod
    def spans(cls, size: np.ndarray) -> CSR:
        """Ones: row i in the size[i] columns behind those of the rows before."""
        indptr = np.append(0, np.cumsum(size)).astype(np.int64)
        return cls(indptr, np.arange(indptr[-1], dtype=np.int32), np.ones(indptr[-1], np.int32), int(indptr[-1]))

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.indptr))

    @property
    def T(self) -> CSR:
        by = np.argsort(self.indices, kind="stable")
        indptr = np.append(0, np.cumsum(np.bincount(self.indices, minlength=self.columns))).astype(np.int64)
        return CSR(indptr, self.row_of()[by], self.values[by], self.rows)

    def dot(self, x: np.ndarray) -> np.ndarray:
        """The product with a vector."""
        total = np.append(0, np.cumsum(self.values * x[self.indices]))
        return total[self.indptr[1:]] - total[self.indptr[:-1]]

    def _rows(self, a: int, b: int, other: CSR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.indices[self.indptr[a] : self.indptr[b]]
        begin = other.indptr[own]
        n = other.indptr[own + 1] - begin
        entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        row = np.repeat(np.repeat(np.arange(b - a), np.diff(self.indptr[a : b + 1])), n)
        value = np.repeat(self.values[self.indptr[a] : self.indptr[b]], n) * other.values[entry]
        key = row * np.int64(other.columns) + other.indices[entry]
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            key, value = key[by], value[by]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key = key[head]
        row = key // max(other.columns, 1)
        return np.bincount(row, minlength=b - a), (key - row * other.columns).astype(np.int32), np.add.reduceat(value, head) if len(head) else value

    def __matmul__(self, other: CSR) -> CSR:
        """Gustavson's product: row i is the sum of other's rows at the entries of row i."""
        if not self.rows:
            return CSR(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), other.columns)
        work = np.append(0, np.cumsum(np.diff(other.indptr)[self.indices]))[self.indptr]
        parts, a = [], 0
        while a < self.rows:
            b = max(a + 1, int(np.searchsorted(work, work[a] + BLOCK, "right")) - 1)
            parts.append(self._rows(a, b, other))
            a = b
        size, indices, values = (np.concatenate(x) for x in zip(*parts))
        return CSR(np.append(0, np.cumsum(size)), indices, values, other.columns)


class Strings:
    """Byte strings of numbers 0, 1, ..."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        n = self.size[which]
        return self.data[np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class _PlainByteLevel(ByteLevel):
    """The byte-level file, with strings of added tokens as plain text."""

    def __init__(self, name: str):
        super().__init__(name)
        self.library.encode_special_tokens = True
        self.added = []
        byte = {c: b for b, c in _LETTERS.items()}
        # an added token spells its own name; no text is encoded to it
        names = {i: t for t, i in self.library.get_vocab(True).items()}
        self.strings = Strings([bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)])


class _Pieces:
    """The piece file; its pieces as bytes."""

    def _bytes(self, i: int) -> bytes:
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        every = range(self.model.piece_size())
        self.strings = Strings([bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self._bytes(i) for i in every])

        # where no piece goes on behind a space, what stands before each run of spaces is encoded by itself
        self.apart = not any(" " in s.lstrip(b" ").decode("utf-8", "replace") for s in map(self._bytes, every))
        self.blank = self.model.piece_to_id("▁")

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(texts, num_threads=1) if texts else []
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, which have a space before them here, one after another, and how many each has. Each different chunk is encoded once."""
        begins = np.zeros(len(data) + 1, bool)
        if self.apart:
            begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        begins[offsets[:-1]] = True
        at = np.flatnonzero(begins[:-1])
        raw = pa.py_buffer(data.tobytes())
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), raw]).dictionary_encode()
        ids, n = self._encode([c[1:].decode() for c in chunks.dictionary.to_pylist()])
        first, which = np.cumsum(n) - n, chunks.indices.to_numpy()
        blank = pc.equal(chunks.dictionary, pa.scalar(b" ", pa.large_binary())).to_numpy(zero_copy_only=False)
        n[blank], first[blank] = 1, len(ids)
        ids, n = np.append(ids, self.blank), n[which]
        ids = ids[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.diff(np.append(0, np.cumsum(n))[np.searchsorted(at, offsets)])


class Aligned:
    """The tokens of texts that both tokenizers spell alike, and how they meet.

    a, b: ids; a_text, b_text: their texts; links: CSR of a's tokens by b's; g_a, g_b: CSR of groups by tokens; group_text: a group's text.
    """

    def __init__(self, a: np.ndarray, a_size: np.ndarray, a_text: np.ndarray, b: np.ndarray, b_size: np.ndarray, b_text: np.ndarray):
        self.a, self.a_text, self.b, self.b_text = a, a_text, b, b_text
        self.links = CSR.spans(a_size) @ CSR.spans(b_size).T
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        self.g_a, self.g_b = (CSR.spans(np.diff(np.append(0, np.searchsorted(end, cut, "right")))) for end in (a_end, b_end))
        self.group_text = a_text[self.g_a.indptr[1:] - 1] if len(cut) else a_text[:0]

    def shared(self) -> np.ndarray:
        """How many links of tokens of one group each group has."""
        return self.g_a.dot(np.ones(self.g_a.columns, np.int64)) * self.g_b.dot(np.ones(self.g_b.columns, np.int64))

    def shared_links(self) -> CSR:
        """All of them; their number grows with the square of a group."""
        return self.g_a.T @ self.g_b

    def described(self, decimal: Strings, texts: int) -> list[str]:
        """For each text `a1,a2|b1;a3|b2,b3`: ids by groups."""
        size = [np.diff(g.indptr) for g in (self.g_a, self.g_b)]
        before = [np.repeat(self.g_b.indptr[:-1], size[0]), np.repeat(self.g_a.indptr[1:], size[1])]
        at = [np.arange(len(x)) + y for x, y in zip((self.a, self.b), before)]
        item = np.empty(len(self.a) + len(self.b), np.int64)
        item[at[0]], item[at[1]] = self.a, self.b
        out = decimal.joined(item)
        end = np.cumsum(decimal.size[item])
        if len(self.group_text):
            out[end[at[0][self.g_a.indptr[1:] - 1]] - 1] = ord("|")
            out[end[at[1][self.g_b.indptr[1:] - 1]] - 1] = ord(";")
        last = np.cumsum(np.bincount(self.a_text, minlength=texts) + np.bincount(self.b_text, minlength=texts))
        cuts = np.append(0, end)[np.append(0, last)]
        raw = out.tobytes()
        return [raw[x : max(x, z - 1)].decode() for x, z in zip(cuts.tolist(), cuts[1:].tolist())]


class Aligner:
    """Both tokenizers."""

    def __init__(self, names: str):
        a, b = names.split("\n")
        self.a, self.b = _PlainByteLevel(a), _Pieces(b)
        self.decimal = Strings([b"%d," % i for i in range(max(len(self.a.strings.size), len(self.b.strings.size)))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Aligned:
        """data: texts with a space before each; an empty one has none."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        a, a_n = self.a.encode_column(pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]))
        a = a.astype(np.int64)
        b, b_n = self.b.encode(data, offsets)
        ok = np.ones(rows, bool)
        for strings, ids, n in ((self.a.strings, a, a_n), (self.b.strings, b, b_n)):
            spelt = strings.joined(ids).tobytes()
            at = np.append(0, np.cumsum(strings.size[ids]))[np.append(0, np.cumsum(n))]
            if spelt != raw:
                at = at.tolist()
                ok &= [spelt[x:y] == raw[u:v] for x, y, u, v in zip(at, at[1:], offsets[:-1].tolist(), offsets[1:].tolist())]
            elif (at != offsets).any():
                ok &= (at[:-1] == offsets[:-1]) & (at[1:] == offsets[1:])
        a_text, b_text = np.repeat(np.arange(rows), a_n), np.repeat(np.arange(rows), b_n)
        a, a_text, b, b_text = a[ok[a_text]], a_text[ok[a_text]], b[ok[b_text]], b_text[ok[b_text]]
        return Aligned(a, self.a.strings.size[a], a_text, b, self.b.strings.size[b], b_text)


_TEXT = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, links binary"
_BASE = f"slice long, doc_id long, {_TEXT}, pairs array<bigint>, times array<bigint>"


def _linked(docs: DataFrame, names: str) -> DataFrame:
    """A row per text, with its links as numbers of its slice's pairs (2 bytes each if these are few, else 4); and a row per slice with its distinct pairs and their numbers of links."""

    def emit(batches):
        aligner, task, k = encoder(Aligner, names), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for x, z in slices(offsets, SLICE):
                got = aligner(data[offsets[x] : offsets[z]], offsets[x : z + 1] - offsets[x])
                rows = z - x
                row = got.links.row_of()
                pairs, which, times = np.unique(got.a[row] << 32 | got.b[got.links.indices], return_inverse=True, return_counts=True)
                raw = which.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                of_link = got.a_text[row]
                count = lambda t: np.bincount(t, minlength=rows)  # noqa: E731, B023
                cut = np.searchsorted(of_link, np.arange(rows + 1)).tolist()
                shared = np.zeros(rows, np.int64)
                np.add.at(shared, got.group_text, got.shared())
                columns = [*[pa.array(v, pa.int64()) for v in (count(got.a_text), count(got.b_text), count(got.group_text), count(of_link), shared)]]
                columns += [pa.array(got.described(aligner.decimal, rows), pa.string()), pa.array([raw[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())]
                lists = [pa.nulls(rows, pa.list_(pa.int64()))] * 2
                number = task << 32 | k
                k += 1
                names_ = ["slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "links", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), batch.column("doc_id").slice(x, rows), *columns, *lists], names=names_)
                if len(pairs):
                    none = [pa.nulls(1, t) for t in (pa.int64(),) * 6 + (pa.string(), pa.binary())]
                    own = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(v, pa.int64())) for v in (pairs, times)]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), *none, *own], names=names_)

    spaced = F.when(F.octet_length("text") > 0, F.concat(F.lit(" "), F.col("text")))
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("text"))).mapInArrow(emit, _BASE)


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", store: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_shared (links of tokens of one group), n_best (links whose count is the highest
    of their b id in the corpus), count_sum (of all links' counts), groups (`a1,a2|b1;a3|b2,b3`, or what store makes of that column before it is kept).

    A link's count: how many links of the corpus join the same two ids. a, b: vocabulary files.
    """
    base = written(_linked(docs, f"{a}\n{b}").withColumn("groups", store(F.col("groups"))), "aligned")
    each = base.where("pairs is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p"))
    each = each.select("slice", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    total = written(each.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    best = total.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    total = total.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    found = each.select("slice", "at", "pair").join(total, "pair").select(F.col("slice").alias("of"), "at", "n", "best")
    kept = base.where("pairs is null").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "links")

    def look_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        by = np.argsort(pairs.column("at").to_numpy())
        n, best = pairs.column("n").to_numpy()[by], pairs.column("best").to_numpy()[by].astype(np.int64)
        sums = []
        for raw, links in zip(texts.column("links").to_pylist(), texts.column("n_links").to_pylist()):
            which = np.frombuffer(raw, f"<u{len(raw) // links}") if links else np.zeros(0, np.int64)
            sums.append((int(best[which].sum()), int(n[which].sum())))
        out = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared"])
        for name, i in (("n_best", 0), ("count_sum", 1)):
            out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return out.append_column("groups", texts.column("groups"))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups string"
    return kept.groupBy("slice").cogroup(found.groupBy("of")).applyInArrow(look_up, schema)


def op13_align(spark, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), store=lambda g: F.when(g == "", g).otherwise(F.sha2(g, 256)))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
