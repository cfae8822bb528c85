"""Line dedup over a log-template tree.

Lines are parsed at a fixed depth: by token count, then by leading tokens (three, or an eighth of a long line); tokens with a digit are variable from the
start. A leaf then makes its templates level by level. Its centre is the line that agrees most with the commonest token of each place; lines that
agree with the centre in enough places share a template, whose other places are variable. The rest of the leaf is dealt to children by the tokens of the places
that vary least among them, and these go on alike. A template that recurs in enough documents is boilerplate: its lines are dropped from all documents but
the first that has it (the smallest doc_id), so a group of copies keeps one.

Each level is a function of counts over all lines of a leaf, so templates depend on neither order, partitions nor the leaf's size: a leaf that fits in a task
goes through its levels there, a larger one by aggregations, joins and one written table a step, until its children fit. A level fixes at
least a sixteenth of the places of a child, and a child whose fixed places are enough is one template: levels are at most about 20, whatever the leaf's size.

Defined results: null texts stay null and empty ones empty; lines of fewer than min_words tokens are never dropped; a
document whose lines are all dropped keeps an empty text; rows that repeat a doc_id are one document; null doc_ids count
as the first document; among equally common tokens the smallest hash counts, among equally good centres the line in most documents, then the
smallest hash; an empty table gives no row; further columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, unused, written

DIGIT = re.compile(r"\d")
#: Leading tokens of a leaf: this many, or an eighth of the line's tokens if that is more.
DEPTH = 3
#: Distinct lines of a leaf that one task takes through all levels, and tokens of these; larger ones take a level at a time.
LEAF_LINES, LEAF_TOKENS = 1000, 1 << 20
#: Tasks among which the lines of a larger leaf are dealt where they meet what is known of the leaf.
SALTS = 64


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(s: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")))


def _token(t: str) -> bytes:
    return xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")).to_bytes(4, "little")


def parse(line: str, min_words: int, blob: bool = True) -> tuple[int, int, int, list[str], bytes] | None:
    """leaf, masked line (hashes), token count, masked tokens, and 4 bytes a token if asked for, of a line; None if it is too short."""
    tokens = line.split()
    n = len(tokens)
    if n < min_words:
        return None
    if DIGIT.search(line):
        tokens = ["<*>" if DIGIT.search(t) else t for t in tokens]
    return _hash(f"{n} " + " ".join(tokens[: max(DEPTH, n // 8)])), _hash(" ".join(tokens)), n, tokens, b"".join(map(_token, tokens)) if blob else b""


def _matrix(blobs: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint32).reshape(len(blobs), n)


def common(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of lines (rows of tokens), the token in most documents, the smallest of those, and in how many it is."""
    k, n = tokens.shape
    order = np.argsort(tokens, axis=0)
    flat = np.take_along_axis(tokens, order, 0).T.ravel()
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]] | (np.arange(k * n) % k == 0))
    counts, place, token = np.add.reduceat(docs[order].T.ravel(), starts), starts // k, flat[starts]
    first = np.lexsort((token, -counts, place))
    first = first[np.searchsorted(place[first], np.arange(n))]
    return token[first], counts[first]


def places_of(counts: np.ndarray, total: int) -> np.ndarray:
    """The places that a leaf's rest is dealt by: of those that vary, the sixteenth of all places (at least one) whose commonest token is in most documents."""
    vary = np.flatnonzero(counts < total)
    return np.sort(vary[np.lexsort((vary, -counts[vary]))][: max(1, len(counts) // 16)])


def children(leaf: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The child of each line (rows of tokens) of its leaf, by its tokens at the places."""
    h = mix(leaf.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    for p in places:
        h = mix(mix(h ^ np.uint64(p)) ^ tokens[:, p].astype(np.uint64))
    return h.view(np.int64)


def levels(leaf: int, tokens: np.ndarray, docs: np.ndarray, line: np.ndarray, similarity: float, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of a leaf, whether it has a template in at least least_docs lines of documents or may have one, and its number."""
    template, has, todo, n = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool), [(leaf, np.arange(len(tokens)))], tokens.shape[1]
    while todo:
        g, at = todo.pop()
        if docs[at].sum() < least_docs:
            continue
        t = tokens[at]
        best = np.lexsort((line[at], -docs[at], -(t == common(t, docs[at])[0]).sum(axis=1)))[0] if len(at) > 1 else 0
        near = (t == t[best]).sum(axis=1) >= similarity * n
        near[best] = True
        template[at[near]], has[at[near]] = g, True
        rest = at[~near]
        total = docs[rest].sum()
        if len(rest) and total >= least_docs:
            kids = children(np.full(len(rest), g), tokens[rest], places_of(common(tokens[rest], docs[rest])[1], total))
            order = np.argsort(kids, kind="stable")
            cuts = np.flatnonzero(np.diff(kids[order])) + 1
            todo += [(int(kids[x[0]]), rest[x]) for x in np.split(order, cuts)]
    return has, template


def cluster(lines: list[tuple[int, bytes]], similarity: float) -> list[int]:
    """For each (line, token blob), the index of its template's first line; lines of different token counts share none."""
    out = [0] * len(lines)
    for size in {len(b) for _, b in lines}:
        at = [i for i, (_, b) in enumerate(lines) if len(b) == size]
        found = levels(0, _matrix([lines[i][1] for i in at], size // 4), np.ones(len(at), np.int64), np.array([lines[i][0] for i in at]), similarity, 1)[1].tolist()
        for i, t in zip(at, found):
            out[i] = at[found.index(t)]
    return out


def _small(todo: DataFrame, similarity: float, least_docs: int) -> DataFrame:
    """line, template of todo(leaf, n, line, blob, docs), a leaf in each task's hands at a time."""

    def tree(table: pa.Table) -> pa.Table:
        leaf, n = table.column("leaf")[0].as_py(), table.column("n")[0].as_py()
        line, docs = (table.column(c).to_numpy() for c in ("line", "docs"))
        has, template = levels(leaf, _matrix(table.column("blob").to_pylist(), n), docs, line, similarity, least_docs)
        return pa.table({"line": line[has], "template": template[has]})

    return todo.select("leaf", "n", "line", "blob", "docs").groupBy("leaf", "n").applyInArrow(tree, "line long, template long")


def _counts(lines: DataFrame) -> DataFrame:
    """leaf, place, token, docs (of its commonest token, the smallest of those), total (of all tokens) of lines(leaf, n, line, blob, docs)."""

    def explode(batches):
        for b in batches:
            leaf, n, docs = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "n", "docs"))
            token = np.frombuffer(b"".join(b.column("blob").to_pylist()), np.uint32)
            place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.repeat(leaf, n), pa.int64()), (place, pa.int32()), (token, pa.int64()), (np.repeat(docs, n), pa.int64()))], names=["leaf", "place", "token", "docs"])

    tokens = lines.select("leaf", "n", "blob", "docs").mapInArrow(explode, "leaf long, place int, token long, docs long").groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"))
    best = tokens.groupBy("leaf", "place").agg(F.max(F.struct("docs", (-F.col("token")).alias("token"))).alias("m"), F.sum("docs").alias("total"))
    return best.select("leaf", "place", (-F.col("m.token")).alias("token"), "m.docs", "total")


def _meet(lines: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """lines joined by leaf with known, which has a row a leaf: the lines of one leaf are dealt among SALTS tasks."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int")).join(salted, ["leaf", "salt"], how).drop("salt")


def _agreeing(lines: DataFrame, other: str) -> DataFrame:
    """lines(leaf, n, line, blob, docs) with agree: in how many places blob has the token of the blob called other."""

    def compare(batches):
        for b in batches:
            n = b.column("n").to_numpy()
            same = np.frombuffer(b"".join(b.column("blob").to_pylist()), np.uint32) == np.frombuffer(b"".join(b.column(other).to_pylist()), np.uint32)
            ends = np.r_[0, np.cumsum(same)]
            at = np.r_[0, np.cumsum(n)]
            agree = ends[at[1:]] - ends[at[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("leaf", "n", "line", "blob", "docs")] + [pa.array(agree, pa.int32())], names=["leaf", "n", "line", "blob", "docs", "agree"])

    return lines.select("leaf", "n", "line", "blob", "docs", other).mapInArrow(compare, "leaf long, n int, line long, blob binary, docs long, agree int")


def _level(lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """One level of leaves too large for a task: (line, template) of those near their leaf's centre, and the rest in its children."""

    def typical(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return pa.table({"leaf": table.column("leaf")[:1], "common": pa.array([table.column("token").to_numpy().astype(np.uint32).tobytes()], pa.binary())})

    def least_varied(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        places = places_of(table.column("docs").to_numpy(), table.column("total")[0].as_py())
        return pa.table({"leaf": table.column("leaf")[:1], "places": pa.array([places.tolist()], pa.list_(pa.int32()))})

    def deal(batches):
        for b in batches:
            leaf, n = b.column("leaf").to_numpy(), b.column("n").to_numpy()
            out, blobs, places = np.zeros(len(leaf), np.int64), b.column("blob").to_pylist(), b.column("places").to_pylist()
            for g in np.unique(leaf):
                at = np.flatnonzero(leaf == g)
                out[at] = children(leaf[at], _matrix([blobs[i] for i in at], int(n[at[0]])), places[at[0]])
            yield pa.RecordBatch.from_arrays([pa.array(out), *(b.column(c) for c in ("n", "line", "blob", "docs"))], names=["leaf", "n", "line", "blob", "docs"])

    modes = _counts(lines).groupBy("leaf").applyInArrow(typical, "leaf long, common binary")
    scored = _agreeing(_meet(lines, modes), "common")
    centres = scored.groupBy("leaf").agg(F.max(F.struct("agree", "docs", (-1 - F.col("line")).alias("line"), "blob")).alias("m")).select("leaf", F.col("m.blob").alias("centre"))
    met = written(_agreeing(_meet(lines, centres), "centre"), "met")
    near = F.col("agree") >= F.lit(similarity) * F.col("n")
    rest = met.where(~near).select("leaf", "n", "line", "blob", "docs")
    places = _counts(rest).groupBy("leaf").applyInArrow(least_varied, "leaf long, places array<int>")
    dealt = _meet(rest, places).mapInArrow(deal, "leaf long, n int, line long, blob binary, docs long")
    return met.where(near).select("line", F.col("leaf").alias("template")), written(dealt, "children")


def _templates(todo: DataFrame, similarity: float, least_docs: int) -> DataFrame:
    """line, template of todo(leaf, n, line, blob, docs), where that can be in least_docs documents."""
    block = F.least(F.lit(LEAF_LINES), F.greatest(F.lit(16), F.floor(F.lit(LEAF_TOKENS) / F.greatest("n", F.lit(1)))))
    found, small = [], []
    while True:
        sizes = written(todo.groupBy("leaf", "n").agg(F.count("*").alias("size"), F.sum("docs").alias("total")).where((F.col("total") >= least_docs) & ((F.col("size") > block) | F.lit(bool(found)))), "leaves")
        large, fits = sizes.where(F.col("size") > block).select("leaf"), sizes.where(F.col("size") <= block).select("leaf")
        if large.isEmpty():
            small.append(todo.join(fits, "leaf", "left_semi") if found else todo)
            break
        small.append(_meet(todo, large, "left_anti") if not found else todo.join(fits, "leaf", "left_semi"))
        near, todo = _level(written(_meet(todo, large, "left_semi"), "large_leaves"), similarity)
        found.append(near)
    for s in small:
        found.append(_small(s, similarity, least_docs))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def find_templates(docs: DataFrame, least_docs: int = 5, min_words: int = 2, similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, line) of all documents, and the recurring ones (line, template, n_docs, keeper): template is a number
    of its own, n_docs how many documents have any of its lines, keeper the smallest doc_id."""

    def parse_map(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                seen = set()
                for line in (text.as_py() or "").split("\n"):
                    got = parse(line, min_words)
                    if got and got[1] not in seen:
                        seen.add(got[1])
                        rows.append((key, *got[:3], got[4]))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "leaf", "line", "n", "blob"])

    every = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parse_map, "doc_id long, leaf long, line long, n int, blob binary"), "lines")
    first = F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc")
    sizes = every.groupBy("leaf").agg(F.count("*").alias("rows")).where(F.col("rows") >= least_docs).select("leaf")  # at least as many rows as documents
    near = written(every.join(sizes, "leaf", "left_semi").groupBy("leaf", "line", "n").agg(F.count("*").alias("docs"), F.min("blob").alias("blob")), "near")
    named = written(_templates(near, similarity, least_docs), "line_templates")
    seen = every.select("line", first).join(named, "line").groupBy("template", "doc").agg(F.lit(1).alias("one"))
    totals = seen.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc").alias("keeper")).where(F.col("n_docs") >= least_docs)
    return every.select("doc_id", "line"), named.join(totals, "template").select("line", "template", "n_docs", "keeper")


def drop_recurring_lines(docs: DataFrame, least_docs: int = 5, min_words: int = 2, similarity: float = 0.6, report: bool = False) -> DataFrame:
    """docs with recurring lines dropped from text; with report: doc_id, n_lines, n_dropped, kept_sha256 instead."""
    every, recurring = find_templates(docs, least_docs, min_words, similarity)
    recurring = written(recurring.select("line", "keeper"), "recurring")
    keep, key, drop = docs.columns, unused(docs.columns, "__id"), unused(docs.columns, "__drop")
    drops = every.join(recurring, "line").where(F.coalesce("doc_id", F.lit(-(1 << 62))) != F.col("keeper")).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(drop))
    joined = docs.join(drops, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if report else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])

    def cut(batches):
        import hashlib

        for b in batches:
            texts, sizes = [], []
            for text, gone in zip(b.column("text"), b.column(drop)):
                text, gone = text.as_py(), gone.as_py()
                lines = (text or "").split("\n") if text else []
                kept = lines
                if gone:
                    bad = set(gone)
                    kept = [x for x in lines if (got := parse(x, min_words, False)) is None or got[1] not in bad]
                    text = "\n".join(kept)
                texts.append(text)
                sizes.append((len(lines), len(lines) - len(kept)))
            if report:
                digest = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in sizes], pa.int64()), pa.array([d for _, d in sizes], pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in keep], names=keep)

    return joined.mapInArrow(cut, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=True)
