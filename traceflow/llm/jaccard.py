"""N-gram Jaccard join with filters under several global token orders.

A document's set is its distinct word shingles. Two sets of Jaccard similarity s/100 or more share a token of their
prefixes under *any* global order of tokens. Candidates come from the prefixes under the first order (tokens that are frequent
in prefixes last, the others by hash); they stay only if their prefixes under two further hash orders meet too and their sizes
allow the similarity; what stays is verified exactly on the whole sets.

Copies (equal sets) are one class from the start. A prefix token of more than HOT classes would give a square of pairs: such
classes are compared in blocks by one matrix product each, and of a block only a spanning forest of its links leaves, so neither
copies nor large groups of near copies are expanded into pairs, and no link between components is lost.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing; repeated rows and copies are one
component; a doc_id stands for one text (of several with one doc_id, links of one are verified); rows of a null doc_id are
linked by their texts, and belong to the smallest doc_id that they reach, or to none; an empty table gives no row; further columns
pass through `one_of_each`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Words, blobs, buffers, constants, dealt, fan_out, grams, int64s, lower_ascii, mix, slices, text_bytes, unused, written

#: A prefix token of more classes than this is hot.
HOT = 64
#: Classes that one block of a hot group compares with those of another.
BLOCK = 384
#: Hot tokens that are told to the tasks, most frequent first. It bounds the broadcast; any order of tokens gives the same links.
MOST_HOT = 1 << 20
ORDERS = constants(3, 97)
#: Ids are smaller than this; rows without one are numbered from here on.
NO_ID = 1 << 62


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of a prefix of a set of n that shares a token with that of every set as similar."""
    return n - -(-percent * n // 100) + 1


def sets_of(column: pa.Array, k: int):
    """(row, token) of every distinct shingle of every text, sorted by row, then token; and each row's set size."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        off = offsets[a : b + 1] - offsets[a]
        w = Words(lower_ascii(data[offsets[a] : offsets[b]]), off)
        n = np.diff(w.first)
        g = grams(w.h, k)
        inside = w.row[: len(g)] == w.row[k - 1 :] if len(g) else np.zeros(0, bool)
        row, token = w.row[: len(g)][inside], g[inside]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([int(mix((w.h[w.first[r] : w.first[r + 1]] * constants(k, 11)[: n[r]]).sum(keepdims=True) + np.uint64(int(n[r])))[0]) for r in short], np.uint64)
            row, token = np.append(row, short), np.append(token, whole)
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.append(True, (row[1:] != row[:-1]) | (token[1:] != token[:-1])) if len(row) else np.zeros(0, bool)
        row, token = row[new], token[new]
        yield a, b, row, token, np.bincount(row, minlength=b - a)


def _sums(row: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.uint64)
    np.add.at(out, row, values)
    return out


def identities(row: np.ndarray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set."""
    return mix(_sums(row, mix(token), size) + size.astype(np.uint64)), mix(_sums(row, mix(token ^ np.uint64(0xABCDEF1234567)), size) * np.uint64(3) + size.astype(np.uint64))


def prefixes(row: np.ndarray, token: np.ndarray, size: np.ndarray, percent: int, order: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, whether hot) of each row's prefix under an order."""
    late = np.zeros(len(token), bool)
    if hot is not None and len(hot) and len(token):
        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
        late = hot[at] == token
    by = np.lexsort((mix(token * ORDERS[order]), late, row))
    first = np.concatenate([[0], np.cumsum(size)])
    nth = np.arange(len(token)) - np.repeat(first[:-1], size)
    take = by[nth < np.repeat(prefix_size(size, percent), size)]
    return row[take], token[take], late[take]


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with that intersection are similar enough."""
    return 100 * inter >= percent * (a + b - inter)


def forest(n: int, pairs: np.ndarray) -> list[int]:
    """Indices of pairs that join different trees, one after another."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(i)
    return out


def classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per document its class (doc_id, n_shingles, rep: the smallest doc_id of its set, null for the empty set); and the
    classes: sid, rep, n, other (prefix fingerprints under the second and third order)."""

    def signature(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, row, token, size in sets_of(batch.column("text"), shingle):
                hi, lo = identities(row, token, size)
                other = [b""] * (b - a)
                for order in (1, 2):
                    r, t, _ = prefixes(row, token, size, percent, order)
                    cut = np.searchsorted(r, np.arange(b - a + 1))
                    t32 = (t >> np.uint64(32)).astype("<u4")
                    for i in range(b - a):
                        other[i] += np.sort(t32[cut[i] : cut[i + 1]]).tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size.astype(np.int64)), int64s(hi), int64s(lo), pa.array(other, pa.binary())], names=["doc_id", "n", "hi", "lo", "other"])

    sets = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signature, "doc_id long, n long, hi long, lo long, other binary")
    sets = written(sets, "sets")
    every = written(sets.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("other").alias("other")), "classes")
    # only classes of several rows need a join; the others are their own representatives
    shared = every.where("copies > 1").select("hi", "lo", "n", "rep")
    member = sets.select("doc_id", "n", "hi", "lo").join(shared, ["hi", "lo", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    return member, every.select(F.col("hi").alias("sid"), "rep", "n", "other")


def _hot_tokens(docs: DataFrame, shingle: int, percent: int, buckets: int) -> np.ndarray:
    """Tokens that are in the prefixes (half as long again) of more than HOT classes, sorted; a bounded number of them."""

    def emit(batches):
        for batch in batches:
            for a, b, row, token, size in sets_of(batch.column("text"), shingle):
                hi, _ = identities(row, token, size)
                once = np.zeros(b - a, bool)
                once[np.unique(hi, return_index=True)[1]] = True
                wide = np.minimum(size, prefix_size(size, percent) * 3 // 2 + 16)
                by = np.lexsort((mix(token * ORDERS[0]), row))
                nth = np.arange(len(token)) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
                take = by[(nth < np.repeat(wide, size)) & np.repeat(once, size)]
                t, c = np.unique(token[take], return_counts=True)
                rows = dealt((t % np.uint64(buckets)).astype(np.int64), [t, c.astype(np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], names=["bucket", "t", "c"])

    def count(table: pa.Table) -> pa.Table:
        t, c = blobs(table, "t"), blobs(table, "c")
        u, at = np.unique(t, return_inverse=True)
        n = np.bincount(at, c.astype(np.int64), minlength=len(u)).astype(np.int64)
        return pa.table({"token": int64s(u[n > HOT]), "n": n[n > HOT]})

    found = docs.select("text").mapInArrow(emit, "bucket int, t binary, c binary").groupBy("bucket").applyInArrow(count, "token long, n long")
    rows = found.orderBy(F.desc("n"), "token").limit(MOST_HOT).toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _candidates(docs: DataFrame, shingle: int, percent: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """token, a, b, n_a, n_b: pairs of sids that share a first-order prefix token and may be similar by size; and for tokens of more than HOT sets a row (token, sid, null) each."""

    def emit(batches):
        for batch in batches:
            for a, b, row, token, size in sets_of(batch.column("text"), shingle):
                hi, _ = identities(row, token, size)
                once = np.zeros(b - a, bool)
                once[np.unique(hi, return_index=True)[1]] = True
                r, t, _ = prefixes(row, token, size, percent, 0, hot)
                keep = once[r]
                r, t = r[keep], t[keep]
                rows = dealt((t % np.uint64(buckets)).astype(np.int64), [t, hi[r], size[r].astype(np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3)]], names=["bucket", "t", "s", "n"])

    def pairs(table: pa.Table) -> pa.Table:
        t, s, n = blobs(table, "t"), blobs(table, "s"), blobs(table, "n").astype(np.int64)
        order = np.lexsort((s, t))
        t, s, n = t[order], s[order], n[order]
        new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])) if len(t) else np.zeros(0, bool)
        t, s, n = t[new], s[new], n[new]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        g = np.diff(np.append(first, len(t)))
        out: list[list[np.ndarray]] = [[], [], [], []]
        size = np.repeat(g, g)
        nth = np.arange(len(t)) - np.repeat(first, g)
        for step in range(1, HOT):  # each with the step-th after it in its token's group
            at = np.flatnonzero((size <= HOT) & (nth + step < size))
            if not len(at):
                break
            a, b = n[at], n[at + step]
            ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            at = at[ok]
            for o, v in zip(out, (s[at], s[at + step], n[at], n[at + step])):
                o.append(v)
        a, b, na, nb = (np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out)
        if len(a):
            p = np.unique(np.stack([a, b, na.astype(np.uint64), nb.astype(np.uint64)]), axis=1)
            a, b, na, nb = p
        big = size > HOT
        col = lambda x, y: pa.concat_arrays([int64s(x), y])
        nothing = lambda k: pa.nulls(k, pa.int64())
        k, m = len(a), int(big.sum())
        return pa.Table.from_arrays([pa.concat_arrays([nothing(k), int64s(t[big])]), col(a, int64s(s[big])), col(b, nothing(m))], names=["token", "a", "b"])

    return docs.select("text").mapInArrow(emit, "bucket int, t binary, s binary, n binary").groupBy("bucket").applyInArrow(pairs, "token long, a long, b long")


def _meet(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """Whether the prefixes under the second and the third order both share a fingerprint."""
    px, py = (n + (-percent * n) // 100 + 1 for n in (nx, ny))
    x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    return all(np.isin(x[i * px : i * px + px], y[i * py : i * py + py]).any() for i in (0, 1))


def links(docs: DataFrame, every: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: representatives of classes that are similar enough; of large groups a spanning forest of the links."""
    buckets = fan_out(text_bytes(docs), 4 << 20)
    hot = _hot_tokens(docs, shingle, percent, buckets)
    cand = written(_candidates(docs, shingle, percent, buckets, hot), "candidates")

    # Small groups: pairs that pass the other orders, verified next to their smaller representative.
    pairs = cand.where("b is not null").select("a", "b").distinct()
    of = lambda p: every.select(F.col("sid").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("rep", "n", "other")])

    def filters(batches):
        for b in batches:
            keep = [_meet(*x, percent) for x in zip(*(b.column(c).to_pylist() for c in ("other_a", "other_b", "n_a", "n_b")))]
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("rep_a"), kept.column("rep_b")], names=["a", "b"])

    pairs = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(filters, "a long, b long")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs")

    # Large groups: classes that meet in hot tokens, in blocks of bounded size.
    meets = cand.where("b is null").select("token", F.col("a").alias("sid")).distinct()
    meets = written(meets.join(every.select("sid", "rep"), "sid").select("token", "rep"), "meets")
    center = meets.groupBy("token").agg(F.min("rep").alias("center"))
    group = components(meets.join(center, "token").select(F.col("center").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    sizes = group.groupBy("component").agg(F.count("*").alias("members"))
    spread = group.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    spread = spread.select("component", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select(F.col("node").alias("rep"), F.col("component").alias("g"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").dropDuplicates(["rep"])

    jobs = spread.select("rep", "g", "x", "y").unionByName(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rep")), F.struct(F.col("b").alias("rep")))).alias("e"), F.col("a").alias("g")).select("e.rep", "g", F.lit(-1).alias("x"), F.lit(-1).alias("y")).distinct())
    todo = pairs.groupBy("a").agg(F.collect_list("b").alias("partners")).withColumnRenamed("a", "rep")
    jobs = jobs.join(texts, "rep").join(todo, "rep", "left").select("rep", "g", "x", "y", "text", F.when((F.col("x") < 0) & (F.col("rep") == F.col("g")), F.col("partners")).alias("partners"))

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        rep = table.column("rep").to_numpy()
        rows, tokens, sizes = [], [], []
        for a, _, row, token, size in sets_of(table.column("text"), shingle):
            rows.append(row + a)
            tokens.append(token)
            sizes.append(size)
        row, token, size = np.concatenate(rows), np.concatenate(tokens), np.concatenate(sizes)
        first = np.append(0, np.cumsum(size))
        if table.column("x")[0].as_py() < 0:
            g = table.column("g")[0].as_py()
            me = int(np.searchsorted(rep, g))
            with_ = np.searchsorted(rep, np.array(table.column("partners")[me].as_py() or [], np.int64))
            inter = np.array([len(np.intersect1d(token[first[me] : first[me + 1]], token[first[i] : first[i + 1]], assume_unique=True)) for i in with_], np.int64)
            ok = linked(inter, size[me], size[with_], percent) if len(with_) else np.zeros(0, bool)
            return pa.table({"a": pa.array(np.full(int(ok.sum()), g), pa.int64()), "b": pa.array(rep[with_[ok]] if len(with_) else [], pa.int64())})
        # tokens of one set only can't be shared; the others are the columns of an incidence matrix, taken in strips
        _, col, n = np.unique(token, return_inverse=True, return_counts=True)
        keep = n[col] > 1
        where = np.cumsum(n > 1) - 1
        r, c, width = row[keep], where[col[keep]], int((n > 1).sum())
        inter = np.zeros((len(rep), len(rep)), np.float32)
        by = np.argsort(c, kind="stable")
        r, c = r[by], c[by]
        for at in range(0, width, 4096):
            i, j = np.searchsorted(c, [at, at + 4096])
            strip = np.zeros((len(rep), min(4096, width - at)), np.float32)
            strip[r[i:j], c[i:j] - at] = 1
            inter += strip @ strip.T
        a, b = np.nonzero(np.triu(linked(inter.astype(np.int64), size[:, None], size[None, :], percent), 1))
        kept = forest(len(rep), np.stack([a, b], 1))
        return pa.table({"a": pa.array(rep[a[kept]], pa.int64()), "b": pa.array(rep[b[kept]], pa.int64())})

    return written(jobs.groupBy("g", "x", "y").applyInArrow(verify, "a long, b long"), "links")


def _numbered(docs: DataFrame) -> Column:
    """doc_id, or for a null one a number of its text that is larger than any id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID >> 1)))


def _components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, with numbers for null ids."""
    docs = docs.select(_numbered(docs).alias("doc_id"), "text")
    member, every = classes(docs, shingle, percent)
    found = components(links(docs, every, shingle, percent))
    joined = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of docs(doc_id, text): the smallest doc_id that links of at least percent/100 Jaccard similarity reach.

    Rows of a null id are linked like any other, by their texts; component_id is null where only such rows are reached.
    """
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return _components(docs, shingle, percent).select(known("doc_id"), "n_shingles", known("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are linked to a smaller doc_id of their component, which for rows of a null id is any doc_id; of linked
    rows without an id one text stays. Rows that repeat an id (or have none) and a text are one document: all of them stay or go."""
    key, own = unused(docs.columns, "__id"), unused(docs.columns, "__own")
    gone = _components(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(own, _numbered(docs)).join(gone, F.col(own) == F.col(key), "left_anti").drop(own)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""
