"""Exact top-k search by inner product over KD-trees, one per shard.

Candidates are dealt to shards of bounded size; each shard builds a KD-tree by median splits with tight bounding
boxes, once, and is kept as one row: its vectors in the order of the tree, and the nodes. A query first searches its own shard; the k-th
score found there travels with it. A task then takes a block of queries through a lane of several shards: one traversal of
all their trees, best first. A node's bound is the largest inner product with the query that its box allows; a query opens
the node of its best bound, and ends when that is below the k-th score it has found in any shard so far.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0;
vectors meet those of their own length only; ties go to the smaller id, repeated ids count as rows of their own;
fewer than k candidates give all; scores beyond the range of a long are its ends; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEAF = 512
#: Shards that a task searches together.
LANE = 4
_LOWEST, _HIGHEST = -(2**63) + 1, 2**63 - 1
_NODE = np.dtype([("from", "<i8"), ("to", "<i8"), ("left", "<i8"), ("right", "<i8")])


class KDTree:
    """A shard's rows in the order of its tree, and the nodes with their boxes: leaves hold at most LEAF rows, or equal ones."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, shard: int = 0):
        self.x, self.ids, self.rows, self.nodes, self.low, self.high, self.shard = x, ids, rows, nodes, low, high, shard

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> KDTree:
        order, nodes, low, high = np.arange(len(x)), [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, z, parent, side = stack.pop()
            own = x[order[a:z]]
            lo, hi = own.min(0), own.max(0)
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            node = len(nodes)
            nodes.append([a, z, -1, -1])
            low.append(lo)
            high.append(hi)
            if z - a > LEAF and (hi > lo).any():
                d = int(np.argmax(hi - lo))
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(own[:, d], half)]
                stack += [(a + half, z, node, 1), (a, a + half, node, 0)]
        return cls(x[order], ids[order], rows[order], np.array([tuple(n) for n in nodes], _NODE), np.array(low), np.array(high))


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product with each q that a box allows."""
    q = q.astype(np.float64)
    return np.maximum(q, 0) @ high.astype(np.float64) + np.minimum(q, 0) @ low.astype(np.float64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by float64 where that is exact, else by Python's integers."""
    if not x.shape[-1] or float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * x.shape[-1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, _LOWEST, _HIGHEST).astype(np.int64)


def _best(at: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, score, id) the k best of each of n queries, in order; and each query's k-th score, or the smallest there is."""
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    first = np.searchsorted(at, np.arange(n + 1))
    keep = np.arange(len(at)) - first[at] < k
    at, score, ids = at[keep], score[keep], ids[keep]
    kth = np.full(n, _LOWEST)
    first = np.searchsorted(at, np.arange(n + 1))
    full = np.diff(first) >= k
    kth[full] = score[first[1:][full] - 1]
    return at, score, ids, kth


def search(trees: list[KDTree], q: np.ndarray, own_rows: np.ndarray, done: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best candidates of these trees that reach its floor.

    done: the shard that a query has searched before (its tree isn't entered); a candidate whose row is the query's own is left out.
    Queries move on together, each opening the node of its best bound among those it has reached; those that are at one node share the work.
    A query ends where its best bound is below its k-th score, since all that is left lies lower still.
    """
    n = len(q)
    at, score, found = (np.zeros(0, np.int64) for _ in range(3))
    trees = [t for t in trees if len(t.x)]
    if not n or not trees:
        return [(at, at)] * n
    base = np.cumsum([0] + [len(t.nodes) for t in trees])
    reached = np.full((n, base[-1]), -np.inf)
    for t, b in zip(trees, base):
        reached[:, b] = np.where(done == t.shard, -np.inf, _bounds(q, t.low[0], t.high[0]))
    limit = floor.astype(np.int64).copy()
    active = np.arange(n)
    while len(active):
        node = reached[active].argmax(1)
        bound = reached[active, node]
        going = (bound > -np.inf) & (bound + 0.5 >= limit[active])  # bounds are of integers: half a unit is more than their rounding
        active, node = active[going], node[going]
        new = []
        for one in np.unique(node):
            who = active[node == one]
            reached[who, one] = -np.inf
            i = int(np.searchsorted(base, one, "right")) - 1
            t = trees[i]
            a, z, left, right = t.nodes[one - base[i]].tolist()
            if left >= 0:
                for child in (left, right):
                    reached[who, base[i] + child] = _bounds(q[who], t.low[child], t.high[child])
                continue
            s = _exact(q[who], t.x[a:z])
            other = own_rows[who][:, None] != t.rows[None, a:z]
            least = limit[who]
            if s.shape[1] > k:  # at least k of these reach the (k + 1)-th of them, whether or not the query itself is one
                least = np.maximum(least, -np.partition(-s, k, 1)[:, k])
            r, c = np.nonzero((s >= least[:, None]) & other)
            new.append((who[r], s[r, c], t.ids[a:z][c]))
        if new:
            at, score, found = (np.concatenate([old, *[e[c] for e in new]]) for c, old in enumerate((at, score, found)))
            at, score, found, kth = _best(at, score, found, n, k)
            limit = np.maximum(limit, kth)
    first = np.searchsorted(at, np.arange(n + 1))
    return [(found[a:z], score[a:z]) for a, z in zip(first, first[1:])]


_FOUND = "query_row long, query_id long, vec_id long, score long"
_TREE = "shard int, dim int, type string, x binary, ids binary, rows binary, nodes binary, low binary, high binary"


def _vectors(table: pa.Table) -> np.ndarray:
    return np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False)) if table.num_rows and len(table.column("v")[0]) else np.zeros((table.num_rows, 0), np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest type of integers that holds it."""
    return next(x.astype(t) for t in ("<i1", "<i2", "<i4", "<i8") if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))


def _packed(tree: KDTree, shard: int, dim: int) -> dict:
    x = _narrow(tree.x)
    return {"shard": shard, "dim": dim, "type": x.dtype.str, "x": x.tobytes(), "ids": tree.ids.tobytes(), "rows": tree.rows.tobytes(), "nodes": tree.nodes.tobytes(), "low": tree.low.astype(x.dtype).tobytes(), "high": tree.high.astype(x.dtype).tobytes()}


def _unpacked(row: dict) -> KDTree:
    of = lambda c, t: np.frombuffer(row[c], t)
    nodes, ids = of("nodes", _NODE), of("ids", "<i8")
    x, low, high = (of(c, row["type"]).reshape(n, row["dim"]) for c, n in (("x", len(ids)), ("low", len(nodes)), ("high", len(nodes))))
    return KDTree(x, ids, of("rows", "<i8"), nodes, low, high, row["shard"])


def _rows(found: list, q: pa.Table) -> pa.Table:
    n = [len(i) for i, _ in found]
    rep = lambda c: pa.array(np.repeat(q.column(c).to_numpy(), n), pa.int64())
    ids, scores = ([f[j] for f in found] for j in (0, 1))
    join = lambda a: pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64())
    return pa.Table.from_arrays([rep("row"), rep("vec_id"), join(ids), join(scores)], names=["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shard_rows: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other rows.

    vectors(id, array of numbers); each component becomes floor(scale * x). queries: a condition on rows that makes
    them queries too. shard_rows bounds a shard; queries meet lanes of LANE shards in blocks of query_block.
    """
    ok = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.col(vec_col).cast("array<double>").alias("e")).where(ok)
    # repeated ids are rows of their own: equal rows are told apart by a number
    rows = rows.select("vec_id", "is_query", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale)).cast("array<bigint>").alias("v"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("row", "vec_id"), F.lit(shards)).cast("int")), "vectors")
    asked = rows.where("is_query")

    def build(table: pa.Table) -> pa.Table:
        tree = KDTree.build(_vectors(table), table.column("vec_id").to_numpy(), table.column("row").to_numpy())
        row = _packed(tree, table.column("shard")[0].as_py(), table.column("dim")[0].as_py())
        types = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 6
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    trees = written(rows.groupBy("shard", "dim").applyInArrow(build, _TREE), "trees")

    def visit(q: pa.Table, table: pa.Table) -> pa.Table:
        if not q.num_rows or not table.num_rows:
            return _rows([], q.slice(0, 0))
        column = lambda c: q.column(c).to_numpy()
        return _rows(search([_unpacked(r) for r in table.to_pylist()], _vectors(q), column("row"), column("done"), column("floor"), k), q)

    own = asked.select("row", "vec_id", "v", "dim", "shard", F.lit(-1).alias("done"), F.lit(_LOWEST).alias("floor"))
    first = own.groupBy("shard", "dim").cogroup(trees.groupBy("shard", "dim")).applyInArrow(visit, _FOUND)
    if shards == 1:
        found = first
    else:
        first = written(first, "own_shard")
        floor = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_row", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(_LOWEST)).alias("floor"))
        blocks, lanes = max(1, -(-asked.count() // query_block)), -(-shards // LANE)
        sent = asked.join(floor, asked.row == floor.query_row, "left").select("row", "vec_id", "v", "dim", F.col("shard").alias("done"), F.coalesce("floor", F.lit(_LOWEST)).alias("floor"))
        sent = sent.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        # a lane's trees go to each block of queries once, as they were built
        held = trees.withColumn("lane", (F.col("shard") / LANE).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = first.unionByName(sent.groupBy("lane", "block", "dim").cogroup(held.groupBy("lane", "block", "dim")).applyInArrow(visit, _FOUND))
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
