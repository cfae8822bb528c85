"""Approximate nearest neighbours by collision counting over single projections.

Vectors are dealt to shards of bounded size. A shard's index holds, for each of `projections` random directions, its vectors' projections as a sorted array, and is
kept as one row. A query opens a window around its own projection in each array; windows grow together by virtual
rehashing: at radius R they reach R * width / 2 to both sides, and R grows by `growth`. What a window newly takes in counts a collision for
that vector; a vector with at least `threshold` * `projections` collisions is verified by its exact distance, once. A query ends when its k-th
verified distance is within R (or all vectors are verified): of the vectors within R, each has passed the threshold with a probability that depends on
width, projections and threshold only (0.97 by default at distance R, more below).

A query searches its own shard first; the k-th distance found there travels with it, and no later window goes beyond that.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows of a null id, take no part; vectors meet
those of their own length only; ties go to the smaller id; repeated ids count as rows of their own; fewer than k candidates give all;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that are looked at for a query's first radius, and queries that are searched together.
PROBES, TOGETHER = 256, 128


def directions(dim: int, projections: int) -> np.ndarray:
    """Normal directions, the same in every task."""
    return np.random.default_rng(dim * 100_003 + projections).standard_normal((dim, projections))


class Index:
    """A shard: vectors, their ids and row numbers; of each projection the sorted values and the vectors in that order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, order: np.ndarray):
        self.x, self.ids, self.rows, self.values, self.order = x, ids, rows, values, order

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, projections: int) -> Index:
        p = (x @ directions(x.shape[1], projections)).T
        order = np.argsort(p, axis=1, kind="stable")
        return cls(x, ids, rows, np.take_along_axis(p, order, 1), order)

    def windows(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (projections of at) and each array the range of places within reach."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, v in enumerate(self.values):
            low[:, j], high[:, j] = np.searchsorted(v, at[:, j] - reach, "left"), np.searchsorted(v, at[:, j] + reach, "right")
        return low, high

    def distances(self, q: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.x[which] - q).sum(1))


def _taken(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The vectors at places low[j]..high[j] of array j, for all arrays."""
    n = high - low
    begin = np.arange(len(n)) * order.shape[1] + low
    return order.ravel()[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def search(index: Index, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, width: float, threshold: float, growth: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest verified vectors, ids and distances, that aren't its own row; bound: a distance beyond which none is wanted."""
    m, n = index.values.shape
    least = int(np.ceil(threshold * m))
    found: list = []
    for a in range(0, len(q), TOGETHER):
        z = min(a + TOGETHER, len(q))
        at = q[a:z] @ directions(q.shape[1], m)
        probes = index.x[np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64)]
        gaps = np.square(probes).sum(1)[None] - 2 * q[a:z] @ probes.T + np.square(q[a:z]).sum(1)[:, None]
        smallest = 1e-6 * np.sqrt(np.square(q[a:z]).sum(1))  # more than the rounding of projections
        radius = np.maximum(np.minimum(np.sqrt(np.maximum(gaps, 0).min(1)) / 2, bound[a:z]), smallest)
        count = np.zeros((z - a, n), np.int16)
        low = high = None
        best = [(np.zeros(0, np.int64), np.zeros(0))] * (z - a)
        active = np.arange(z - a)
        while len(active):
            new_low, new_high = index.windows(at[active], radius[active] * width / 2)
            if low is None:
                low = np.full((z - a, m), 0)
                low[active] = (new_low + new_high) // 2
                high = low.copy()
            going = np.zeros(len(active), bool)
            for i, c in enumerate(active):
                more = np.append(_taken(index.order, new_low[i], low[c]), _taken(index.order, high[c], new_high[i]))
                now = count[c] + np.bincount(more, minlength=n).astype(np.int16)
                which = np.flatnonzero((now >= least) & (count[c] < least))
                count[c] = now
                which = which[index.rows[which] != own[a + c]]
                ids, d = np.append(best[c][0], index.ids[which]), np.append(best[c][1], index.distances(q[a + c], which))
                by = np.lexsort((ids, d))[:k]
                best[c] = ids[by], d[by]
                enough = len(by) == k and d[by[-1]] <= radius[c]
                going[i] = not enough and radius[c] < bound[a + c] and (now < least).any()
            low[active], high[active] = new_low, new_high
            active = active[going]
            radius[active] = np.minimum(radius[active] * growth, np.maximum(bound[a:z][active], smallest[active]))
        found += best
    return found


_INDEX = "shard int, dim int, x binary, ids binary, rows binary, values binary, order binary"
_FOUND = "query_row long, query_id long, vec_id long, score double"


def _vectors(table: pa.Table) -> np.ndarray:
    return np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False))


def _packed(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        return x.astype("<f4") if (x.astype("<f4") == x).all() else x.astype("<f8")


def _unpacked(row: dict) -> Index:
    of = lambda c, t: np.frombuffer(row[c], t)
    ids, n = of("ids", "<i8"), len(row["ids"]) // 8
    x = of("x", f"<f{len(row['x']) // (n * row['dim'])}").astype(np.float64).reshape(n, -1)
    order = of("order", "<u2" if n <= 1 << 16 else "<i8").reshape(-1, n)
    return Index(x, ids, of("rows", "<i8"), of("values", "<f8").reshape(-1, n), order)


def _result(found: list, q: pa.Table) -> pa.Table:
    n = [len(i) for i, _ in found]
    rep = lambda c: pa.array(np.repeat(q.column(c).to_numpy(), n), pa.int64())
    join = lambda j, t: pa.array(np.concatenate([np.zeros(0, t), *[f[j] for f in found]]))
    return pa.Table.from_arrays([rep("row"), rep("vec_id"), join(0, np.int64), join(1, np.float64)], names=["query_row", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = 64, width: float = 2.719, threshold: float = 0.72, growth: float = 1.2, shard_rows: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance.

    vectors(id, array of numbers). queries: a condition on rows that makes them queries too. shard_rows bounds a shard's index, query_block the queries that
    meet a shard in one task; a shard is sent once for each such block.
    """
    e = F.col("e")
    ok = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.col(vec_col).cast("array<double>").alias("e")).where(ok & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "is_query", F.size("e").alias("dim"), F.col("e").alias("v")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("h", F.xxhash64("row", "vec_id")), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        one = Index.build(_vectors(table), table.column("vec_id").to_numpy(), table.column("row").to_numpy(), projections)
        order = one.order.astype("<u2" if len(one.ids) <= 1 << 16 else "<i8")
        cells = [table.column("shard")[0].as_py(), table.column("dim")[0].as_py(), *[x.tobytes() for x in (_packed(one.x), one.ids, one.rows, one.values, order)]]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=["shard", "dim", "x", "ids", "rows", "values", "order"])

    indexes = written(rows.groupBy("shard", "dim").applyInArrow(build, _INDEX), "indexes")

    def visit(q: pa.Table, table: pa.Table) -> pa.Table:
        if not q.num_rows or not table.num_rows:
            return _result([], q.slice(0, 0))
        index = _unpacked(table.to_pylist()[0])
        return _result(search(index, _vectors(q), q.column("row").to_numpy(), q.column("bound").to_numpy(), k, width, threshold, growth), q)

    asked = rows.where("is_query").select("row", "vec_id", "v", "dim", "shard", "h")
    far = F.lit(float("inf"))
    own = asked.withColumn("bound", far).groupBy("shard", "dim").cogroup(indexes.groupBy("shard", "dim")).applyInArrow(visit, _FOUND)
    found = own
    if shards > 1:
        found = written(own, "own_shard")
        bound = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.max("score")).alias("kth"))
        blocks = max(1, -(-asked.count() // query_block))
        sent = asked.join(bound, asked.row == bound.query_row, "left").select("row", "vec_id", "v", "dim", F.coalesce("kth", far).alias("bound"), F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int").alias("block"), F.col("shard").alias("own"))
        sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> own").drop("own")
        held = indexes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = found.unionByName(sent.groupBy("shard", "block", "dim").cogroup(held.groupBy("shard", "block", "dim")).applyInArrow(visit, _FOUND))
    by = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
