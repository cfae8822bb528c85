"""Smooth surfaces through scattered points: multilevel B-splines, and local thin plates on what these leave.

points(id, x, y, v) and nodes(ix, iy) as in gridding. A level's control lattice has 2^level cells each way. Points reach it by an aggregation with partial sums, and its patches (16
control values a cell) reach points and nodes by an equi-join on the cell, so a level costs one pass over the points at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gridding import sectors
from .saved import discard, saved

#: Levels of up to so many cells in all are broadcast (17 numbers a cell), larger ones are joined by shuffle.
MOST_BROADCAST = 4**6


def _splines(u: Column) -> list[Column]:
    """The four uniform cubic B-splines at u in [0, 1]."""
    return [(1 - u) * (1 - u) * (1 - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]


def _placed(df: DataFrame, x: str, y: str, box, cells: int) -> DataFrame:
    """df with the cell __ci, __cj of each row and the places __s, __t in it."""
    out = df
    for c, lo, hi, cell, place in ((x, box.x0, box.x1, "__ci", "__s"), (y, box.y0, box.y1, "__cj", "__t")):
        u = (F.col(c) - float(lo)) * (cells / float(hi - lo if hi > lo else 1))
        out = out.withColumn(place, u).withColumn(cell, F.least(F.floor(place), F.lit(cells - 1)).cast("long")).withColumn(place, F.col(place) - F.col(cell))
    return out


def _patches(placed: DataFrame, cells: int) -> DataFrame:
    """__ci, __cj, __p: the 16 control values that rule a cell, from the rows' values r; cells without any are absent."""
    s, t = _splines(F.col("__s")), _splines(F.col("__t"))
    norm = sum(b * b for b in s) * sum(b * b for b in t)
    parts = F.array(*[F.struct((F.col("__ci") + k).alias("i"), (F.col("__cj") + m).alias("j"), (s[k] * t[m]).alias("w")) for k in range(4) for m in range(4)])
    e = placed.select("r", norm.alias("norm"), F.explode(parts).alias("e")).select("r", "norm", "e.*")
    control = e.groupBy("i", "j").agg((F.sum(F.col("w") * F.col("w") * F.col("w") * F.col("r") / F.col("norm")) / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("phi"))
    served = F.array(*[F.struct((F.col("i") - k).alias("__ci"), (F.col("j") - m).alias("__cj"), F.lit(4 * k + m).alias("n")) for k in range(4) for m in range(4)])
    spread = control.select("phi", F.explode(served).alias("e")).select("phi", "e.*").where(F.col("__ci").between(0, cells - 1) & F.col("__cj").between(0, cells - 1))
    values = [F.coalesce(F.sum(F.when(F.col("n") == n, F.col("phi"))), F.lit(0.0)) for n in range(16)]
    return spread.groupBy("__ci", "__cj").agg(F.array(*values).alias("__p"))


def _evaluated(placed: DataFrame, patches: DataFrame, cells: int) -> DataFrame:
    """placed with __f, the level's value; 0 where no control value reaches."""
    s, t = _splines(F.col("__s")), _splines(F.col("__t"))
    value = sum(s[k] * t[m] * F.get("__p", F.lit(4 * k + m)) for k in range(4) for m in range(4))
    joined = placed.join(F.broadcast(patches) if cells * cells <= MOST_BROADCAST else patches, ["__ci", "__cj"], "left")
    return joined.withColumn("__f", F.coalesce(value, F.lit(0.0))).drop("__ci", "__cj", "__s", "__t", "__p")


def plane(points: DataFrame, value: str = "r") -> tuple[float, float, float]:
    """c, a, b of the least-squares plane c + a x + b y, by one aggregation; of points on one line (or a single one) the flattest of the best."""
    middle = points.agg(*[F.avg(c).alias(c) for c in ("x", "y", value)]).first()
    if middle[0] is None:
        return 0.0, 0.0, 0.0
    x, y, v = (F.col(c) - m for c, m in zip(("x", "y", value), middle))
    xx, xy, yy, xv, yv = points.agg(F.sum(x * x), F.sum(x * y), F.sum(y * y), F.sum(x * v), F.sum(y * v)).first()
    a, b = np.linalg.lstsq(np.array([[xx, xy], [xy, yy]]), np.array([xv, yv]), rcond=1e-12)[0]
    return float(middle[2] - a * middle[0] - b * middle[1]), float(a), float(b)


def multilevel(nodes: DataFrame, points: DataFrame, levels: int = 10, linear: bool = False, tol: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Multilevel B-spline approximation from 2 x 2 control points (one cell) on, each level halving the cells.

    Gives (ix, iy, v) for every node, and the points as (id, x, y, v) with what the surface leaves of v. Points beyond the nodes' bounding box, or with a null in x, y or v, take no
    part. Without points (or nodes) every v is null. linear: start from the least-squares plane instead of zero. tol: stop when the plane or a level leaves no more than that at any point.
    Of the points only the last level's version stays in the shared folder.
    """
    box = nodes.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1")).first()
    left = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("r")).dropna(subset=["x", "y", "r"])
    out = nodes.select("ix", "iy")
    if box.x0 is not None:
        left = saved(left.where(F.col("x").between(box.x0, box.x1) & F.col("y").between(box.y0, box.y1)))
    if box.x0 is None or left.isEmpty():
        return out.withColumn("v", F.lit(None).cast("double")), left.where(F.lit(False)).withColumnRenamed("r", "v")

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        new = saved(new)
        discard(old)
        return new

    def near_enough() -> bool:
        return tol is not None and left.agg(F.max(F.abs("r")).alias("m")).first().m <= tol

    out = out.withColumn("v", F.lit(0.0))
    if linear:
        c, a, b = plane(left)
        left = replaced(left, left.withColumn("r", F.col("r") - (c + a * F.col("x") + b * F.col("y"))))
        out = out.withColumn("v", c + a * F.col("ix") + b * F.col("iy"))
    for level in range(levels):
        if near_enough():
            break
        cells = 2**level
        at = _placed(left, "x", "y", box, cells)
        patches = saved(_patches(at, cells), 1 if cells * cells <= MOST_BROADCAST else None)
        left = replaced(left, _evaluated(at, patches, cells).withColumn("r", F.col("r") - F.col("__f")).drop("__f"))
        out = _evaluated(_placed(out, "ix", "iy", box, cells), patches, cells).withColumn("v", F.col("v") + F.col("__f")).drop("__f")
    return out.select("ix", "iy", "v"), left.select("id", "x", "y", F.col("r").alias("v"))


def _basis(rho: np.ndarray) -> np.ndarray:
    r = rho + 1e-4
    return np.where(r > 1, 0.0, r * (np.log(r) - 1) + 1)


def plate(x: np.ndarray, y: np.ndarray, v: np.ndarray, d2: np.ndarray, radius: float) -> float:
    """Value at a node of the damped thin plate through a few points, d2 their squared distances to it."""
    m = _basis(((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) / radius**2)
    w = np.linalg.solve(m.T @ m + 0.01 * np.eye(len(x)), m.T @ (v - v.mean()))
    return float(w @ _basis(d2 / radius**2) + v.mean())


def thin_plate(nodes: DataFrame, points: DataFrame, edges: list[tuple] | DataFrame, radius: float, most: int = 4, least: int = 5, levels: int = 8, linear: bool = False, tol: float | None = None) -> DataFrame:
    """ix, iy, v: the multilevel surface (linear, tol: as there), plus at nodes with enough filled sectors a thin plate through what it leaves at the chosen points.

    At most 8 x `most` visible points of 8 sectors rule a node, so the solve of a node is bounded. Nodes with fewer than `least` filled sectors keep the surface.
    """
    surface, left = multilevel(nodes, points, levels, linear, tol)
    near = sectors(nodes, left, edges, radius, most, least)
    chosen = near.groupBy("ix", "iy").agg(F.sort_array(F.collect_list(F.struct("d2", "id", "x", "y", "v"))).alias("p"))
    fields = ("x", "y", "v", "d2")
    flat = chosen.select("ix", "iy", *[F.col(f"p.{c}").cast("array<double>").alias(c) for c in fields])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ix": b.ix, "iy": b.iy, "more": np.array([plate(*row, radius) for row in zip(*[b[c] for c in fields])], float)})

    more = flat.mapInPandas(solve, "ix long, iy long, more double")
    return surface.join(more, ["ix", "iy"], "left").select("ix", "iy", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v"))
