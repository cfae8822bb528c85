"""Sections through a horizon on a lattice: fault polygons where sticks pierce it, and profiles draped over it.

Horizons are horizon(ix, iy, z), a node each; a null z, like a missing node, is undefined. Sticks and paths are in lattice coordinates.
A segment meets only the cells in its own box, by an equi-join on their corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
#: So much of a cell is added to a segment's box, lest rounding hide a hit on a cell's border.
_SLACK = 1e-6


def _triangle_hit(p: list[Column], q: list[Column], corners: list[tuple[Column, Column, Column]]) -> Column:
    """Where along pq (0 to 1) it meets a triangle, edges included; null if it doesn't, is parallel to it, or a corner is undefined."""
    minus = lambda a, b: [x - y for x, y in zip(a, b)]
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    along, e1, e2, s = minus(q, p), minus(corners[1], corners[0]), minus(corners[2], corners[0]), minus(p, corners[0])
    h, k = cross(along, e2), cross(s, e1)
    det = F.nullif(dot(e1, h), F.lit(0.0))
    u, v, t = dot(s, h) / det, dot(along, k) / det, dot(e2, k) / det
    eps = 1e-12
    return F.when((u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t >= -eps) & (t <= 1 + eps), t)


def _with_corners(at: DataFrame, horizon: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys and corner0..corner3: the z of the four corners of the cell (row, col) of each row of `at`, from its lower one around."""
    each = at.select(*keys, F.posexplode(F.array(*[F.struct((F.col("row") + i * step).alias("ix"), (F.col("col") + j * step).alias("iy")) for i, j in _CORNERS])).alias("__corner", "__node"))
    z = each.select(*keys, "__corner", "__node.ix", "__node.iy").join(horizon.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("z").alias("__z")), ["ix", "iy"])
    return z.groupBy(*keys).agg(*[F.max(F.when(F.col("__corner") == c, F.col("__z"))).alias(f"corner{c}") for c in range(4)])


def _cells(horizon: DataFrame, step: int) -> DataFrame:
    """row, col and corner0..corner3 of the cells of which a triangle has three defined corners: the z of their corners, from the lower one around."""
    nodes = horizon.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("z").alias("__z")).where("__z is not null")
    each = nodes.select("__z", F.posexplode(F.array(*[F.struct((F.col("ix") - i * step).alias("row"), (F.col("iy") - j * step).alias("col")) for i, j in _CORNERS])).alias("__corner", "__cell"))
    cells = each.groupBy("__cell.row", "__cell.col").agg(*[F.max(F.when(F.col("__corner") == c, F.col("__z"))).alias(f"corner{c}") for c in range(4)])
    return cells.where("corner0 is not null and corner2 is not null and (corner1 is not null or corner3 is not null)")


def fault_polygons(sticks: DataFrame, horizon: DataFrame, step: int = 1) -> DataFrame:
    """fault, seq, x, y, z: where the segments of a fault's sticks pierce a horizon, along the sticks and back again.

    sticks(fault, stick, seq, x, y, z). A segment looks at the cells in its box, row by row, at two triangles each; the first hit counts. (A point of a segment lies in its box, so the cells
    from one before to one behind the nodes next to its ends have no other hits.) Faults that nowhere pierce have no row; a segment with an undefined end is left out.
    """
    by = Window.partitionBy("fault", "stick").orderBy("seq")
    ends = sticks.select("fault", "stick", "seq", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.lead(F.col(c).cast("double")).over(by).alias(f"{c}2") for c in "xyz"])
    ends = ends.where(" and ".join(f"{c} is not null and {c}2 is not null" for c in "xyz"))
    snap = lambda v: (F.floor(v / step) * step).cast("long")
    span = lambda a, b: F.sequence(snap(F.least(a, b) - _SLACK * step), snap(F.greatest(a, b) + _SLACK * step), F.lit(step).cast("long"))
    at = ends.withColumn("row", F.explode(span("x", "x2"))).withColumn("col", F.explode(span("y", "y2")))
    # merged: the planner's estimate knows nothing of the rows that explode makes, and would broadcast the sticks' cells through the driver
    cells = at.hint("merge").join(_cells(horizon, step), ["row", "col"])
    p, q = [F.col(c) for c in "xyz"], [F.col(f"{c}2") for c in "xyz"]
    corner = lambda c: ((F.col("row") + _CORNERS[c][0] * step).cast("double"), (F.col("col") + _CORNERS[c][1] * step).cast("double"), F.col(f"corner{c}"))
    t = F.coalesce(*[_triangle_hit(p, q, [corner(0), corner(a), corner(b)]) for a, b in ((1, 2), (2, 3))])
    hit = cells.withColumn("t", t).where("t is not null").groupBy("fault", "stick", "seq").agg(F.min_by(F.struct(*[(a + F.col("t") * (b - a)).alias(c) for a, b, c in zip(p, q, "xyz")]), F.struct("row", "col")).alias("at"))
    passes = hit.select("fault", "at.x", "at.y", "at.z", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("stick").alias("a"), F.col("seq").alias("b")), F.struct(F.lit(1).alias("n"), (-F.col("stick")).alias("a"), (-F.col("seq")).alias("b")))).alias("o"))
    order = Window.partitionBy("fault").orderBy("o.n", "o.a", "o.b")
    return passes.select("fault", (F.row_number().over(order) - 1).cast("long").alias("seq"), "x", "y", "z")


def at_constant_z(points: DataFrame, z: float) -> DataFrame:
    """A picked polyline put on one level: all its vertices get z."""
    return points.withColumn("z", F.lit(float(z)))


def grid_line(legs: DataFrame, keys: list[str], step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """keys, n, x, y: each leg (x1, y1, x2, y2) cut where it crosses the lines of a grid through the origin, ends included; n counts from 0. Legs without length have no row."""

    def cuts(a: str, b: str, s: float) -> Column:
        low, high, d = F.least(a, b), F.greatest(a, b), F.col(b) - F.col(a)
        first, last = F.ceil(low / s).cast("long"), F.floor(high / s).cast("long")
        return F.when((d != 0) & (first <= last), F.transform(F.sequence(first, last), lambda k: (k * s - F.col(a)) / d)).otherwise(F.array().cast("array<double>"))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    t = F.concat(ends, cuts("x1", "x2", step[0]), cuts("y1", "y2", step[1]))
    t = F.array_sort(F.array_distinct(F.transform(t, lambda v: F.round(v, 12))))
    legs = legs.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 <> x2 or y1 <> y2")
    at = legs.select(*keys, "x1", "y1", "x2", "y2", F.posexplode(t).alias("n", "t"))
    return at.select(*keys, F.col("n").cast("long").alias("n"), *[(F.col(f"{c}1") + F.col("t") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xy"])


def draped(points: DataFrame, horizon: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """keys, x, y, z: points with the bilinear z of the horizon's cell they lie in; null unless all four corners are defined."""
    at = points.select(*keys, "x", "y", *[(F.floor(F.round(F.col(c), 9) / step) * step).cast("long").alias(r) for c, r in (("x", "row"), ("y", "col"))])
    z = _with_corners(at, horizon, [*keys, "x", "y", "row", "col"], step)
    u, v = (F.col("x") - F.col("row")) / step, (F.col("y") - F.col("col")) / step
    value = (1 - u) * ((1 - v) * F.col("corner0") + v * F.col("corner1")) + u * ((1 - v) * F.col("corner3") + v * F.col("corner2"))
    return points.select(*keys, "x", "y").join(z.select(*keys, value.alias("z")), keys, "left")


def profiles(paths: DataFrame, horizon: DataFrame, step: int = 1) -> DataFrame:
    """path, part, n, x, y, z: polylines draped over a horizon, at their vertices and where they cross its grid lines.

    paths(path, seq, x, y). Undefined points are left out and cut a path into parts, which are numbered from 0, as are the points of a part.
    """
    by = Window.partitionBy("path").orderBy("seq")
    legs = paths.select("path", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(by).alias("x2"), F.lead("y").over(by).alias("y2")).where("x2 is not null")
    keys = ["path", "seq", "n"]
    z = draped(grid_line(legs, ["path", "seq"], (float(step), float(step))), horizon, keys, step)
    along = Window.partitionBy("path").orderBy("seq", "n")
    z = z.withColumn("gap", F.sum(F.col("z").isNull().cast("long")).over(along)).where("z is not null")
    part = Window.partitionBy("path", "gap").orderBy("seq", "n")
    return z.select("path", (F.dense_rank().over(Window.partitionBy("path").orderBy("gap")) - 1).cast("long").alias("part"), (F.row_number().over(part) - 1).cast("long").alias("n"), "x", "y", "z")
