"""Gridding of scattered points to a lattice, with faults as barriers to sight.

points(id, x, y, v) in lattice units. Faults are a table of edges (fault, seq, x1, y1, x2, y2). Points meet cells by buckets of the search radius, so work follows the
points near a cell, not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .saved import saved

#: More fault edges than this are joined, not held in the expression.
MOST_EDGES = 2_000


def lattice(points: DataFrame, step: int = 1) -> DataFrame:
    """ix, iy: the lattice over the points' bounding box, snapped outward to the step."""
    snap = lambda f, c: (f(F.col(c) / step) * step).cast("long")
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    box = box.where("min_x is not null").select(snap(F.floor, "min_x").alias("x0"), snap(F.ceil, "max_x").alias("x1"), snap(F.floor, "min_y").alias("y0"), snap(F.ceil, "max_y").alias("y1"))
    rows = box.select(F.explode(F.sequence("x0", "x1", F.lit(step).cast("long"))).alias("ix"), "y0", "y1").repartition("ix")  # columns of nodes over all tasks
    return rows.select("ix", F.explode(F.sequence("y0", "y1", F.lit(step).cast("long"))).alias("iy"))


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd meet; parallel ones don't."""
    den = (dy - cy) * (bx - ax) - (dx - cx) * (by - ay)
    ua, ub = (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx), (bx - ax) * (ay - cy) - (by - ay) * (ax - cx)
    ta, tb = F.try_divide(ua, den), F.try_divide(ub, den)
    return F.coalesce((F.abs(den) > 1e-12) & (ta >= 0) & (ta <= 1) & (tb >= 0) & (tb <= 1), F.lit(False))


def in_sight(ax: Column, ay: Column, bx: Column, by: Column, edges: list[tuple]) -> Column:
    """Whether no fault edge lies between two points. edges are (fault, seq, x1, y1, x2, y2), at most MOST_EDGES; `visible` takes any number."""
    if len(edges) > MOST_EDGES:
        raise ValueError("join the edges instead: visible()")
    blocked = F.lit(False)
    for _, _, x1, y1, x2, y2 in edges:
        blocked = blocked | segments_cross(ax, ay, bx, by, F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2))
    return ~blocked


def visible(pairs: DataFrame, edges: DataFrame, ends: tuple[str, str, str, str], keys: list[str], cell: float) -> DataFrame:
    """pairs between whose ends (columns ax, ay, bx, by) no edge lies: edges(x1, y1, x2, y2) and pairs meet by the cells of their bounding boxes.

    keys identify a pair. cell: about the length of a line of sight.
    """
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    ax, ay, bx, by = (F.col(c).cast("double") for c in ends)
    spread = pairs.select(*keys, ax.alias("__ax"), ay.alias("__ay"), bx.alias("__bx"), by.alias("__by"))
    spread = spread.withColumn("__cx", F.explode(span("__ax", "__bx"))).withColumn("__cy", F.explode(span("__ay", "__by")))
    walls = edges.select("x1", "y1", "x2", "y2").withColumn("__cx", F.explode(span("x1", "x2"))).withColumn("__cy", F.explode(span("y1", "y2")))
    hit = spread.join(walls, ["__cx", "__cy"]).where(segments_cross(*[F.col(c) for c in ("__ax", "__ay", "__bx", "__by", "x1", "y1", "x2", "y2")]))
    return pairs.join(hit.select(*keys).distinct(), keys, "left_anti")


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon, by the even-odd rule."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            over = ((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + over.cast("int")
    return crossings % 2 == 1


def splat(points: DataFrame, edges: list[tuple] | DataFrame) -> DataFrame:
    """ix, iy, v: points spread to their four lattice nodes with weight tanh(d2) / d2, or 1 on a node; hidden nodes get nothing. Edges in a table are joined; point ids then tell points apart."""
    corners = F.array(*[F.struct((F.floor("x") + i).cast("long").alias("ix"), (F.floor("y") + j).cast("long").alias("iy")) for i in (0, 1) for j in (0, 1)])
    e = points.select("id", "x", "y", "v", F.explode(corners).alias("n")).select("id", "x", "y", "v", "n.ix", "n.iy")
    dx, dy = F.col("x") - F.col("ix"), F.col("y") - F.col("iy")
    exact = (F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y"))
    e = _seen(e.withColumn("d2", dx * dx + dy * dy).where((F.col("d2") == 0) | ~exact), edges, 1.0)
    w = F.when(F.col("d2") == 0, 1.0).otherwise(F.tanh("d2") / F.nullif("d2", F.lit(0.0)))
    return e.withColumn("w", w).groupBy("ix", "iy").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def near(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of a cell and a point within radius, with d2: each point goes to the 3 x 3 buckets around it, an equi-join follows."""
    cells = cells.withColumns({"bx": F.floor(F.col("ix") / radius).cast("long"), "by": F.floor(F.col("iy") / radius).cast("long")})
    own = lambda c: F.floor(F.col(c) / radius).cast("long")
    spread = points.withColumn("bx", F.explode(F.sequence(own("x") - 1, own("x") + 1))).withColumn("by", F.explode(F.sequence(own("y") - 1, own("y") + 1)))
    dx, dy = F.col("ix") - F.col("x"), F.col("iy") - F.col("y")
    return cells.join(spread, ["bx", "by"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).drop("bx", "by")


def idw_local(cells: DataFrame, points: DataFrame, edges: list[tuple] | DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """ix, iy, v: inverse squared distance over the visible points within radius, nearest first, at most `most` of them."""
    pairs = _seen(near(cells, points, radius), edges, radius)
    if most is not None:
        w = Window.partitionBy("ix", "iy").orderBy("d2", "id")
        pairs = pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return _weighted(pairs)


def _seen(pairs: DataFrame, edges: list[tuple] | DataFrame, radius: float) -> DataFrame:
    """Pairs of a node and a point in sight of each other: few edges go into the expression, a table of edges is joined."""
    if isinstance(edges, DataFrame):
        return visible(pairs, edges, ("ix", "iy", "x", "y"), ["ix", "iy", "id"], radius)
    return pairs.where(in_sight(F.col("ix"), F.col("iy"), F.col("x"), F.col("y"), edges))


def _weighted(pairs: DataFrame) -> DataFrame:
    k = 1 / (F.col("d2") + 0.001)
    return pairs.groupBy("ix", "iy").agg((F.sum(F.col("v") * k) / F.sum(k)).alias("v"))


def nearest(cells: DataFrame, points: DataFrame, most: int, radius: float) -> DataFrame:
    """Pairs of a cell and its `most` nearest points (ties to the smaller id), with d2: cells that find fewer within radius look again within twice that."""
    extent = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    if not extent.n:
        return near(cells, points, radius)
    box = cells.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1")).first()
    span = max(max(extent.x1, box.x1 or 0) - min(extent.x0, box.x0 or 0), max(extent.y1, box.y1 or 0) - min(extent.y0, box.y0 or 0), 1.0)
    w = Window.partitionBy("ix", "iy").orderBy("d2", "id")
    cell = Window.partitionBy("ix", "iy")
    out, left = None, cells
    while True:
        last = radius >= 1.5 * span  # nothing lies farther apart
        got = saved(near(left, points, radius).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).withColumn("__all", F.count("*").over(cell)))
        done = got if last else got.where(F.col("__all") >= most)
        out = done if out is None else out.unionByName(done)
        if last:
            break
        left = saved(left.join(done.select("ix", "iy").distinct(), ["ix", "iy"], "left_anti"))
        if left.isEmpty():
            break
        radius *= 2
    return out.drop("__n", "__all")


def idw_nearest(cells: DataFrame, points: DataFrame, edges: list[tuple] | DataFrame, most: int, radius: float) -> DataFrame:
    """ix, iy, v: inverse squared distance over those of the `most` nearest points that are visible; radius is that of the first search."""
    return _weighted(_seen(nearest(cells, points, most, radius), edges, radius))


def idw(cells: DataFrame, points: DataFrame, edges: list[tuple] | DataFrame, radius: float | None = None, most: int | None = None, first_radius: float = 8.0) -> DataFrame:
    """Inverse distance by what is given: a radius (and a number) of visible points, or the nearest points of which the visible count."""
    if radius is not None:
        return idw_local(cells, points, edges, radius, most)
    if most is None:
        raise ValueError("give a radius, a number of points, or both: all points for every node would be all pairs")
    return idw_nearest(cells, points, edges, most, first_radius)


def sectors(cells: DataFrame, points: DataFrame, edges: list[tuple] | DataFrame, radius: float, most: int = 4, least: int = 5) -> DataFrame:
    """ix, iy, sector, id: per cell the nearest visible points of each 45-degree sector, of cells with enough filled sectors."""
    pairs = _seen(near(cells, points, radius), edges, radius)
    angle = F.degrees(F.atan2(F.col("y") - F.col("iy"), F.col("x") - F.col("ix"))) + 180
    pairs = pairs.withColumn("sector", F.least(F.floor(angle / 45), F.lit(7)).cast("int"))
    w = Window.partitionBy("ix", "iy", "sector").orderBy("d2", "id")
    chosen = pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    cell = Window.partitionBy("ix", "iy")
    return chosen.withColumn("__s", F.size(F.collect_set("sector").over(cell))).where(F.col("__s") >= least).drop("__n", "__s")


def edge_table(spark: SparkSession, edges: list[tuple]) -> DataFrame:
    return spark.createDataFrame(edges, "fault int, seq int, x1 double, y1 double, x2 double, y2 double")
