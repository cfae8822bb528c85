"""Queries of masks, scopes, fault polygons and draped profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.operators import draping, polygons
from traceflow.sources import views

from .map_queries import CELLS
from .registry import VIEWS_SQL, query, sql

VIEWS_SQL |= {
    "rings": "rings AS (SELECT s_suppkey AS fault, seq, 5 + (s_suppkey * 37 % 80) + (2.5 + s_suppkey % 3) * cos(radians(seq * 51.5)) AS x, 5 + (s_suppkey * 53 % 75) + (2.5 + s_suppkey % 4) * sin(radians(seq * 51.5)) AS y, s_suppkey % 3 <> 0 AS closed FROM supplier, (SELECT unnest(range(7)) AS seq))",
    "crops": "crops AS (SELECT n_nationkey AS polygon, seq, CAST(10 + (n_nationkey * 29 % 60) + CASE WHEN seq IN (1, 2) THEN 20 ELSE 0 END AS DOUBLE) AS x, CAST(8 + (n_nationkey * 41 % 55) + CASE WHEN seq IN (2, 3) THEN 15 ELSE 0 END AS DOUBLE) AS y FROM nation, (SELECT unnest(range(4)) AS seq))",
    "wedge": "wedge AS (SELECT id, x, y * (x + 10) / 110 AS y, v FROM points)",
    "horizon3d": "horizon3d AS (SELECT vec_id // 25 AS ix, vec_id % 25 AS iy, CASE WHEN vec_id % 17 <> 3 THEN 10 * CAST(embedding[1] AS DOUBLE) END AS z FROM embeddings)",
    "sticks": "sticks AS (SELECT p_partkey // 40 AS fault, p_partkey // 8 % 5 AS stick, p_partkey % 8 AS seq, p_partkey // 8 * 37 % 19 + 0.3 + 0.31 * (p_partkey % 8) AS x, p_partkey // 8 * 53 % 23 + 0.4 + 0.17 * (p_partkey % 8) AS y, -12 + 3.1 * (p_partkey % 8) + 0.01 * (p_partkey % 13) AS z FROM part)",
}


def rings(spark, sf_dir):
    """fault, seq, x, y, closed: a seven-sided fault polygon for each supplier; two of three are closed."""
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq"))
    angle = F.radians(F.col("seq") * 51.5)
    return s.select(k.alias("fault"), "seq", (5 + (k * 37 % 80) + (2.5 + k % 3) * F.cos(angle)).alias("x"), (5 + (k * 53 % 75) + (2.5 + k % 4) * F.sin(angle)).alias("y"), (k % 3 != 0).alias("closed"))


def crops(spark, sf_dir):
    """polygon, seq, x, y: a rectangle for each nation."""
    k = F.col("n_nationkey")
    s = views.table(spark, sf_dir, "nation").select(k, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    x, y = F.when(F.col("seq").isin(1, 2), 20).otherwise(0), F.when(F.col("seq").isin(2, 3), 15).otherwise(0)
    return s.select(k.alias("polygon"), "seq", (10 + (k * 29 % 60) + x).cast("double").alias("x"), (8 + (k * 41 % 55) + y).cast("double").alias("y"))


def wedge(spark, sf_dir):
    """The points, the nearer to x = 0 the flatter."""
    return views.points(spark, sf_dir).withColumn("y", F.col("y") * (F.col("x") + 10) / 110)


def horizon3d(spark, sf_dir):
    t = views.traces(spark, sf_dir)
    return t.select(F.col("inl").alias("ix"), F.col("crl").alias("iy"), F.when(F.col("vec_id") % 17 != 3, 10 * F.get("samples", F.lit(0))).alias("z"))


def sticks(spark, sf_dir):
    k = F.col("p_partkey")
    of = F.floor(k / 8).cast("long")
    return views.table(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("fault"), (of % 5).alias("stick"), (k % 8).alias("seq"), (of * 37 % 19 + 0.3 + 0.31 * (k % 8)).alias("x"), (of * 53 % 23 + 0.4 + 0.17 * (k % 8)).alias("y"), (-12 + 3.1 * (k % 8) + 0.01 * (k % 13)).alias("z"))


RING = "{t}_edges AS (SELECT {k} AS polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY seq))"
ODD = "(SELECT count(*) FROM {e} e WHERE e.polygon = {p} AND c.iy >= least(y1, y2) AND c.iy < greatest(y1, y2) AND (c.ix - x1) < (c.iy - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1"
ON = "EXISTS (SELECT 1 FROM {e} e WHERE e.polygon = {p} AND abs((x2 - x1) * (c.iy - y1) - (y2 - y1) * (c.ix - x1)) < 1e-9 AND c.ix BETWEEN least(x1, x2) AND greatest(x1, x2) AND c.iy BETWEEN least(y1, y2) AND greatest(y1, y2))"


def _inside(edges, polygons_, border):
    return f"(SELECT DISTINCT c.ix, c.iy FROM cells c, {polygons_} p WHERE " + (f"({ODD} OR {ON})" if border else f"{ODD} AND NOT {ON}").format(e=edges, p="p.polygon") + ")"


@query("mask_crop", sql("points crops", f"{CELLS}, {RING.format(t='crops', k='polygon')} SELECT ix, iy FROM " + _inside("crops_edges", "(SELECT DISTINCT polygon FROM crops)", True)))
def mask_crop(spark, sf_dir):
    """Nodes in or on any of the crop rectangles."""
    points = views.points(spark, sf_dir)
    return polygons.masked(polygons.scope_lattice(points, "box"), crop=crops(spark, sf_dir)).select("ix", "iy")


@query("mask_faults", sql("points rings", f"{CELLS}, {RING.format(t='rings', k='fault')} SELECT ix, iy FROM cells EXCEPT SELECT ix, iy FROM " + _inside("rings_edges", "(SELECT DISTINCT fault AS polygon FROM rings WHERE closed)", False)))
def mask_faults(spark, sf_dir):
    """Nodes that aren't within a closed fault polygon."""
    return polygons.masked(polygons.scope_lattice(views.points(spark, sf_dir), "box"), faults=rings(spark, sf_dir)).select("ix", "iy")


# a node is in the hull if it lies between the highest and the lowest chord between two columns' extremes
HULL = CELLS.replace("FROM points", "FROM wedge") + """, e AS (SELECT x, min(y) AS lo, max(y) AS hi FROM wedge GROUP BY x),
chords AS (SELECT c.ix, max(CASE WHEN a.x = b.x THEN a.hi ELSE a.hi + (b.hi - a.hi) * (c.ix - a.x) / (b.x - a.x) END) AS hi, min(CASE WHEN a.x = b.x THEN a.lo ELSE a.lo + (b.lo - a.lo) * (c.ix - a.x) / (b.x - a.x) END) AS lo
 FROM (SELECT DISTINCT ix FROM cells) c JOIN e a ON a.x <= c.ix JOIN e b ON b.x >= c.ix GROUP BY c.ix),
hulled AS (SELECT c.ix, c.iy FROM cells c JOIN chords h ON h.ix = c.ix WHERE c.iy BETWEEN h.lo - 1e-9 AND h.hi + 1e-9)"""


@query("mask_hull", sql("points wedge", HULL + " SELECT ix, iy FROM hulled"))
def mask_hull(spark, sf_dir):
    """Nodes in or on the convex hull of the points."""
    from traceflow.operators import geometry

    points = wedge(spark, sf_dir)
    return polygons.masked(polygons.scope_lattice(points, "hull"), hull=geometry.convex_hull(points)).select("ix", "iy")


IDW5 = "q AS (SELECT c.ix, c.iy, p.v, (c.ix - p.x) * (c.ix - p.x) + (c.iy - p.y) * (c.iy - p.y) AS d2 FROM n c JOIN {p} p ON (c.ix - p.x) * (c.ix - p.x) + (c.iy - p.y) * (c.iy - p.y) <= 25), g AS (SELECT ix, iy, sum(v / (d2 + 0.001)) / sum(1 / (d2 + 0.001)) AS v FROM q GROUP BY ix, iy) SELECT n.ix, n.iy, round(g.v, 6) AS v FROM n LEFT JOIN g ON g.ix = n.ix AND g.iy = n.iy"


@query("grid_scope_hull", sql("points wedge rings", HULL + f", {RING.format(t='rings', k='fault')}, n AS (SELECT ix, iy FROM hulled EXCEPT SELECT ix, iy FROM " + _inside("rings_edges", "(SELECT DISTINCT fault AS polygon FROM rings WHERE closed)", False) + "), " + IDW5.format(p="wedge")))
def grid_scope_hull(spark, sf_dir):
    """Inverse distance over the hull's nodes outside closed faults."""
    g = polygons.grid(wedge(spark, sf_dir), "idw", "hull", faults=rings(spark, sf_dir), radius=5.0, most=None)
    return g.select("ix", "iy", F.round("v", 6).alias("v"))


@query("grid_scope_horizon", sql("points horizon3d", "b AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM horizon3d), n AS (SELECT ix, iy FROM (SELECT unnest(range(x0, x1 + 1, 2)) AS ix FROM b), (SELECT unnest(range(y0, y1 + 1, 2)) AS iy FROM b)), " + IDW5.format(p="points")))
def grid_scope_horizon(spark, sf_dir):
    """Inverse distance over every second node of a horizon's ranges."""
    g = polygons.grid(views.points(spark, sf_dir), "idw", "horizon", step=2, horizon=horizon3d(spark, sf_dir), radius=5.0, most=None)
    return g.select("ix", "iy", F.round("v", 6).alias("v"))


@query("grid_scope_range", sql("points", "n AS (SELECT ix, iy FROM (SELECT unnest(range(-3, 101, 3)) AS ix), (SELECT unnest(range(0, 90, 3)) AS iy)), " + IDW5.format(p="points")))
def grid_scope_range(spark, sf_dir):
    """Inverse distance over given ranges."""
    g = polygons.grid(views.points(spark, sf_dir), "idw", "range", step=3, ranges=(-3, 100, 0, 89), radius=5.0, most=None)
    return g.select("ix", "iy", F.round("v", 6).alias("v"))


# one triangle a row: corners a, b, c; the segment meets it where the signed volumes agree
PIERCE = """seg AS (SELECT * FROM (SELECT fault, stick, seq, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM sticks WINDOW w AS (PARTITION BY fault, stick ORDER BY seq)) WHERE x2 IS NOT NULL),
tri AS (SELECT h.ix AS r, h.iy AS c, h.z AS z00, a.z AS z01, b.z AS z11, d.z AS z10 FROM horizon3d h LEFT JOIN horizon3d a ON a.ix = h.ix AND a.iy = h.iy + 1 LEFT JOIN horizon3d b ON b.ix = h.ix + 1 AND b.iy = h.iy + 1 LEFT JOIN horizon3d d ON d.ix = h.ix + 1 AND d.iy = h.iy WHERE h.z IS NOT NULL),
faces AS (SELECT r, c, 0 AS k, z01 - z00 AS gy, z11 - z01 AS gx, z00 FROM tri UNION ALL SELECT r, c, 1, z11 - z10, z10 - z00, z00 FROM tri),
hits AS (SELECT s.*, r, c, k, (z00 + gx * (x - r) + gy * (y - c) - z) / nullif((z2 - z) - gx * (x2 - x) - gy * (y2 - y), 0) AS t
 FROM seg s JOIN faces f ON r BETWEEN least(floor(x + 0.5), floor(x2 + 0.5)) - 1 AND greatest(floor(x + 0.5), floor(x2 + 0.5)) + 1 AND c BETWEEN least(floor(y + 0.5), floor(y2 + 0.5)) - 1 AND greatest(floor(y + 0.5), floor(y2 + 0.5)) + 1),
there AS (SELECT *, x + t * (x2 - x) - r AS u, y + t * (y2 - y) - c AS v FROM hits WHERE t BETWEEN -1e-12 AND 1 + 1e-12),
ok AS (SELECT * FROM there WHERE u BETWEEN -1e-12 AND 1 + 1e-12 AND v BETWEEN -1e-12 AND 1 + 1e-12 AND ((k = 0 AND v >= u - 1e-12) OR (k = 1 AND u >= v - 1e-12))),
best AS (SELECT fault, stick, seq, x + t * (x2 - x) AS x, y + t * (y2 - y) AS y, z + t * (z2 - z) AS z FROM ok QUALIFY row_number() OVER (PARTITION BY fault, stick, seq ORDER BY r, c, k) = 1),
walk AS (SELECT *, 0 AS n, stick AS a, seq AS b FROM best UNION ALL SELECT *, 1, -stick, -seq FROM best)
SELECT fault, row_number() OVER (PARTITION BY fault ORDER BY n, a, b) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM walk"""


@query("fault_polygons", sql("horizon3d sticks", PIERCE))
def fault_polygons(spark, sf_dir):
    """Where fault sticks pierce a horizon, there and back."""
    got = draping.fault_polygons(sticks(spark, sf_dir), horizon3d(spark, sf_dir))
    return got.select("fault", "seq", *[F.round(c, 6).alias(c) for c in "xyz"])


LINES = """legs AS (SELECT * FROM (SELECT line, trcnr, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM stations WINDOW w AS (PARTITION BY line ORDER BY trcnr)) WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)),
cuts AS (SELECT line, trcnr, x1, y1, x2, y2, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS t FROM legs
 UNION SELECT line, trcnr, x1, y1, x2, y2, round((k - x1) / (x2 - x1), 12) FROM (SELECT *, unnest(range(CAST(ceil(least(x1, x2)) AS BIGINT), CAST(floor(greatest(x1, x2)) AS BIGINT) + 1)) AS k FROM legs WHERE x1 <> x2)
 UNION SELECT line, trcnr, x1, y1, x2, y2, round((k - y1) / (y2 - y1), 12) FROM (SELECT *, unnest(range(CAST(ceil(least(y1, y2)) AS BIGINT), CAST(floor(greatest(y1, y2)) AS BIGINT) + 1)) AS k FROM legs WHERE y1 <> y2)),
pts AS (SELECT line, trcnr, row_number() OVER (PARTITION BY line, trcnr ORDER BY t) - 1 AS n, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM cuts)"""


@query("grid_line_points", sql("stations", LINES + " SELECT line, trcnr, n, round(x, 6) AS x, round(y, 6) AS y FROM pts"))
def grid_line_points(spark, sf_dir):
    """The legs of the 2-D lines, cut at the grid's lines."""
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("trcnr")
    s = views.stations2d(spark, sf_dir).select("line", "trcnr", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return draping.grid_line(s, ["line", "trcnr"]).select("line", "trcnr", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


DRAPE = LINES + """, cell AS (SELECT *, CAST(floor(round(x, 9)) AS BIGINT) AS r, CAST(floor(round(y, 9)) AS BIGINT) AS c FROM pts),
val AS (SELECT p.line, p.trcnr, p.n, p.x, p.y, (1 - (p.x - r)) * ((1 - (p.y - c)) * a.z + (p.y - c) * b.z) + (p.x - r) * ((1 - (p.y - c)) * d.z + (p.y - c) * e.z) AS z
 FROM cell p LEFT JOIN horizon3d a ON a.ix = r AND a.iy = c LEFT JOIN horizon3d b ON b.ix = r AND b.iy = c + 1 LEFT JOIN horizon3d d ON d.ix = r + 1 AND d.iy = c LEFT JOIN horizon3d e ON e.ix = r + 1 AND e.iy = c + 1),
gaps AS (SELECT *, sum(CASE WHEN z IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY trcnr, n) AS gap FROM val)
SELECT line AS path, dense_rank() OVER (PARTITION BY line ORDER BY gap) - 1 AS part, row_number() OVER (PARTITION BY line, gap ORDER BY trcnr, n) - 1 AS n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM gaps WHERE z IS NOT NULL"""


@query("horizon_profiles", sql("stations horizon3d", DRAPE))
def horizon_profiles(spark, sf_dir):
    """The 2-D lines draped over the horizon, cut where it is undefined."""
    paths = views.stations2d(spark, sf_dir).select(F.col("line").alias("path"), F.col("trcnr").alias("seq"), "x", "y")
    got = draping.profiles(paths, horizon3d(spark, sf_dir))
    return got.select("path", "part", "n", *[F.round(c, 6).alias(c) for c in "xyz"])
