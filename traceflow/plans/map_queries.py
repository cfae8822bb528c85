"""Gridding, geometry and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.functions import arrays, encoding
from traceflow.operators import geometry, gridding, surfaces
from traceflow.sources import views

from .registry import query, sql

EDGES = views.FAULTS
CELLS = "bx AS (SELECT CAST(floor(min(x)) AS BIGINT) AS x0, CAST(ceil(max(x)) AS BIGINT) AS x1, CAST(floor(min(y)) AS BIGINT) AS y0, CAST(ceil(max(y)) AS BIGINT) AS y1 FROM points), cells AS (SELECT ix, iy FROM (SELECT unnest(range(x0, x1 + 1)) AS ix FROM bx), (SELECT unnest(range(y0, y1 + 1)) AS iy FROM bx))"
CROSS = """NOT EXISTS (SELECT 1 FROM faults f WHERE abs((f.y2 - f.y1) * ({bx} - {ax}) - (f.x2 - f.x1) * ({by} - {ay})) > 1e-12
 AND ((f.x2 - f.x1) * ({ay} - f.y1) - (f.y2 - f.y1) * ({ax} - f.x1)) / nullif((f.y2 - f.y1) * ({bx} - {ax}) - (f.x2 - f.x1) * ({by} - {ay}), 0) BETWEEN 0 AND 1
 AND (({bx} - {ax}) * ({ay} - f.y1) - ({by} - {ay}) * ({ax} - f.x1)) / nullif((f.y2 - f.y1) * ({bx} - {ax}) - (f.x2 - f.x1) * ({by} - {ay}), 0) BETWEEN 0 AND 1)"""
SIGHT = CROSS.format(ax="c.ix", ay="c.iy", bx="p.x", by="p.y")


def _cells(spark, sf_dir):
    """Every node of the points' lattice."""
    return gridding.lattice(views.points(spark, sf_dir), 1)


def _v(df):
    return df.select("ix", "iy", F.round("v", 6).alias("v"))


@query("grid_lattice", sql("points", "b AS (SELECT CAST(floor(min(x) / 4) * 4 AS BIGINT) AS x0, CAST(ceil(max(x) / 4) * 4 AS BIGINT) AS x1, CAST(floor(min(y) / 4) * 4 AS BIGINT) AS y0, CAST(ceil(max(y) / 4) * 4 AS BIGINT) AS y1 FROM points), r AS (SELECT unnest(range(x0, x1 + 1, 4)) AS ix, y0, y1 FROM b) SELECT ix, unnest(range(y0, y1 + 1, 4)) AS iy FROM r"))
def grid_lattice(spark, sf_dir):
    return gridding.lattice(views.points(spark, sf_dir), 4)


POLYGON = [(5.5, 4.5), (80.5, 10.5), (70.5, 80.5), (20.5, 60.5)]
_TESTS = " + ".join(f"CASE WHEN iy >= {min(y1, y2)} AND iy < {max(y1, y2)} AND ix < (iy - {y1}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))


@query("grid_mask", sql("points", f"{CELLS} SELECT ix, iy FROM cells WHERE ({_TESTS}) % 2 = 1"))
def grid_mask(spark, sf_dir):
    return _cells(spark, sf_dir).where(gridding.inside(F.col("ix"), F.col("iy"), POLYGON))


HALF = "h AS (SELECT id, x + (id % 3) * 0.25 AS x, y + (id % 2) * 0.5 AS y, v FROM points)"
SPLAT = HALF + """, n AS (SELECT h.*, CAST(floor(x) + i AS BIGINT) AS ix, CAST(floor(y) + j AS BIGINT) AS iy FROM h, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
d AS (SELECT *, (x - ix) * (x - ix) + (y - iy) * (y - iy) AS d2 FROM n),
s AS (SELECT c.*, CASE WHEN d2 = 0 THEN 1 ELSE tanh(d2) / d2 END AS w FROM d c WHERE (d2 = 0 OR NOT (x = floor(x) AND y = floor(y))) AND """ + CROSS.format(ax="c.x", ay="c.y", bx="c.ix", by="c.iy") + """),
g AS (SELECT ix, iy, sum(w * v) / sum(w) AS v FROM s GROUP BY ix, iy)"""


def _shifted(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return p.select("id", (F.col("x") + (F.col("id") % 3) * 0.25).alias("x"), (F.col("y") + (F.col("id") % 2) * 0.5).alias("y"), "v")


@query("grid_splat", sql("points faults", SPLAT + " SELECT ix, iy, round(v, 6) AS v FROM g"))
def grid_splat(spark, sf_dir):
    return _v(gridding.splat(_shifted(spark, sf_dir), EDGES))


@query("grid_nrn", sql("points faults", SPLAT + f", {CELLS} SELECT c.ix, c.iy, round(v, 6) AS v FROM cells c LEFT JOIN g ON g.ix = c.ix AND g.iy = c.iy"))
def grid_nrn(spark, sf_dir):
    return _v(_cells(spark, sf_dir).join(gridding.splat(_shifted(spark, sf_dir), EDGES), ["ix", "iy"], "left"))


PAIRS = f"{CELLS}, q AS (SELECT c.ix, c.iy, p.*, (c.ix - p.x) * (c.ix - p.x) + (c.iy - p.y) * (c.iy - p.y) AS d2 FROM cells c JOIN points p ON (c.ix - p.x) * (c.ix - p.x) + (c.iy - p.y) * (c.iy - p.y) <= 36 WHERE {SIGHT})"
IDW = "SELECT ix, iy, round(sum(v / (d2 + 0.001)) / sum(1 / (d2 + 0.001)), 6) AS v FROM q GROUP BY ix, iy"


@query("idw_local", sql("points faults", PAIRS + " " + IDW))
def idw_local(spark, sf_dir):
    return _v(gridding.idw_local(_cells(spark, sf_dir), views.points(spark, sf_dir), EDGES, 6.0))


@query("idw_knn", sql("points faults", PAIRS + ", k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d2, id) AS n FROM q) " + IDW.replace("FROM q", "FROM k WHERE n <= 5")))
def idw_knn(spark, sf_dir):
    return _v(gridding.idw_local(_cells(spark, sf_dir), views.points(spark, sf_dir), EDGES, 6.0, 5))


@query("idw_local_joined", sql("points faults", PAIRS + " " + IDW))
def idw_local_joined(spark, sf_dir):
    """idw_local with the fault edges as a table."""
    return _v(gridding.idw_local(_cells(spark, sf_dir), views.points(spark, sf_dir), gridding.edge_table(spark, EDGES), 6.0))


@query("idw_nearest", sql("points faults", CELLS + ", d AS (SELECT c.ix, c.iy, p.*, (c.ix - p.x) * (c.ix - p.x) + (c.iy - p.y) * (c.iy - p.y) AS d2 FROM cells c, points p), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY d2, id) <= 8), q AS (SELECT * FROM k c WHERE " + CROSS.format(ax="c.ix", ay="c.iy", bx="c.x", by="c.y") + ") " + IDW))
def idw_nearest(spark, sf_dir):
    return _v(gridding.idw_nearest(_cells(spark, sf_dir), views.points(spark, sf_dir), EDGES, 8, 4.0))


@query("ltps_sectors", sql("points faults", PAIRS + """, s AS (SELECT *, least(CAST(floor((degrees(atan2(y - iy, x - ix)) + 180) / 45) AS INTEGER), 7) AS sector FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, sector ORDER BY d2, id) AS n FROM s), m AS (SELECT * FROM k WHERE n <= 4),
o AS (SELECT ix, iy FROM m GROUP BY ix, iy HAVING count(DISTINCT sector) >= 5)
SELECT m.ix, m.iy, sector, id FROM m JOIN o ON o.ix = m.ix AND o.iy = m.iy"""))
def ltps_sectors(spark, sf_dir):
    return gridding.sectors(_cells(spark, sf_dir), views.points(spark, sf_dir), EDGES, 6.0).select("ix", "iy", "sector", "id")


@query("grid_mba")
def grid_mba(spark, sf_dir):
    """A plane and up to ten levels of B-splines at every node; nodes that points reach at once keep the spread value."""
    points, cells = _shifted(spark, sf_dir), _cells(spark, sf_dir)
    near = gridding.splat(points, EDGES).withColumnRenamed("v", "own")
    surface, _ = surfaces.multilevel(cells, points, 10, linear=True, tol=1e-8)
    return _v(surface.join(near, ["ix", "iy"], "left").withColumn("v", F.coalesce("own", "v")))


@query("grid_ltps")
def grid_ltps(spark, sf_dir):
    return _v(surfaces.thin_plate(_cells(spark, sf_dir), views.points(spark, sf_dir), EDGES, 6.0, linear=True, tol=1e-8))


@query("hull_seeds", sql("horizon2d", "SELECT line, min(trcnr) AS first_trc, arg_min(z, trcnr) AS first_z, max(trcnr) AS last_trc, arg_max(z, trcnr) AS last_z FROM horizon2d WHERE z IS NOT NULL GROUP BY line"))
def hull_seeds(spark, sf_dir):
    return geometry.line_ends(views.horizon2d(spark, sf_dir))


@query("convex_hull")
def convex_hull(spark, sf_dir):
    return geometry.convex_hull(views.points(spark, sf_dir))


@query("line_bbox", sql("horizon2d", "SELECT line, min(trcnr) AS trc0, max(trcnr) AS trc1, min(z) AS z0, max(z) AS z1 FROM horizon2d GROUP BY line"))
def line_bbox(spark, sf_dir):
    return views.horizon2d(spark, sf_dir).groupBy("line").agg(F.min("trcnr").alias("trc0"), F.max("trcnr").alias("trc1"), F.min("z").alias("z0"), F.max("z").alias("z1"))


@query("range_snap", sql("horizon2d", "SELECT line, CAST(floor(min(trcnr) / 8) * 8 AS BIGINT) AS trc0, CAST(ceil(max(trcnr) / 8) * 8 AS BIGINT) AS trc1 FROM horizon2d GROUP BY line"))
def range_snap(spark, sf_dir):
    b = line_bbox(spark, sf_dir)
    lo, hi = geometry.snapped_range(F.col("trc0"), F.col("trc1"), 8)
    return b.select("line", lo.alias("trc0"), hi.alias("trc1"))


SEG = "g AS (SELECT line, trcnr, CAST(trcnr AS DOUBLE) AS x1, z AS y1, CAST(trcnr + 1 AS DOUBLE) AS x2, lead(z) OVER (PARTITION BY line ORDER BY trcnr) AS y2 FROM horizon2d)"


def _segments(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("trcnr")
    return views.horizon2d(spark, sf_dir).select("line", "trcnr", F.col("trcnr").cast("double").alias("x1"), F.col("z").alias("y1"), (F.col("trcnr") + 1).cast("double").alias("x2"), F.lead("z").over(w).alias("y2")).where("y2 is not null")


@query("segment_intersections", sql("horizon2d faults", SEG + " SELECT line, trcnr FROM g c WHERE y2 IS NOT NULL AND NOT " + CROSS.format(ax="c.x1", ay="c.y1", bx="c.x2", by="c.y2")))
def segment_intersections(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.where(~gridding.in_sight(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), EDGES)).select("line", "trcnr")


@query("clip_to_rect", sql("horizon2d", SEG + """, c AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM g WHERE y2 IS NOT NULL),
t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (10 - x1) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (100 - y1) / dy WHEN dy < 0 THEN (300 - y1) / dy ELSE 0 END) AS lo, least(1, CASE WHEN dx > 0 THEN (40 - x1) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (300 - y1) / dy WHEN dy < 0 THEN (100 - y1) / dy ELSE 1 END) AS hi FROM c WHERE NOT (dy = 0 AND (y1 < 100 OR y1 > 300)))
SELECT line, trcnr, round(x1 + lo * dx, 6) AS x1, round(y1 + lo * dy, 6) AS y1, round(x1 + hi * dx, 6) AS x2, round(y1 + hi * dy, 6) AS y2 FROM t WHERE lo <= hi"""))
def clip_to_rect(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("c", geometry.clip(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], (10.0, 100.0, 40.0, 300.0))).where("c is not null")
    return s.select("line", "trcnr", *[F.round(f"c.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("export_lines_wkt", sql("horizon2d", "SELECT line, 'LINESTRING (' || string_agg(trcnr || ' ' || CAST(CAST(round(z) AS BIGINT) AS VARCHAR), ', ' ORDER BY trcnr) || ')' AS wkt FROM horizon2d GROUP BY line HAVING count(*) > 1"))
def export_lines_wkt(spark, sf_dir):
    return geometry.polyline_wkt(views.horizon2d(spark, sf_dir).withColumn("zi", F.round("z").cast("long")), "line", "trcnr", "trcnr", "zi")


@query("export_stations", sql("horizon2d", "SELECT line, trcnr, 'POINT (' || line || ' ' || trcnr || ')' AS wkt FROM horizon2d"))
def export_stations(spark, sf_dir):
    return views.horizon2d(spark, sf_dir).select("line", "trcnr", F.concat(F.lit("POINT ("), F.col("line").cast("string"), F.lit(" "), F.col("trcnr").cast("string"), F.lit(")")).alias("wkt"))


@query("export_markers_interval", """WITH t AS (SELECT l_orderkey AS well, CAST(sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS md, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y FROM lineitem),
s AS (SELECT well, md AS md0, x, y, lead(md) OVER w AS md1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM t WINDOW w AS (PARTITION BY well ORDER BY md)),
m AS (SELECT o_orderkey AS well, o_orderpriority AS marker, 10.0 + o_custkey % 100 AS md FROM orders)
SELECT m.well, marker, CAST(m.md AS DOUBLE) AS md, round(x + (m.md - md0) / (md1 - md0) * (x1 - x), 6) AS x, round(y + (m.md - md0) / (md1 - md0) * (y1 - y), 6) AS y
FROM m LEFT JOIN (SELECT * FROM s WHERE md1 > md0) s ON s.well = m.well AND m.md >= md0 AND m.md < md1""")
def export_markers_interval(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    tracks = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("well"), F.sum(F.col("l_quantity").cast("double")).over(w).alias("md"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"))
    markers = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("well"), F.col("o_orderpriority").alias("marker"), (10.0 + F.col("o_custkey") % 100).alias("md"))
    got = geometry.markers_on_tracks(markers, tracks)
    return got.select("well", "marker", "md", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("zslice_pivot", sql("cube", "SELECT inl, " + ", ".join(f"round(max(CASE WHEN crl = {c} THEN amp END), 6) AS c{c}" for c in range(25)) + " FROM cube WHERE z = 20 GROUP BY inl"))
def zslice_pivot(spark, sf_dir):
    t = views.traces(spark, sf_dir).select("inl", F.concat(F.lit("c"), F.col("crl").cast("string")).alias("c"), F.round(F.get("samples", F.lit(20)), 6).alias("amp"))
    return t.groupBy("inl").pivot("c", [f"c{i}" for i in range(25)]).agg(F.max("amp"))


GEO = [("x_across", "2 + s_suppkey % 4"), ("x_down", "25 + s_suppkey % 7"), ("x_origin", "ox - (27 + s_suppkey % 7 + s_suppkey % 4) / 2.0"), ("y_across", "12.5 + s_suppkey % 3"), ("y_down", "s_suppkey % 5"), ("y_origin", "oy - (12.5 + s_suppkey % 3 + s_suppkey % 5) / 2.0")]


@query("geotransform", "WITH o AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS ox, 2 * CAST(s_acctbal AS DOUBLE) AS oy FROM supplier) SELECT s_suppkey AS survey, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in GEO) + " FROM o")
def geotransform(spark, sf_dir):
    """The six affine numbers of a raster for each supplier's survey, from its origin and its steps."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    g = geometry.geotransform(b, 2 * b, (25 + k % 7).cast("double"), (k % 5).cast("double"), (2 + k % 4).cast("double"), 12.5 + k % 3)
    return views.table(spark, sf_dir, "supplier").select(k.alias("survey"), *[F.round(F.get(g, F.lit(i)), 6).alias(n) for i, (n, _) in enumerate(GEO)])


@query("points_wkb")
def points_wkb(spark, sf_dir):
    """Points as well-known binary, in hexadecimal digits."""
    return views.points(spark, sf_dir).select("id", F.hex(encoding.wkb_point(F.col("x"), F.col("y"))).alias("wkb"))


@query("lines_wkb")
def lines_wkb(spark, sf_dir):
    """2-D lines as well-known binary, in hexadecimal digits."""
    s = views.stations2d(spark, sf_dir).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("trcnr", "x", "y"))).alias("p"))
    return s.select("line", F.hex(encoding.wkb_linestring(F.col("p.x"), F.col("p.y"))).alias("wkb"))


@query("percent_encode", "SELECT event_id, array_to_string(list_transform(string_split(props, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9]$') THEN c WHEN c = chr(92) THEN '%5C%5C' ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS code FROM events WHERE props IS NOT NULL")
def percent_encode(spark, sf_dir):
    return views.table(spark, sf_dir, "events").where("props is not null").select("event_id", encoding.percent_encode(F.col("props")).alias("code"))


@query("percent_decode", "SELECT event_id, props AS text FROM events WHERE props IS NOT NULL AND NOT contains(props, chr(92))")
def percent_decode(spark, sf_dir):
    """Coding and back; texts with a backslash, which coding doubles, are left out."""
    t = views.table(spark, sf_dir, "events").where("props is not null").where(~F.contains("props", F.lit("\\")))
    return t.select("event_id", encoding.percent_decode(encoding.percent_encode(F.col("props"))).alias("text"))


@query("json_params", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_params(spark, sf_dir):
    return views.table(spark, sf_dir, "events").where("props is not null").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("frequency_index", sql("cube", """e AS (SELECT vec_id, z, x, b, f, x * x - CASE WHEN z IN (0, 63) THEN 0 ELSE lag(x) OVER w * lead(x) OVER w END AS t, b * b - CASE WHEN z IN (0, 63) THEN 0 ELSE lag(b) OVER w * lead(b) OVER w END AS tb, f * f - CASE WHEN z IN (0, 63) THEN 0 ELSE lag(f) OVER w * lead(f) OVER w END AS tf
 FROM (SELECT vec_id, z, amp AS x, CASE WHEN z = 0 THEN amp ELSE amp - lag(amp) OVER w END AS b, CASE WHEN z = 63 THEN amp ELSE lead(amp) OVER w - amp END AS f FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z)) WINDOW w AS (PARTITION BY vec_id ORDER BY z)),
c AS (SELECT vec_id, z, 1 - (tb + tf) / (4 * nullif(t, 0)) AS c FROM e),
k AS (SELECT vec_id, z, CAST(floor(acos(c) / (2 * pi() * 0.004) / 15 + 0.5) AS BIGINT) AS k FROM c WHERE abs(c) <= 1)
SELECT vec_id, z, least(greatest(k, 1), 8) - 1 AS idx, 15 * least(greatest(k, 1), 8) AS snapped FROM k"""))
def frequency_index(spark, sf_dir):
    """Of a spectrum's eight components, 15 Hz apart, the one nearest to each sample's instantaneous frequency, and that component's frequency."""
    t = views.traces(spark, sf_dir).withColumn("f", arrays.desa(F.col("samples"), 0.004)["frequency"])
    s = views.samples(t, "f").where("f is not null")
    k = F.least(F.greatest(F.floor(F.col("f") / 15 + 0.5).cast("long"), F.lit(1)), F.lit(8))
    return s.select("vec_id", "z", (k - 1).alias("idx"), (15 * k).alias("snapped"))

