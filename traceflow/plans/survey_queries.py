"""Queries of survey data in map coordinates: exports, the points of a grid and their extent; convolutions and dips of given gradients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from traceflow.operators import dips, geometry, stencil, structure
from traceflow.sources import views

from .registry import query, sql
from .section_queries import crops, horizon3d

AFFINE = (1000.0, 2000.0, 25.0, 3.0, -4.0, 12.5)
MAP = "1000.0 + 25.0 * {i} - 4.0 * {c}", "2000.0 + 3.0 * {i} + 12.5 * {c}"
X, Y = (m.format(i="x", c="y") for m in MAP)


def _stations(spark, sf_dir):
    """line, trcnr, x, y, z: the stations of the 2-D lines in map coordinates."""
    s = views.stations2d(spark, sf_dir)
    x, y = geometry.to_map(F.col("x"), F.col("y"), AFFINE)
    return s.select("line", "trcnr", x.alias("x"), y.alias("y"), "z")


@query("export_lines2d", sql("stations", f"SELECT 'line ' || line AS line_name, 'LINESTRING (' || string_agg(CAST(CAST(round({X}) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round({Y}) AS BIGINT) AS VARCHAR), ', ' ORDER BY trcnr) || ')' AS wkt FROM stations GROUP BY line HAVING count(*) > 1"))
def export_lines2d(spark, sf_dir):
    """2-D lines through their stations, in whole map units."""
    s = _stations(spark, sf_dir).withColumns({c: F.round(c).cast("long") for c in "xy"})
    return geometry.polyline_wkt(s.withColumn("line_name", F.concat(F.lit("line "), F.col("line").cast("string"))), "line_name", "trcnr", "x", "y")


@query("export_stations2d", sql("stations", f"SELECT 'line ' || line AS line_name, trcnr AS station, round({X}, 6) AS x, round({Y}, 6) AS y FROM stations"))
def export_stations2d(spark, sf_dir):
    """A point for each station."""
    return _stations(spark, sf_dir).select(F.concat(F.lit("line "), F.col("line").cast("string")).alias("line_name"), F.col("trcnr").alias("station"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("export_markers_feet", """WITH t AS (SELECT l_orderkey AS well, CAST(sum(CAST(l_quantity AS DOUBLE)) OVER w AS DOUBLE) AS md, CAST(sum(0.9 * CAST(l_quantity AS DOUBLE) - 5) OVER w AS DOUBLE) AS tvdss, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, lead(md) OVER w AS md1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(tvdss) OVER w AS v1 FROM t WINDOW w AS (PARTITION BY well ORDER BY md)),
m AS (SELECT o_orderkey AS well, o_orderpriority AS marker, CAST(10.0 + o_custkey % 100 AS DOUBLE) AS md FROM orders)
SELECT m.well, marker, m.md AS "md(ft)", round(tvdss + (m.md - s.md) / (md1 - s.md) * (v1 - tvdss), 6) AS "tvdss(ft)", round(x + (m.md - s.md) / (md1 - s.md) * (x1 - x), 6) AS x, round(y + (m.md - s.md) / (md1 - s.md) * (y1 - y), 6) AS y
FROM m LEFT JOIN (SELECT * FROM s WHERE md1 > md) s ON s.well = m.well AND m.md >= s.md AND m.md < md1""")
def export_markers_feet(spark, sf_dir):
    """Markers on their tracks with depths, under the names of a survey in feet."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("l_quantity").cast("double")
    tracks = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("well"), F.sum(q).over(w).alias("md"), F.sum(0.9 * q - 5).over(w).alias("tvdss"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"))
    markers = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("well"), F.col("o_orderpriority").alias("marker"), (10.0 + F.col("o_custkey") % 100).cast("double").alias("md"))
    got = geometry.markers_on_tracks(markers, tracks).select("well", "marker", "md", *[F.round(c, 6).alias(c) for c in ("tvdss", "x", "y")])
    return geometry.in_feet(got)


@query("zslice_lattice", sql("cube", """b AS (SELECT min(inl) AS i0, max(inl) AS i1, min(crl) AS c0, max(crl) AS c1 FROM cube), l AS (SELECT inl, crl FROM (SELECT unnest(range(i0, i1 + 1)) AS inl FROM b), (SELECT unnest(range(c0, c1 + 1)) AS crl FROM b))
SELECT l.inl, l.crl, round(a.amp, 6) AS low, round(h.amp, 6) AS high FROM l LEFT JOIN cube a ON a.inl = l.inl AND a.crl = l.crl AND a.z = 20 LEFT JOIN cube h ON h.inl = l.inl AND h.crl = l.crl AND h.z = 41"""))
def zslice_lattice(spark, sf_dir):
    """Two z slices as bands of the volume's whole lattice."""
    bands = {"low": (F.get("samples", F.lit(20)), 6), "high": (F.get("samples", F.lit(41)), 6)}
    return geometry.raster_bands(views.traces(spark, sf_dir), "inl", "crl", bands)


POINTS = f"""m AS (SELECT 'lines' AS source, CAST(line AS VARCHAR) AS key, trcnr AS n, {X} AS mx, {Y} AS my, z FROM stations UNION ALL SELECT 'contours', CAST(polygon AS VARCHAR), seq, {X}, {Y}, polygon + 0.5 FROM crops),
pts AS (SELECT source, key, n, (12.5 * (mx - 1000) + 4 * (my - 2000)) / 324.5 AS x, (25 * (my - 2000) - 3 * (mx - 1000)) / 324.5 AS y, z AS v FROM m WHERE z IS NOT NULL UNION ALL SELECT 'surface', CAST(ix AS VARCHAR), iy, CAST(ix AS DOUBLE), CAST(iy AS DOUBLE), z FROM horizon3d WHERE z IS NOT NULL)"""


def _points(spark, sf_dir):
    c = crops(spark, sf_dir)
    x, y = geometry.to_map(F.col("x"), F.col("y"), AFFINE)
    contours = c.select("polygon", "seq", x.alias("x"), y.alias("y"), (F.col("polygon") + 0.5).alias("z"))
    return geometry.scattered(_stations(spark, sf_dir), horizon3d(spark, sf_dir), contours, AFFINE)


@query("grid_points", sql("stations crops horizon3d", POINTS + " SELECT source, key, n, round(x, 6) AS x, round(y, 6) AS y, round(v, 6) AS v FROM pts"))
def grid_points(spark, sf_dir):
    """Points of lines, a surface and contours, from map coordinates to positions."""
    return _points(spark, sf_dir).select("source", "key", "n", *[F.round(c, 6).alias(c) for c in ("x", "y", "v")])


@query("grid_hull_points", sql("stations crops horizon3d", POINTS + ", e AS (SELECT source, key, unnest([arg_min({'x': x, 'y': y, 'v': v}, n), arg_max({'x': x, 'y': y, 'v': v}, n)]) AS e FROM pts GROUP BY source, key) SELECT DISTINCT source, key, round(e.x, 6) AS x, round(e.y, 6) AS y, round(e.v, 6) AS v FROM e"))
def grid_hull_points(spark, sf_dir):
    """The first and last defined points of lines, inlines and contours."""
    return geometry.hull_points(_points(spark, sf_dir)).select("source", "key", *[F.round(c, 6).alias(c) for c in ("x", "y", "v")])


@query("data_extent_union", sql("stations horizon3d", "e AS (SELECT x, y FROM stations UNION ALL SELECT CAST(ix AS DOUBLE), CAST(iy AS DOUBLE) FROM horizon3d) SELECT CAST(floor(min(x)) AS BIGINT) AS x0, CAST(ceil(max(x)) AS BIGINT) AS x1, CAST(floor(min(y)) AS BIGINT) AS y0, CAST(ceil(max(y)) AS BIGINT) AS y1 FROM e"))
def data_extent_union(spark, sf_dir):
    """The extent of lines and volume together."""
    return geometry.extent((views.stations2d(spark, sf_dir), "x", "y"), (horizon3d(spark, sf_dir), "ix", "iy"))


# weights that differ at every place: (di + 2 dj + 3 dz + 7) / 50
@query("block_convolution", sql("cube", """o AS (SELECT i, j, k, CAST(i + 2 * j + 3 * k + 7 AS DOUBLE) / 50 AS w FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)),
p AS (SELECT c.vec_id, c.z, ij.i, ij.j, coalesce(n.amp, c.amp) AS amp FROM cube c CROSS JOIN (SELECT DISTINCT i, j FROM o) ij LEFT JOIN cube n ON n.inl = c.inl - ij.i AND n.crl = c.crl - ij.j AND n.z = c.z)
SELECT c.vec_id, c.z, CASE WHEN c.z IN (0, 63) THEN 0 ELSE round(sum(o.w * p.amp), 6) END AS value FROM cube c CROSS JOIN o LEFT JOIN p ON p.vec_id = c.vec_id AND p.z = c.z - o.k AND p.i = o.i AND p.j = o.j GROUP BY c.vec_id, c.z"""))
def block_convolution(spark, sf_dir):
    i, j, k = np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij")
    w = (i + 2 * j + 3 * k + 7) / 50
    got = stencil.map_tiles(views.traces(spark, sf_dir), lambda t: {"value": structure.block_convolution(t, w)}, ["value"], 1)
    return views.samples(got, "value").select("vec_id", "z", F.round("value", 6).alias("value"))


@query("dips_of_gradients", sql("stacks", "d AS (SELECT vec_id, z, -s2 / nullif(s3, 0) * 0.8 AS c, -s1 / nullif(s3, 0) * 0.5 AS i FROM stacks) SELECT vec_id, z, round(c, 4) AS crl_dip, round(i, 4) AS inl_dip, round(sqrt(c * c + i * i), 4) AS true_dip, round(degrees(atan2(i, c)), 4) AS azimuth FROM d"))
def dips_of_gradients(spark, sf_dir):
    """Dips of gradients that are given, with factors for both directions."""
    from traceflow.operators import spectral

    out = ["crl_dip", "inl_dip", "true_dip", "azimuth"]
    got = spectral.map_traces(views.stacks(spark, sf_dir), lambda x, y, z: dips.dips(x, y, z, 0.5, 0.8), ["s1", "s2", "s3"], out, ["vec_id"])
    return views.samples(got, *out).select("vec_id", "z", *[F.round(o, 4).alias(o) for o in out])
