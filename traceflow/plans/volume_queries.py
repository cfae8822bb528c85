"""Queries that read parts of volumes, the attribute declarations, dips and curvature, and export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.functions import arrays as A
from traceflow.operators import attributes, geometry, structure, volumes
from traceflow.sources import views

from .registry import query, sql


def _out(df, *outputs, digits=6):
    return views.samples(df, *outputs).select("vec_id", "z", *[F.round(o, digits).alias(o) for o in outputs])


def _pair(spark, sf_dir):
    """Two volumes on one lattice."""
    df = views.intercept_gradient(spark, sf_dir)
    return tuple(df.select("vec_id", "inl", "crl", F.col(c).alias("samples")) for c in "ab")


@query("trace_range_3d", sql("cube", "SELECT vec_id, inl, crl, z, round(amp, 6) AS amp FROM cube WHERE inl BETWEEN 2 AND 9 AND crl BETWEEN 5 AND 20 AND z BETWEEN 8 AND 40"))
def trace_range_3d(spark, sf_dir):
    got = volumes.trace_range(views.traces(spark, sf_dir), (2, 9), (5, 20), (8, 40))
    return views.samples(got, "samples", keys=("vec_id", "inl", "crl")).select("vec_id", "inl", "crl", (F.col("z") + 8).alias("z"), F.round("samples", 6).alias("amp"))


@query("trace_range_2d", sql("cube", "SELECT crl AS trcnr, z, round(amp, 6) AS amp FROM cube WHERE inl = 3 AND crl BETWEEN 4 AND 11 AND z BETWEEN 16 AND 31"))
def trace_range_2d(spark, sf_dir):
    got = volumes.trace_range(views.traces(spark, sf_dir), (3, 3), (4, 11), (16, 31))
    return views.samples(got, "samples", keys=("crl",)).select(F.col("crl").alias("trcnr"), (F.col("z") + 16).alias("z"), F.round("samples", 6).alias("amp"))


@query("traces_at_positions", sql("cube", "SELECT vec_id, z, round(amp, 6) AS amp FROM cube WHERE (inl, crl) IN (SELECT s_suppkey // 25, s_suppkey % 25 FROM supplier)"))
def traces_at_positions(spark, sf_dir):
    k = F.col("s_suppkey")
    wanted = views.table(spark, sf_dir, "supplier").select(F.floor(k / 25).cast("long").alias("inl"), (k % 25).alias("crl"))
    return _out(volumes.traces_at(views.traces(spark, sf_dir), wanted).withColumnRenamed("samples", "amp"), "amp")


@query("volume_range", sql("cube", """i AS (SELECT inl, inl - lag(inl) OVER (ORDER BY inl) AS d FROM (SELECT DISTINCT inl FROM cube)), c AS (SELECT crl, crl - lag(crl) OVER (ORDER BY crl) AS d FROM (SELECT DISTINCT crl FROM cube))
SELECT (SELECT min(inl) FROM i) AS inl0, (SELECT max(inl) FROM i) AS inl1, (SELECT min(d) FROM i) AS inl_step, (SELECT min(crl) FROM c) AS crl0, (SELECT max(crl) FROM c) AS crl1, (SELECT min(d) FROM c) AS crl_step, (SELECT max(z) + 1 FROM cube) AS n_samples"""))
def volume_range(spark, sf_dir):
    return volumes.volume_range(views.traces(spark, sf_dir))


@query("common_z_range", "SELECT l_partkey % 50 AS part, max(CAST(l_quantity AS DOUBLE)) AS z0, min(100 + CAST(l_linenumber AS DOUBLE)) AS z1, (max(CAST(l_quantity AS DOUBLE)) + min(100 + CAST(l_linenumber AS DOUBLE))) / 2 AS middle FROM lineitem GROUP BY 1 HAVING max(CAST(l_quantity AS DOUBLE)) <= min(100 + CAST(l_linenumber AS DOUBLE))")
def common_z_range(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return volumes.common_range(li.select((F.col("l_partkey") % 50).alias("part"), F.col("l_quantity").cast("double").alias("z0"), (100 + F.col("l_linenumber").cast("double")).alias("z1")), "part")


@query("volumes_side_by_side", sql("cube_ig", "SELECT inl, crl, z, round(a, 6) AS a, round(b, 6) AS b FROM cube_ig"))
def volumes_side_by_side(spark, sf_dir):
    got = volumes.side_by_side(*_pair(spark, sf_dir), ("a", "b"))
    return views.samples(got, "a", "b", keys=("inl", "crl")).select("inl", "crl", "z", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("data_extent_lattice", sql("points", "b AS (SELECT CAST(floor(min(x)) AS BIGINT) AS x0, CAST(ceil(max(x)) AS BIGINT) AS x1, CAST(floor(min(y)) AS BIGINT) AS y0, CAST(ceil(max(y)) AS BIGINT) AS y1 FROM points), r AS (SELECT unnest(range(x0, x1 + 1)) AS ix, y0, y1 FROM b) SELECT ix, unnest(range(y0, y1 + 1)) AS iy, CAST(1500 AS DOUBLE) AS z FROM r"))
def data_extent_lattice(spark, sf_dir):
    """A horizon of constant z over the extent of the data."""
    from traceflow.operators import gridding

    return gridding.lattice(views.points(spark, sf_dir)).withColumn("z", F.lit(1500.0))


# The declared attributes.
OFF = "(VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) o(i, j)"
SUMS = "s AS (SELECT c.vec_id, c.z, any_value(c.a) AS a, sum(coalesce(n.a, c.a)) AS sa, sum(coalesce(n.b, c.b)) AS sb FROM cube_ig c CROSS JOIN " + OFF + " LEFT JOIN cube_ig n ON n.inl = c.inl + o.i AND n.crl = c.crl + o.j AND n.z = c.z GROUP BY c.vec_id, c.z)"


def _declared(name, inputs, oracle, **params):
    @query(f"attribute_{name}", sql("cube_ig", oracle))
    def run(spark, sf_dir):
        a, b = _pair(spark, sf_dir)
        attribute = attributes.REGISTRY[name]
        return _out(attributes.compute(attribute, dict(zip(inputs, (a, b))), **params), *attribute.outputs)


_declared("identity", ["input"], "SELECT vec_id, z, round(a, 6) AS value FROM cube_ig")
_declared("multiples", ["input"], "SELECT vec_id, z, round(a, 6) AS once, round(2 * a, 6) AS twice, round(3 * a, 6) AS thrice FROM cube_ig")
_declared("mean_of_inputs", ["first", "second"], "SELECT vec_id, z, round((a + b) / 2, 6) AS value FROM cube_ig")
_declared("pass_through", ["first", "second"], "SELECT vec_id, z, round(a, 6) AS first_out, round(b, 6) AS second_out FROM cube_ig")
_declared("block_mean", ["input"], SUMS + " SELECT vec_id, z, round(sa / 8, 6) AS value FROM s")
_declared("block_mean_and_centre", ["input"], SUMS + " SELECT vec_id, z, round(sa / 8, 6) AS value, round(a, 6) AS centre FROM s")
_declared("block_difference", ["first", "second"], SUMS + " SELECT vec_id, z, round(sa - sb, 6) AS value FROM s")
_declared("block_sums", ["first", "second"], SUMS + " SELECT vec_id, z, round(sa, 6) AS first_sum, round(sb, 6) AS second_sum FROM s")
_declared("scaled_block_sums", ["first", "second"], SUMS + " SELECT vec_id, z, round(sa, 6) AS first_sum, round(2.5 * sb, 6) AS second_sum FROM s", scale=2.5, which="second")

# Curvature of two dip volumes.
WEIGHTS = "k(o, d, s) AS (VALUES (-1, -0.5::DOUBLE, 0.178947::DOUBLE), (0, 0::DOUBLE, 0.642105::DOUBLE), (1, 0.5::DOUBLE, 0.178947::DOUBLE))"
CURVATURE = WEIGHTS + """, t AS (SELECT vec_id, inl, crl, z, -a / 0.5 AS u, -b / 0.8 AS v FROM cube_ig),
p AS (SELECT c.vec_id, c.z, any_value(c.u) AS u, any_value(c.v) AS v, sum(kx.d * ky.s * coalesce(n.u, c.u)) AS udx, sum(kx.s * ky.d * coalesce(n.u, c.u)) AS udy, sum(kx.s * ky.s * coalesce(n.u, c.u)) AS us,
  sum(kx.d * ky.s * coalesce(n.v, c.v)) AS vdx, sum(kx.s * ky.d * coalesce(n.v, c.v)) AS vdy, sum(kx.s * ky.s * coalesce(n.v, c.v)) AS vs
  FROM t c CROSS JOIN k kx CROSS JOIN k ky LEFT JOIN t n ON n.inl = c.inl + kx.o AND n.crl = c.crl + ky.o AND n.z = c.z GROUP BY c.vec_id, c.z),
g AS (SELECT p.vec_id, p.z, any_value(p.u) AS u, any_value(p.v) AS v, sum(k.s * q.udx) AS ux, sum(k.s * q.udy) AS uy, sum(k.d * q.us) AS uz, sum(k.s * q.vdx) AS vx, sum(k.s * q.vdy) AS vy, sum(k.d * q.vs) AS vz
  FROM p CROSS JOIN k JOIN p q ON q.vec_id = p.vec_id AND q.z = p.z + k.o GROUP BY p.vec_id, p.z),
-- unit normals n along (u, v, 1), their derivatives J, and b = J n; then the invariants of J seen across n: mean = - div n / 2
f AS (SELECT *, sqrt(u * u + v * v + 1) AS s FROM g),
q AS (SELECT *, u / s AS n1, v / s AS n2, 1 / s AS n3, (u * ux + v * vx) / s AS qx, (u * uy + v * vy) / s AS qy, (u * uz + v * vz) / s AS qz FROM f),
j AS (SELECT *, (ux - n1 * qx) / s AS j11, (uy - n1 * qy) / s AS j12, (uz - n1 * qz) / s AS j13, (vx - n2 * qx) / s AS j21, (vy - n2 * qy) / s AS j22, (vz - n2 * qz) / s AS j23, -n3 * qx / s AS j31, -n3 * qy / s AS j32, -n3 * qz / s AS j33 FROM q),
i AS (SELECT vec_id, z, j11 + j22 + j33 AS div, j11 * j11 + j22 * j22 + j33 * j33 + 2 * (j12 * j21 + j13 * j31 + j23 * j32) AS square,
  j11 * j11 + j12 * j12 + j13 * j13 + j21 * j21 + j22 * j22 + j23 * j23 + j31 * j31 + j32 * j32 + j33 * j33 AS norm,
  (j11 * n1 + j12 * n2 + j13 * n3) ^ 2 + (j21 * n1 + j22 * n2 + j23 * n3) ^ 2 + (j31 * n1 + j32 * n2 + j33 * n3) ^ 2 AS along FROM j),
h AS (SELECT vec_id, z, -div / 2 AS mean, (div * div - (square + norm - along) / 2) / 2 AS gauss FROM i)
SELECT vec_id, z, round(mean, 4) AS mean, round(gauss, 4) AS gauss, round(mean - sqrt(greatest(mean * mean - gauss, 0)), 4) AS kmin, round(mean + sqrt(greatest(mean * mean - gauss, 0)), 4) AS kmax FROM h"""
CURVED = attributes.register("dip_curvature", attributes.Attribute(("inline", "crossline"), ("mean", "gauss", "kmin", "kmax", "most_pos", "most_neg"), lambda t, p: structure.dip_curvature(t["inline"], t["crossline"], p["inl_factor"], p["crl_factor"]), 1, params={"inl_factor": attributes.Param(float, 1.0), "crl_factor": attributes.Param(float, 1.0)}))


def _curved(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return attributes.compute(CURVED, {"inline": a, "crossline": b}, inl_factor=0.5, crl_factor=0.8)


@query("curvature_from_dips", sql("cube_ig", CURVATURE.rsplit(", round(mean - sqrt", 1)[0] + " FROM h"))
def curvature_from_dips(spark, sf_dir):
    return _out(_curved(spark, sf_dir), "mean", "gauss", digits=4)


@query("curvature_extremes", sql("cube_ig", CURVATURE))
def curvature_extremes(spark, sf_dir):
    return _out(_curved(spark, sf_dir), "mean", "gauss", "kmin", "kmax", digits=4)


@query("curvature6")
def curvature6(spark, sf_dir):
    return _out(_curved(spark, sf_dir), *CURVED.outputs)


@query("gradient_average", sql("cube", WEIGHTS + """,
p AS (SELECT c.vec_id, c.z, sum((kx.d * ky.s + kx.s * ky.d) * coalesce(n.amp, c.amp)) AS flat, sum(kx.s * ky.s * coalesce(n.amp, c.amp)) AS smooth FROM cube c CROSS JOIN k kx CROSS JOIN k ky LEFT JOIN cube n ON n.inl = c.inl + kx.o AND n.crl = c.crl + ky.o AND n.z = c.z GROUP BY c.vec_id, c.z)
SELECT p.vec_id, p.z, round(sum(k.s * q.flat + k.d * q.smooth) / 3, 6) AS value FROM p CROSS JOIN k JOIN p q ON q.vec_id = p.vec_id AND q.z = p.z + k.o GROUP BY p.vec_id, p.z"""))
def gradient_average(spark, sf_dir):
    from traceflow.operators import stencil

    return _out(stencil.map_tiles(views.traces(spark, sf_dir), structure.gradient_mean, ["value"], 1), "value")


DESA = """y AS (SELECT vec_id, z, amp AS x, lag(amp) OVER w AS p, lead(amp) OVER w AS n FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z)),
d AS (SELECT vec_id, z, x, p, n, x - coalesce(p, 0) AS yb, coalesce(n - x, x) AS yf FROM y),
e AS (SELECT vec_id, z, x * x - coalesce(p * n, 0) AS t, yb * yb - coalesce(lag(yb) OVER w * lead(yb) OVER w, 0) AS tb, yf * yf - coalesce(lag(yf) OVER w * lead(yf) OVER w, 0) AS tf FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY z)),
a AS (SELECT vec_id, z, t, 1 - (tb + tf) / (4 * nullif(t, 0)) AS c FROM e)
SELECT vec_id, z, CASE WHEN abs(c) <= 1 THEN round(acos(CASE WHEN abs(c) <= 1 THEN c END) / (2 * pi() * 0.004), 4) END AS frequency, CASE WHEN t / nullif(1 - c * c, 0) >= 0 THEN round(sqrt(CASE WHEN t / nullif(1 - c * c, 0) >= 0 THEN t / (1 - c * c) END), 4) END AS amplitude FROM a"""


@query("desa_frequency", sql("cube", DESA))
def desa_frequency(spark, sf_dir):
    return _out(views.traces(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in A.desa(F.col("samples"), 0.004).items()]), "frequency", "amplitude", digits=4)


# Export tables.
AFFINE = (1000.0, 2000.0, 25.0, 3.0, -4.0, 12.5)
XY = "1000.0 + 25.0 * {i} - 4.0 * {c}", "2000.0 + 3.0 * {i} + 12.5 * {c}"


@query("export_horizon_layer", sql("horizon2d", f"SELECT line, trcnr, round(z * 1000, 6) AS zvals, {XY[0].format(i='line', c='trcnr')} AS x, {XY[1].format(i='line', c='trcnr')} AS y FROM horizon2d WHERE z IS NOT NULL"))
def export_horizon_layer(spark, sf_dir):
    h = views.horizon2d(spark, sf_dir).where("z is not null")
    x, y = geometry.to_map(F.col("line"), F.col("trcnr"), AFFINE)
    return h.select("line", "trcnr", F.round(geometry.layer_value(F.col("z"), "zvals", True), 6).alias("zvals"), x.alias("x"), y.alias("y"))


@query("export_random_lines", sql("horizon2d", f"SELECT 'random ' || line AS line_name, 'LINESTRING (' || string_agg(CAST(CAST({XY[0].format(i='trcnr', c='(trcnr % 7)')} AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST({XY[1].format(i='trcnr', c='(2 * (trcnr % 7))')} AS BIGINT) AS VARCHAR), ', ' ORDER BY trcnr) || ')' AS wkt FROM horizon2d GROUP BY line HAVING count(*) > 1"))
def export_random_lines(spark, sf_dir):
    """Lines through nodes of the lattice, in map coordinates."""
    h = views.horizon2d(spark, sf_dir)
    x, _ = geometry.to_map(F.col("trcnr"), F.col("trcnr") % 7, AFFINE)
    _, y = geometry.to_map(F.col("trcnr"), 2 * (F.col("trcnr") % 7), AFFINE)
    nodes = h.select(F.concat(F.lit("random "), F.col("line").cast("string")).alias("line_name"), "trcnr", x.cast("long").alias("x"), y.cast("long").alias("y"))
    return geometry.polyline_wkt(nodes, "line_name", "trcnr", "x", "y")


WELL_TYPES = ["none", "oil", "gas", "dry", "water"]


@query("export_wells", "SELECT s_name AS name, 'W' || s_suppkey AS uwid, CAST(s_nationkey % 5 AS INTEGER) AS status, 'POINT (' || s_nationkey || ' ' || s_suppkey || ')' AS wkt FROM supplier")
def export_wells(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    kinds = F.array(*map(F.lit, WELL_TYPES))
    wells = s.select(F.col("s_name").alias("name"), F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("uwid"), F.get(kinds, (F.col("s_nationkey") % 5).cast("int")).alias("kind"), F.col("s_nationkey").alias("x"), F.col("s_suppkey").alias("y"))
    return geometry.well_layer(wells, WELL_TYPES)


@query("export_well_tracks", "SELECT l_orderkey AS name, 'LINESTRING (' || string_agg(l_suppkey || ' ' || l_partkey, ', ' ORDER BY l_linenumber, l_suppkey, l_partkey) || ')' AS wkt FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def export_well_tracks(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("o"), F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"))
    return geometry.polyline_wkt(li, "name", "o", "x", "y")


VERTICES = "v AS (SELECT o_custkey AS name, o_orderkey AS seq, o_orderkey % 1000 AS x, o_custkey % 777 AS y, o_custkey % 2 = 0 AS closed FROM orders), n AS (SELECT name, any_value(closed) AS closed, count(*) AS n, string_agg(x || ' ' || y, ', ' ORDER BY seq) AS body, arg_min(x || ' ' || y, seq) AS first FROM v GROUP BY name)"


@query("export_polygons", "WITH " + VERTICES + " SELECT name, CASE WHEN closed THEN 'POLYGON ((' || body || ', ' || first || '))' ELSE 'LINESTRING (' || body || ')' END AS wkt, closed FROM n WHERE n > CASE WHEN closed THEN 2 ELSE 1 END")
def export_polygons(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    v = o.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("x"), (F.col("o_custkey") % 777).alias("y"), (F.col("o_custkey") % 2 == 0).alias("closed"))
    return geometry.shapes_wkt(v)


@query("export_survey_polygon", sql("cube", f"b AS (SELECT min(inl) AS i0, max(inl) AS i1, min(crl) AS c0, max(crl) AS c1 FROM cube), c(seq, i, c) AS (SELECT 0, i0, c0 FROM b UNION ALL SELECT 1, i0, c1 FROM b UNION ALL SELECT 2, i1, c1 FROM b UNION ALL SELECT 3, i1, c0 FROM b UNION ALL SELECT 4, i0, c0 FROM b) SELECT CAST(seq AS INTEGER) AS seq, {XY[0].format(i='i', c='c')} AS x, {XY[1].format(i='i', c='c')} AS y FROM c"))
def export_survey_polygon(spark, sf_dir):
    return geometry.survey_ring(views.traces(spark, sf_dir), AFFINE)


@query("export_horizon_bands", sql("horizon2d", "b AS (SELECT min(line) AS l0, max(line) AS l1, min(trcnr) AS t0, max(trcnr) AS t1 FROM horizon2d), g AS (SELECT l.line, t.trcnr FROM (SELECT unnest(range(l0, l1 + 1)) AS line FROM b) l, (SELECT unnest(range(t0, t1 + 1)) AS trcnr FROM b) t) SELECT g.line, g.trcnr, round(z * 1000, 6) AS band0, round(z * z, 4) AS band1 FROM g LEFT JOIN horizon2d h ON h.line = g.line AND h.trcnr = g.trcnr"))
def export_horizon_bands(spark, sf_dir):
    """A raster's cells: the horizon's z in user units, then an attribute, null where undefined."""
    h = views.horizon2d(spark, sf_dir)
    return geometry.raster_bands(h.withColumn("square", F.col("z") * F.col("z")), "line", "trcnr", {"band0": (F.col("z") * 1000, 6), "band1": (F.col("square"), 4)})


@query("closed_polygon_at_z", "SELECT o_custkey AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS seq, o_orderkey % 1000 AS x, o_custkey % 777 AS y, 1200.0::DOUBLE AS z FROM orders UNION ALL SELECT o_custkey, count(*), arg_min(o_orderkey % 1000, o_orderkey), any_value(o_custkey % 777), 1200.0 FROM orders GROUP BY o_custkey")
def closed_polygon_at_z(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("x"), (F.col("o_custkey") % 777).alias("y"))
    return geometry.closed_at(o, 1200.0)


@query("simplified_lines")
def simplified_lines(spark, sf_dir):
    return geometry.simplified(views.horizon2d(spark, sf_dir).where("z is not null").select("line", "trcnr", F.col("trcnr").cast("double").alias("x"), F.col("z").alias("y"), (F.col("z") / 2).alias("z")), "line", "trcnr", (0.5, 40.0, 20.0))
