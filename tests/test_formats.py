"""Well-known binary, percent coding, stored grids and horizons; surfaces with a linear start; smooth division; network files."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.functions import arrays as A
from traceflow.functions import encoding as E
from traceflow.operators import polygons, saved, spectral, surfaces, ties
from traceflow.sources import files


def test_wkb(spark):
    rng = random.Random(1)
    rings = [[(rng.uniform(-1e6, 1e6), rng.uniform(-1, 1)) for _ in range(n)] for n in (1, 3, 5)] + [[(0.0, -0.0), (1.5, 2.0), (0.0, -0.0)], []]
    df = spark.createDataFrame([(i, [p[0] for p in r], [p[1] for p in r]) for i, r in enumerate(rings)], "id int, x array<double>, y array<double>")
    got = df.select("id", E.wkb_linestring(F.col("x"), F.col("y")).alias("l"), E.wkb_polygon(F.col("x"), F.col("y")).alias("p"), E.wkb_point(F.get("x", F.lit(0)), F.get("y", F.lit(0))).alias("o")).orderBy("id").collect()
    flat = lambda r: b"".join(struct.pack(">dd", *p) for p in r)
    for r, ring in zip(got, rings):
        assert bytes(r.l) == b"\0" + struct.pack(">II", 2, len(ring)) + flat(ring)
        shut = ring if not ring or ring[0] == ring[-1] else [*ring, ring[0]]
        assert (r.p is None and r.o is None) if not ring else bytes(r.p) == b"\0" + struct.pack(">III", 3, 1, len(shut)) + flat(shut) and bytes(r.o) == b"\0" + struct.pack(">I", 1) + flat(ring[:1])


def test_percent_coding(spark):
    texts = ["aZ09", "", "a b/c", "é\n", "back\\slash", "100%", "漢", None, "{}[]~_-."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    got = df.select("id", "s", E.percent_encode(F.col("s")).alias("e"), E.percent_decode(E.percent_encode(F.col("s"))).alias("d")).orderBy("id").collect()
    for r in got:
        if r.s is None:
            assert r.e is None and r.d is None
            continue
        want = "".join(c if c.isascii() and c.isalnum() else "%5C%5C" if c == "\\" else "".join(f"%{b:02X}" for b in c.encode()) for c in r.s)
        assert r.e == want and r.d == r.s.replace("\\", "\\" * 4)
    one = spark.createDataFrame([("%zz%4",)], "s string").select(E.percent_decode(F.col("s")).alias("d")).first().d
    assert one == "\0%4"


def test_stored_grid(spark):
    c = polygons.GridConfig("nrn", "range", 2, 12.5, None, 4, (0, 6, 0, 4), None, "crop", ("f", "g"))
    assert polygons.GridConfig.from_params(c.params()) == c and polygons.GridConfig.from_params({}) == polygons.GridConfig()
    with pytest.raises(ValueError):
        polygons.GridConfig.from_params({"Grid.Scope": "moon"})
    points = spark.createDataFrame([(i, float(i % 7), float(i * 5 % 9), 2.5) for i in range(60)], "id long, x double, y double, v double")
    ring = lambda *v: [(i, float(x), float(y)) for i, (x, y) in enumerate(v)]
    crop = spark.createDataFrame([("p", *v) for v in ring((-1, -1), (5, -1), (5, 9), (-1, 9))], "polygon string, seq int, x double, y double")
    fault = spark.createDataFrame([(1, *v, True) for v in ring((1, 1), (3, 1), (3, 3), (1, 3))], "fault int, seq int, x double, y double, closed boolean")
    got = {(r.ix, r.iy) for r in c.run(points, {"crop": crop, "f": fault, "g": fault.limit(0)}).collect()}
    assert got == {(x, y) for x in (0, 2, 4) for y in (0, 2, 4)} - {(2, 2)}


def test_horizon_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.5), (2, 2, None)], "ix long, iy long, z double")
    files.write_horizon(df, str(tmp_path), "top")
    files.write_horizon(df, str(tmp_path), "top")
    assert [tuple(r) for r in files.read_horizon(spark, str(tmp_path), "top").collect()] == [(1, 2, 3.5)]
    cor = spark.createDataFrame([("3D_x", 10.0, 0.0, 1.0)], "line string, shift double, phase double, amp double")
    files.write_horizon(ties.shifted_horizon3d(df.withColumnRenamed("ix", "inl").withColumnRenamed("iy", "crl"), cor, 10.0).withColumnRenamed("inl", "ix").withColumnRenamed("crl", "iy"), str(tmp_path), "moved")
    assert [r.z for r in files.read_horizon(spark, str(tmp_path), "moved").collect()] == [4.5]


def test_plane_and_tolerance(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), float(3 + 2 * x - y)) for i, (x, y) in enumerate(rng.uniform(0, 9, (50, 2)))]
    cells = spark.createDataFrame([(x, y) for x in range(10) for y in range(10)], "ix long, iy long")
    df = spark.createDataFrame(pts, "id long, x double, y double, v double")
    surface, left = surfaces.multilevel(cells, df, 10, linear=True, tol=1e-8)  # a plane needs no level
    assert all(abs(r.v - (3 + 2 * r.ix - r.iy)) < 1e-9 for r in surface.collect()) and all(abs(r.v) < 1e-9 for r in left.collect())
    bent = df.withColumn("v", F.col("v") + F.sin("x"))
    c, a, b = np.linalg.lstsq(np.array([[1, x, y] for _, x, y, _ in pts]), np.array([v + np.sin(x) for _, x, _, v in pts]), rcond=None)[0]
    assert surfaces.plane(bent.withColumnRenamed("v", "r")) == pytest.approx((c, a, b))
    with_plane, _ = surfaces.multilevel(cells, bent, 3, linear=True)
    without, _ = surfaces.multilevel(cells, bent.withColumn("v", F.col("v") - (c + a * F.col("x") + b * F.col("y"))), 3)
    base = {(r.ix, r.iy): r.v for r in without.collect()}
    assert all(abs(r.v - (base[r.ix, r.iy] + c + a * r.ix + b * r.iy)) < 1e-9 for r in with_plane.collect())
    loose, rest = surfaces.multilevel(cells, bent, 10, linear=True, tol=5.0)
    assert all(abs(r.v - (c + a * r.ix + b * r.iy)) < 1e-9 for r in loose.collect()) and max(abs(r.v) for r in rest.collect()) < 5
    one = spark.createDataFrame([(1, 2.0, 2.0, 7.0)], df.schema)
    assert surfaces.plane(one.withColumnRenamed("v", "r")) == (7.0, 0.0, 0.0) and surfaces.plane(df.limit(0).withColumnRenamed("v", "r")) == (0.0, 0.0, 0.0)
    row = spark.createDataFrame([(i, float(i), 1.0, 2.0 * i) for i in range(4)], df.schema)
    assert surfaces.plane(row.withColumnRenamed("v", "r")) == pytest.approx((0, 2, 0), abs=1e-9)


def test_discard(spark):
    df = saved.saved(spark.range(3))
    assert os.path.isdir(df.saved_at) and df.count() == 3
    saved.discard(df)
    assert not os.path.isdir(df.saved_at)
    saved.discard(spark.range(1))


def test_smooth_division_is_shaping():
    """One trace, against the same iteration on dense matrices, and its fixed point: shaping's normal equations."""
    rng = np.random.default_rng(2)
    n, half = 40, 4
    den, num = rng.normal(size=(3, n)) + 2, rng.normal(size=(3, n))
    num[2] = 0
    smooth = np.stack([spectral.triangle_smooth(np.eye(n), half)[i] for i in range(n)]).T
    got = spectral.smooth_division(num, den, half, 400, 1e-30)
    for r in range(2):
        s = smooth @ smooth.T
        d = np.diag(den[r])
        # r = S (L' L S + 1 (1 - S))^-1 L' d
        want = s @ np.linalg.solve(np.eye(n) + (d @ d - np.eye(n)) @ s, d @ num[r])
        assert np.abs(got[r] - want).max() < 1e-6
    assert (got[2] == 0).all()
    few = spectral.smooth_division(num, den, half)
    assert np.abs(few - got).max() < 0.05


def test_zero_crossings_of_odd_traces(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, -2.0, -1.0, 0.0, 5.0]), (2, []), (3, None), (4, [-1.0])], "id int, s array<double>")
    got = {r.id: r.v for r in df.select("id", A.zero_crossing_block(F.col("s")).alias("v")).collect()}
    assert got == {1: [3, 3, -2, -2, 5, 5], 2: [], 3: None, 4: [-1]}
