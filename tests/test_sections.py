"""Polygons of many vertices, borders and masks, scopes, fault polygons and draped profiles on small tables."""

import math
import random

import pytest

from traceflow.operators import draping, geometry, gridding, polygons


def vertices(spark, rings):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)], "polygon string, seq int, x double, y double")


def even_odd(x, y, ring):
    """(inside, on the border)"""
    inside = on = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on |= abs(cross) < 1e-9 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
        if min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside, on


@pytest.mark.parametrize("cell", [0.7, 5.0, 1000.0])
def test_points_in_polygons(spark, cell):
    rng = random.Random(4)
    star = [(10 + (9 if i % 2 else 4) * math.cos(i * math.pi / 600), 10 + (9 if i % 2 else 4) * math.sin(i * math.pi / 600)) for i in range(1200)]
    rings = {"square": [(0, 0), (8, 0), (8, 8), (0, 8)], "star": star, "bow": [(2, 2), (12, 12), (12, 2), (2, 12)], "line": [(1, 1), (5, 5)], "random": [(rng.uniform(-5, 20), rng.uniform(-5, 20)) for _ in range(40)]}
    pts = [(i, rng.uniform(-6, 21), rng.uniform(-6, 21)) for i in range(300)] + [(1000, 0.0, 0.0), (1001, 8.0, 4.0), (1002, 4.0, 8.0), (1003, 4.0, 0.0), (1004, 7.0, 7.0), (1005, None, 1.0), (1006, 12.0, 6.0)]
    got = {(r.id, r.polygon): r.border for r in polygons.containing(spark.createDataFrame(pts, "id int, x double, y double"), polygons.ring_edges(vertices(spark, rings)), ["id"], cell=cell).collect()}
    want = {}
    for i, x, y in pts:
        for k, ring in rings.items():
            if x is not None and len(ring) > 2 and any(even_odd(x, y, ring)):
                want[i, k] = even_odd(x, y, ring)[1]
    assert got == want


def test_mask(spark):
    cells = spark.createDataFrame([(x, y) for x in range(12) for y in range(12)], "ix long, iy long")
    ring = [(1, 1), (9, 1), (9, 9), (1, 9)]
    crop = vertices(spark, {"a": ring, "b": [(10, 10), (11, 10), (11, 11)]})
    hull = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (11, 0), (11, 11)])], "seq int, x double, y double")
    faults = spark.createDataFrame([(f, i, float(x), float(y), f == 1) for f, r in ((1, [(4, 2), (7, 2), (7, 4), (4, 4)]), (2, ring)) for i, (x, y) in enumerate(r)], "fault int, seq int, x double, y double, closed boolean")
    got = lambda **k: {(r.ix, r.iy) for r in polygons.masked(cells, **k).collect()}
    every = {(x, y) for x in range(12) for y in range(12)}
    in_crop = {(x, y) for x, y in every if 1 <= x <= 9 and 1 <= y <= 9 or 10 <= y <= x <= 11}
    in_hull = {(x, y) for x, y in every if y <= x}
    heave = {(x, y) for x, y in every if 4 < x < 7 and 2 < y < 4}
    assert got() == every and got(crop=crop) == in_crop and got(hull=hull) == in_hull and got(faults=faults) == every - heave
    assert got(crop=crop, hull=hull, faults=faults) == (in_crop & in_hull) - heave
    assert got(crop=crop.limit(0)) == set() and got(faults=faults.limit(0)) == every


def test_scopes_and_methods(spark):
    points = spark.createDataFrame([(i, float(i % 7), float(i * 5 % 9), 2.5) for i in range(60)], "id long, x double, y double, v double")
    lattice = lambda *a, **k: {(r.ix, r.iy) for r in polygons.scope_lattice(points, *a, **k).collect()}
    assert lattice("box") == lattice("hull") == {(x, y) for x in range(7) for y in range(9)}
    assert lattice("range", 2, ranges=(-1, 4, 0, 3)) == {(x, y) for x in (-1, 1, 3) for y in (0, 2)}
    h = spark.createDataFrame([(3, 5), (6, 4)], "ix long, iy long")
    assert lattice("horizon", horizon=h) == {(x, y) for x in range(3, 7) for y in (4, 5)} and lattice("horizon", horizon=h.limit(0)) == set()
    for bad in (lambda: polygons.scope_lattice(points, "moon"), lambda: polygons.scope_lattice(points, "range"), lambda: polygons.grid(points, "moon")):
        with pytest.raises(ValueError):
            bad()
    for method in polygons.METHODS:
        got = polygons.grid(points, method, "hull", radius=4.0, most=None, levels=2).collect()
        assert len(got) == 63
        if method != "mba":
            assert all(r.v is None or abs(r.v - 2.5) < 1e-9 for r in got) and any(r.v is not None for r in got)


def test_edges_as_a_table(spark):
    """A table of edges hides what the same list hides."""
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(0, 9), rng.uniform(0, 9), float(i)) for i in range(80)], "id long, x double, y double, v double")
    edges = [(1, i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(6)]
    table, cells = gridding.edge_table(spark, edges), gridding.lattice(points)
    rows = lambda df: sorted(map(str, df.collect()))
    near = lambda df: sorted((r.ix, r.iy, round(r.v, 9)) for r in df.collect())
    assert near(gridding.splat(points, edges)) == near(gridding.splat(points, table))
    pick = ["ix", "iy", "sector", "id"]
    assert rows(gridding.sectors(cells, points, edges, 4.0, least=3).select(*pick)) == rows(gridding.sectors(cells, points, table, 4.0, least=3).select(*pick))


def test_fault_polygon(spark):
    """Vertical sticks through a sloping horizon; a stick beside it, one that stays above, and cells without a corner."""
    horizon = spark.createDataFrame([(x, y, None if (x, y) == (8, 8) else 1.0 + 0.5 * x + 0.25 * y) for x in range(10) for y in range(10)], "ix long, iy long, z double")
    nodes = []
    for stick, (x, y) in enumerate([(2.2, 3.1), (4.0, 5.0), (5.5, 6.25), (20.0, 1.0), (7.6, 7.7)]):
        nodes += [("f", stick, k, x, y, z) for k, z in enumerate((-9.0, 2.0, 9.0))]
    nodes += [("f", 9, 0, 1.0, 1.0, -5.0), ("f", 9, 1, 1.0, 1.0, -4.0), ("g", 0, 0, 3.0, 0.5, 2.0), ("g", 0, 1, 4.0, 2.5, 4.0), ("g", 0, 2, None, 2.5, 4.0)]
    sticks = spark.createDataFrame(nodes, "fault string, stick int, seq int, x double, y double, z double")
    got = [(r.fault, r.seq, round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in draping.fault_polygons(sticks, horizon).orderBy("fault", "seq").collect()]
    hits = [(x, y, 1 + 0.5 * x + 0.25 * y) for x, y in ((2.2, 3.1), (4.0, 5.0), (5.5, 6.25))]
    # g's stick: 2 + 2t = 1 + 0.5 (3 + t) + 0.25 (0.5 + 2t)
    t = 0.625
    g = (3 + t, 0.5 + 2 * t, 2 + 2 * t)
    want = [("f", i, *(round(v, 9) for v in p)) for i, p in enumerate(hits + hits[::-1])] + [("g", i, *(round(v, 9) for v in g)) for i in range(2)]
    assert got == want
    assert draping.fault_polygons(sticks.limit(0), horizon).count() == 0
    assert [r.z for r in draping.at_constant_z(sticks.limit(2), 3).collect()] == [3.0, 3.0]


def test_fault_polygon_plan(spark, tmp_path):
    """The sticks' cells, which their planned size doesn't tell, are never gathered at the driver for a broadcast, however large the horizon."""
    spark.range(40).selectExpr("id div 8 as fault", "id div 4 as stick", "id % 4 as seq", "id / 3.0 as x", "id / 5.0 as y", "id - 20.0 as z").write.parquet(f"{tmp_path}/sticks")
    spark.range(4000).selectExpr("id div 50 as ix", "id % 50 as iy", "id / 900.0 as z").write.parquet(f"{tmp_path}/horizon")
    plan = draping.fault_polygons(spark.read.parquet(f"{tmp_path}/sticks"), spark.read.parquet(f"{tmp_path}/horizon"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_profiles(spark):
    horizon = spark.createDataFrame([(x, y, None if x == 5 and y == 1 else x + 10.0 * y) for x in range(9) for y in range(4)], "ix long, iy long, z double")
    paths = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 7.5, 0.5), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 2, 2.0, 2.0), (3, 0, -5.0, -5.0), (3, 1, -4.0, -5.0)], "path int, seq int, x double, y double")
    got = sorted((r.path, r.part, r.n, round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in draping.profiles(paths, horizon).collect())
    one = [0.5, 1, 2, 3]  # cells 4 and 5 miss a corner
    want = [(1, 0, i, x, 0.5, x + 5) for i, x in enumerate(one)] + [(1, 1, i, x, 0.5, x + 5) for i, x in enumerate([6, 7, 7.5])]
    want += [(2, 0, 0, 1, 1, 11), (2, 0, 1, 2, 2, 22)]
    assert got == [(p, a, n, float(x), float(y), float(z)) for p, a, n, x, y, z in want]
    assert geometry.convex_hull(spark.createDataFrame([], "x double, y double")).count() == 0
