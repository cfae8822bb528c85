"""Operators without SQL against brute force on small fixtures, and the checks of declarations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.functions import kernels3d as K
from traceflow.operators import attributes, geometry, gridding, structure, surfaces, ties, volumes
from traceflow.operators.stencil import Tile

TIES = "line_a long, trc_a long, line_b long, trc_b long, zdiff double, phasediff double, ampdiff double, quality double"


def network(n=12, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(a), 1, int(b), 1, float(rng.normal()), float(rng.uniform(-170, 170)), float(np.exp(rng.normal() / 3)), float(rng.choice([0.4, 0.9]))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]


def brute(rows, value, start, references, steps, wrap=False):
    """Damped Jacobi steps as a loop over ties."""
    c, d = dict(start), [value(r) for r in rows]
    for _ in range(steps):
        moves = {}
        for r, v in zip(rows, d):
            e = v - c[r[0]] + c[r[2]]
            moves.setdefault(r[0], []).append(e)
            moves.setdefault(r[2], []).append(-e)
        c = {k: 0.0 if k in references else v + 0.75 * (np.mean(moves[k]) if k in moves else 0) for k, v in c.items()}
        if wrap:
            d = [min((v, v - 360, v + 360), key=lambda x: abs(x - (c[r[0]] - c[r[2]]))) for r, v in zip(rows, d)]
    return c


def test_adjust_all(spark):
    rows = network()
    good = [r for r in rows if r[7] >= 0.5]
    got = {r.line: (r.shift, r.phase, r.amp) for r in ties.adjust_all(spark.createDataFrame(rows, TIES), [1], 0.5, 4, 0.75, None).collect()}
    zero = {k: 0.0 for r in good for k in (r[0], r[2])}
    z, p = brute(good, lambda r: r[4], zero, [1], 4), brute(good, lambda r: r[5], zero, [1], 4, True)
    log = [np.log10(r[6]) if r[0] == 1 else -np.log10(r[6]) for r in rows if 1 in (r[0], r[2])]
    near = {k for r in rows if 1 in (r[0], r[2]) for k in (r[0], r[2])}
    start = {k: 0.0 if k in near else -np.mean(log) for r in rows for k in (r[0], r[2])}
    a = brute(good, lambda r: np.log10(r[6]), start, [1], 4)
    for k, x in got.items():
        assert x == pytest.approx((z.get(k, 0.0), p.get(k, 0.0), 10 ** a[k]), abs=1e-9)


def test_many_steps(spark):
    """A plan doesn't grow with the steps, and a consistent network comes to rest."""
    truth = {k: float(k * k % 7) for k in range(4)}
    rows = [(a, 1, b, 1, truth[a] - truth[b], 0.0, 1.0, 1.0) for a in range(4) for b in range(a + 1, 4)]
    got = {r.line: r.c for r in ties.adjust(spark.createDataFrame(rows, TIES), "zdiff", [0], 0.5, 30, 0.75).collect()}
    assert got == pytest.approx(brute(rows, lambda r: r[4], dict.fromkeys(truth, 0.0), [0], 30), abs=1e-9)
    assert got == pytest.approx({k: v - truth[0] for k, v in truth.items()}, abs=1e-2)


def test_erase_and_set(spark):
    df = spark.createDataFrame(network(), TIES)
    assert {1, 2}.isdisjoint({r.line for r in ties.lines(ties.erased(df, spark.createDataFrame([(1,), (2,)], "line long"))).collect()})
    new = df.limit(1).select("line_a", "trc_a", "line_b", "trc_b", F.lit(9.0).alias("zdiff"))
    assert ties.with_values(df, new).where("zdiff = 9").count() == 1


def test_crossings_and_nulls(spark):
    rows = [(1, 1, 0.0, 0.5), (1, 2, 3.0, 0.5), (1, 3, None, None), (2, 1, 0.6, -1.0), (2, 2, 0.6, 4.0), (3, 1, 9.0, 9.0), (4, 1, 0.0, 0.6), (4, 2, 3.0, 0.6)]
    st = spark.createDataFrame(rows, "line long, trcnr long, x double, y double")
    got = sorted(tuple(r) for r in ties.line_crossings(st).collect())
    assert [r[:4] for r in got] == [(1, 1, 2, 1), (2, 1, 4, 1)] and np.allclose([r[4:] for r in got], [(0.6, 0.5), (0.6, 0.6)])
    assert ties.line_crossings(st.limit(0)).count() == 0


def test_nearest_with_few_points(spark):
    cells = spark.createDataFrame([(0, 0), (50, 50)], "ix long, iy long")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 40.0, 40.0, 2.0), (3, 45.0, 60.0, 3.0)], "id long, x double, y double, v double")
    got = {(r.ix, r.id) for r in gridding.nearest(cells, pts, 2, 2.0).collect()}
    assert got == {(0, 1), (0, 2), (50, 2), (50, 3)}
    assert gridding.nearest(cells, pts, 9, 2.0).count() == 6 and gridding.nearest(cells, pts.limit(0), 2, 2.0).count() == 0
    with pytest.raises(ValueError):
        gridding.idw(cells, pts, [])


def test_simplified(spark):
    rows = [(1, i, float(i), 0.0 if i != 5 else 3.0, 0.0) for i in range(11)]
    got = geometry.simplified(spark.createDataFrame(rows, "line long, trcnr long, x double, y double, z double"), "line", "trcnr", (1.0, 1.0, 1.0))
    assert sorted(r.trcnr for r in got.collect()) == [0, 4, 5, 6, 10]


def test_declarations(spark):
    t = spark.createDataFrame([(0, 0, 0, [1.0, 2.0])], "vec_id long, inl long, crl long, samples array<double>")
    both = {"first": t, "second": t}
    got = attributes.compute("scaled_block_sums", both, scale=3, which="first").first()
    assert got.first_sum == [12.0, 24.0] and got.second_sum == [4.0, 8.0]
    for wrong, error in (({"scale": "x"}, TypeError), ({"scale": 1e9}, ValueError), ({"which": "none"}, ValueError), ({"other": 1}, ValueError)):
        with pytest.raises(error):
            attributes.compute("scaled_block_sums", both, **wrong)
    with pytest.raises(ValueError):
        attributes.compute("mean_of_inputs", {"first": t})
    sparse = spark.createDataFrame([(0, 0, 0, [1.0, 2.0]), (1, 3, 0, [1.0, 2.0])], t.schema)
    with pytest.raises(ValueError):
        attributes.compute("mean_of_inputs", {"first": t, "second": sparse}, check_steps=True)


def test_settings():
    assert volumes.default_gate(0.004, 0.05) == pytest.approx((-0.048, 0.048)) and volumes.component_names(0.004, 40.0) == ["40 Hz", "80 Hz", "120 Hz"]
    assert volumes.displayed_frequency(0.1, 125.0, False) == 0.5 and volumes.displayed_frequency(5.0, 125.0, True) == 5000.0


def test_curvature_of_a_plane_and_a_bowl():
    """Constant dips have no curvature; kmin, mean and kmax stay in order."""
    there = np.ones((5, 5), bool)
    tile = lambda f: Tile(np.fromfunction(f, (5, 5, 9)), there, 1)
    flat = structure.dip_curvature(tile(lambda x, y, z: 0.3 + 0 * x), tile(lambda x, y, z: 0.2 + 0 * x))
    assert np.allclose(flat["mean"][:, :, 1:-1], 0, atol=1e-3)
    bowl = structure.dip_curvature(tile(lambda x, y, z: 0.1 * (x - 1.7)), tile(lambda x, y, z: 0.1 * (y - 1.6)))
    mid = slice(1, -1)
    assert (bowl["kmin"][:, :, mid] <= bowl["mean"][:, :, mid] + 1e-12).all() and (bowl["most_pos"] == np.maximum(bowl["kmax"], bowl["kmin"]))[:, :, mid].all()


def test_polynomial_weights_recover_a_polynomial():
    x, y, z = np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij")
    c = np.arange(1.0, 11.0)
    f = sum(k * b for k, b in zip(c, (1, x, y, z, x * x, y * y, z * z, x * y, x * z, y * z)))
    assert np.allclose((K.polynomial_weights(3) * f).sum((1, 2, 3)), c)


def test_structure_tensor_of_a_dipping_plane():
    """Samples that are a linear function have one gradient: one eigenvalue and its dips."""
    tile = Tile(np.fromfunction(lambda x, y, z: 2 * x + 3 * y + 4 * z, (7, 7, 12)), np.ones((7, 7), bool), 2)
    got = structure.tensor_attributes(tile)
    mid = (slice(None), slice(None), slice(3, -3))
    assert np.allclose(got["inl_dip"][mid], -0.5) and np.allclose(got["crl_dip"][mid], -0.75) and np.allclose(got["cplane"][mid], 1)


@pytest.mark.parametrize("shift", [0, 3])
def test_tie_estimate_of_a_shifted_trace(shift):
    from traceflow.operators import spectral

    t = np.arange(128)
    wave = np.exp(-(((t - 60) / 6.0) ** 2)) * np.cos((t - 60) / 3.0)
    got = spectral.tie_estimate(wave[None], np.roll(wave, shift)[None], 0.004, 0.032)
    assert abs(abs(got["zdiff"][0, 0]) - 1000 * 0.004 * shift) < 0.5 or abs(abs(got["zdiff"][0, 0]) - 0.004 * shift) < 5e-4
    assert got["quality"][0, 0] > 0.95


def splines(u):
    return np.array([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3]) / 6


def brute_surface(nodes, points, levels):
    """Multilevel B-splines with dense lattices, one point after the other."""
    lo, hi = np.min(nodes, 0), np.max(nodes, 0)
    r, out = np.array([p[3] for p in points]), np.zeros(len(nodes))
    for level in range(levels):
        n = 2**level

        def weights(xy):
            u = (np.array(xy, float) - lo) / (hi - lo) * n
            c = np.minimum(np.floor(u), n - 1).astype(int)
            return slice(c[0], c[0] + 4), slice(c[1], c[1] + 4), np.outer(splines(u[0] - c[0]), splines(u[1] - c[1]))

        top, bottom = np.zeros((n + 3, n + 3)), np.zeros((n + 3, n + 3))
        for (_, x, y, _), v in zip(points, r):
            a, b, w = weights((x, y))
            top[a, b] += w**3 * v / (w * w).sum()
            bottom[a, b] += w * w
        phi = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
        at = lambda xy: (lambda a, b, w: (w * phi[a, b]).sum())(*weights(xy))
        r, out = r - [at(p[1:3]) for p in points], out + [at(k) for k in nodes]
    return out, r


def test_surfaces(spark):
    rng = np.random.default_rng(5)
    points = [(i, float(x), float(y), float(np.sin(x) + y)) for i, (x, y) in enumerate(rng.uniform(0, 9, (60, 2)))]
    nodes = [(x, y) for x in range(10) for y in range(10)]
    df = spark.createDataFrame([*points, (99, None, 1.0, 1.0), (98, 1.0, 1.0, None), (97, 50.0, 1.0, 1.0)], "id long, x double, y double, v double")
    cells = spark.createDataFrame(nodes, "ix long, iy long")
    surface, left = surfaces.multilevel(cells, df, 4)
    want, rest = brute_surface(nodes, points, 4)
    assert {(r.ix, r.iy): r.v for r in surface.collect()} == pytest.approx(dict(zip(nodes, want)), abs=1e-9)
    assert {r.id: r.v for r in left.collect()} == pytest.approx(dict(enumerate(rest)), abs=1e-9)
    got = {(r.ix, r.iy): r.v for r in surfaces.thin_plate(cells, df, [], 3.0, 2, 5, 4).collect()}
    plates = 0
    for (ix, iy), base in zip(nodes, want):
        filled = {}
        for d2, i in sorted(((x - ix) ** 2 + (y - iy) ** 2, i) for i, x, y, _ in points):
            if d2 <= 9:
                sector = min(int((np.degrees(np.arctan2(points[i][2] - iy, points[i][1] - ix)) + 180) // 45), 7)
                filled.setdefault(sector, []).append((d2, i))
        use = [e for v in filled.values() for e in v[:2]] if len(filled) >= 5 else []
        if use:
            x, y = (np.array([points[i][k] for _, i in use]) for k in (1, 2))
            base += surfaces.plate(x, y, rest[[i for _, i in use]], np.array([d for d, _ in use]), 3.0)
            plates += 1
        assert got[ix, iy] == pytest.approx(base, abs=1e-9)
    assert plates > 20


def test_plate_passes_near_its_points():
    x, y, v = np.array([0.0, 3, 0, 3, 1.5]), np.array([0.0, 0, 3, 3, 1.5]), np.array([1.0, 1, 1, 1, 1])
    assert surfaces.plate(x, y, v, (x - 1) ** 2 + (y - 1) ** 2, 10.0) == pytest.approx(1.0)


def test_surface_without_points(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1)], "ix long, iy long")
    none = spark.createDataFrame([], "id long, x double, y double, v double")
    assert [r.v for r in surfaces.thin_plate(cells, none, [], 3.0).collect()] == [None, None]
