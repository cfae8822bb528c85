"""Misties from traces and horizons against direct computation: absent traces, gates, steps, overlaps, corrections."""

import math

import numpy as np

from traceflow.operators import estimation as E
from traceflow.operators import spectral

RNG = np.random.default_rng(11)


def wave(n, dt, at):
    t = np.arange(n) * dt - at
    return (1 - 2 * (math.pi * 25 * t) ** 2) * np.exp(-((math.pi * 25 * t) ** 2))


def test_shift_alone():
    a = RNG.normal(size=(4, 50))
    b = np.roll(a, 3, 1)
    b[:, :3] = 0
    got = E.shift_estimate(a, b, 0.004, 0.04)
    for r in range(4):
        cc = {k: sum(a[r, i] * b[r, i + k] for i in range(50) if 0 <= i + k < 50) for k in range(-11, 11)}
        best = max(range(-10, 10), key=lambda k: cc[k])
        p = (cc[best - 1] - cc[best + 1]) / (2 * cc[best - 1] - 4 * cc[best] + 2 * cc[best + 1])
        assert abs(got["zdiff"][r, 0] - (best + p) * 0.004) < 1e-12 and best == 3
        q = (cc[best] - 0.25 * (cc[best - 1] - cc[best + 1]) * p) / np.linalg.norm(a[r]) / np.linalg.norm(b[r])
        assert abs(got["quality"][r, 0] - min(q, 1)) < 1e-12
    none = E.shift_estimate(np.zeros((1, 8)), a[:1, :8], 0.004, 0.04)
    assert [none[v][0, 0] for v in E.VALUES] == [0, 0, 1, 0]


def test_resampling():
    x = np.array([1.0, 3, 5, 7])
    assert E.resampled(x, 0.1, 0.2, (0.0, 0.8), 0.1).round(9).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 0]
    assert E.resampled(np.zeros(0), 0, 1, (0, 2), 1).tolist() == [0, 0, 0]


def lines(spark):
    """Two lines that cross three others; the trace of one is missing, one has zeros."""
    stations = [("a", i, i + 0.25, 2.5) for i in range(8)] + [("b", i, 2.5, i + 0.25) for i in range(6)] + [("c", i, 5.5, i + 0.25) for i in range(6)] + [("d", i, 6.5, i + 0.25) for i in range(6)]
    stations = spark.createDataFrame(stations, "line string, trcnr long, x double, y double")
    rows = []
    for line, step, at, scale in (("a", 0.004, 0.50, 1.0), ("b", 0.002, 0.51, 2.0), ("d", 0.004, 0.50, 0.0)):
        n = int(1 / step)
        rows += [(line, i, 0.0, step, (scale * wave(n, step, at)).tolist()) for i in range(8)]
    rows[3][4][2] = None
    return stations, spark.createDataFrame(rows, "line string, trcnr long, z0 double, step double, samples array<double>")


def test_lines_by_traces(spark):
    stations, traces = lines(spark)
    for z_only in (False, True):
        got = {(r.line_a, r.line_b): r for r in E.by_traces(stations, traces, gate=(0.3, 0.7), longest=0.05, z_only=z_only, factor=1000.0).collect()}
        assert set(got) == {("a", "b"), ("a", "c"), ("a", "d")}
        r = got["a", "b"]
        assert abs(r.zdiff - 10) < 0.5 and r.quality > 0.99 and abs(r.ampdiff - (1 if z_only else 2)) < 0.1 and abs(r.phasediff) < 3 and (r.trc_a, r.trc_b) == (2, 2)
        assert all([getattr(got[k], v) for v in E.VALUES] == [0, 0, 1, 0] for k in (("a", "c"), ("a", "d")))
    outside = E.by_traces(stations, traces, gate=(2.0, 3.0), longest=0.05).collect()
    assert len(outside) == 3 and all([getattr(r, v) for v in E.VALUES] == [0, 0, 1, 0] for r in outside)
    assert E.by_traces(stations.limit(0), traces, gate=(0.3, 0.7), longest=0.05).count() == 0
    assert E.by_traces(stations, traces, kind="time").count() == 3


def test_overlaps(spark):
    nodes = spark.createDataFrame([(0, 0), (10, 5)], "ix long, iy long")
    path = {"in": [(1, 1), (2, 2), (3, 3)], "out": [(20, 1), (30, 1)], "through": [(-4, 2), (4, 2), (14, 2)], "twice": [(5, 1), (5, 4), (5, 9), (7, 9), (7, 3), (7, 1)], "corner": [(-1, 1), (1, -1)], "still": [(1, 1), (1, 1)]}
    s = spark.createDataFrame([(k, 10 * i, float(x), float(y)) for k, v in path.items() for i, (x, y) in enumerate(v)], "line string, trcnr long, x double, y double")
    got = {(r.line, r.piece): (r.trc1, r.trc2, r.x, r.y) for r in E.overlaps(s, nodes).collect()}
    assert got == {("in", 1): (0, 20, 1, 1), ("through", 1): (10, 20, 0, 2), ("twice", 1): (0, 10, 5, 1), ("twice", 2): (40, 50, 7, 5), ("corner", 1): (10, 10, 0, 0), ("still", 1): (0, 10, 1, 1)}
    assert E.overlaps(s, nodes.limit(0)).count() == 0


def test_volume(spark):
    """A line through a volume: the volume is 8 ms above it and half as strong; one of its traces is missing."""
    stations = spark.createDataFrame([("l", i, i + 0.1, 1.2) for i in range(9)], "line string, trcnr long, x double, y double")
    two = spark.createDataFrame([("l", i, 0.0, 0.004, (2 * wave(250, 0.004, 0.508)).tolist()) for i in range(9)], "line string, trcnr long, z0 double, step double, samples array<double>")
    three = spark.createDataFrame([(x, y, 0.0, 0.004, wave(250, 0.004, 0.5).tolist()) for x in range(6) for y in range(3) if (x, y) != (2, 1)], "ix long, iy long, z0 double, step double, samples array<double>")
    (got,) = E.by_traces(stations, two, three, gate=(0.3, 0.7), longest=0.05, factor=1000.0).collect()
    assert (got.line_a, got.trc_a, got.line_b, got.trc_b) == ("3D", 0, "l", 5) and abs(got.zdiff - 8) < 0.2 and abs(got.ampdiff - 2) < 0.01 and abs(got.phasediff) < 2 and got.quality > 0.99
    (none,) = E.by_traces(stations, two, three, gate=(5.0, 6.0), longest=0.05).collect()
    assert [getattr(none, v) for v in E.VALUES] == [0, 0, 0, 0]
    h2 = spark.createDataFrame([("l", i, 1.0 + i if i != 1 else None) for i in range(9)], "line string, trcnr long, z double")
    h3 = spark.createDataFrame([(x, y, 0.5 * x) for x in range(6) for y in range(3)], "ix long, iy long, z double")
    for step, numbers in ((1, [0, 2, 3, 4]), (2, [0, 2]), (9, [2])):
        (r,) = E.by_horizons(stations, h2, h3, step=step, factor=10.0).collect()
        assert abs(r.zdiff - 10 * np.mean([1 + i - 0.5 * i for i in numbers])) < 1e-9 and (r.ampdiff, r.quality) == (1, 1)


def test_corrections_of_traces(spark):
    x = RNG.normal(size=(3, 40))
    x[2, 5] = np.nan
    rows = [(k, 0.002, [None if np.isnan(v) else float(v) for v in r]) for k, r in zip("abc", x)] + [("a", 0.002, [1.0, 2.0, 3.0]), ("b", 0.002, [])]
    df = spark.createDataFrame(rows, "line string, step double, samples array<double>")
    cor = spark.createDataFrame([("a", 0.003, 40.0, 1.5), ("b", 0.0, 180.0, 2.0)], "line string, shift double, phase double, amp double")
    got = {(r.line, len(r.samples)): np.array(r.samples) for r in E.apply_corrections(df, cor, ["line"]).collect()}
    moved = np.array([np.interp(i - 1.5, np.arange(40), x[0], left=0) for i in range(40)])
    turned = [sum(2 / (math.pi * k) * (0.54 + 0.46 * math.cos(math.pi * k / 30)) * moved[i - k] for k in range(-30, 31) if k % 2 and 0 <= i - k < 40) for i in range(40)]
    assert np.allclose(got["a", 40], 1.5 * (moved * math.cos(math.radians(40)) - np.array(turned) * math.sin(math.radians(40))))
    assert np.allclose(got["b", 40], -2 * x[1]) and np.allclose(got["c", 40], np.nan_to_num(x[2])) and len(got["b", 0]) == 0 and ("a", 3) in got
    plain = {(r.line, len(r.samples)): np.array(r.samples) for r in E.apply_corrections(df, cor, ["line"], shift=False, phase=False).collect()}
    assert np.allclose(plain["a", 40], 1.5 * x[0]) and np.allclose(plain["b", 40], 2 * x[1])
    t = np.arange(400) * 0.002
    c = np.cos(2 * np.pi * 40 * t)[None]
    z = spectral.analytic(c)
    by = E.corrected(c, np.zeros(1), np.array([60.0]), np.ones(1), np.array([0.002]))
    want = z.real * math.cos(math.radians(60)) - z.imag * math.sin(math.radians(60))
    assert np.abs(by - want)[0, 60:-60].max() < 0.02


def test_histogram(spark):
    df = spark.createDataFrame([(0.5, -1.0), (0.9, None), (-0.1, 7.0), (None, 7.5)], "a double, b double")
    got = sorted(tuple(r) for r in E.histogram(df, {"a": 0.5, "b": 5.0}).collect())
    assert got == [("a", -1, -0.5, 1), ("a", 1, 0.5, 2), ("b", -1, -5.0, 1), ("b", 1, 5.0, 2)]
