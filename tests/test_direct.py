"""Spectral attributes, hulls, simplified lines and small helpers against direct computation from their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.operators import geometry, spectral, volumes

RNG = np.random.default_rng(21)


def direct_analytic(x):
    """Twice the positive frequencies, by sums."""
    n = len(x)
    spectrum = [sum(x[t] * np.exp(-2j * np.pi * k * t / n) for t in range(n)) for k in range(n)]
    w = [1 if k == 0 or 2 * k == n else 2 if 2 * k < n else 0 for k in range(n)]
    return np.array([sum(w[k] * spectrum[k] * np.exp(2j * np.pi * k * t / n) for k in range(n)) / n for t in range(n)])


@pytest.mark.parametrize("n", [1, 2, 9, 16])
def test_analytic_signal(n):
    x = RNG.normal(size=(2, n))
    got = spectral.analytic_signal(x)
    for r in range(2):
        z = direct_analytic(x[r])
        for name, want in (("real", z.real), ("imaginary", z.imag), ("envelope", np.abs(z))):
            assert np.allclose(got[name][r], want)
        assert np.allclose(np.abs(z) * np.exp(1j * np.radians(got["phase"][r])), z)
        if n < 3:
            continue  # of two samples the step is half a turn, either way
        f = spectral.instantaneous_frequency(x, 0.004)[r]
        for t in range(n - 1):
            step = np.angle(z[t + 1] * np.conj(z[t]))
            assert abs(f[t] - (step + np.pi * (step < 0)) / (2 * np.pi * 0.004)) < 1e-6
        assert f[-1] == f[-2]


def test_recursive_spectrum():
    """The sum of the responses forward and, conjugated, backward: convolutions with s^4 t^3 / 6 exp((-s + 2 pi i f) t)."""
    dt, window, step, count, n = 0.004, 0.08, 12.0, 5, 50
    x = RNG.normal(size=(2, n))
    s = 6 * math.sqrt(2 / window) / (math.sqrt(2 * math.pi * dt) * 27 * math.exp(-3))
    t = np.arange(n) * dt
    got = spectral.recursive_spectrum(x, dt, window, step, count)
    for r in range(2):
        for k in range(count):
            h = dt * s**4 * t**3 / 6 * np.exp((-s + 2j * np.pi * step * (k + 1)) * t)
            want = np.convolve(x[r], h)[:n] + np.convolve(x[r, ::-1], np.conj(h))[:n][::-1]
            assert np.allclose(got[r, k], np.abs(want))


def test_tie_estimate():
    n, dt, longest = 24, 0.004, 0.03
    a, b = RNG.normal(size=(3, n)), RNG.normal(size=(3, n))
    got = spectral.tie_estimate(a, b, dt, longest)
    for r in range(3):
        cc = np.zeros(2 * n)
        for k in range(-n + 1, n):
            cc[k % (2 * n)] = sum(a[r, i] * b[r, i + k] for i in range(n) if 0 <= i + k < n)
        z = direct_analytic(cc)
        e = np.abs(z)
        most = int(longest / dt)
        best = max([*range(most), *range(-most, 0)], key=lambda k: e[k % (2 * n)])
        m, l, h = (e[(best + d) % (2 * n)] for d in (0, -1, 1))
        p = (l - h) / (2 * l - 4 * m + 2 * h)
        na, nb = np.linalg.norm(a[r]), np.linalg.norm(b[r])
        assert abs(got["zdiff"][r, 0] - (best + p) * dt) < 1e-9 and abs(got["ampdiff"][r, 0] - nb / na) < 1e-9
        assert abs(got["quality"][r, 0] - min(1, (m - 0.25 * (l - h) * p) / (na * nb))) < 1e-9
        p0, p1 = np.angle(z[best % (2 * n)]), np.angle(z[(best + (1 if p >= 0 else -1)) % (2 * n)])
        turn = (p1 - p0 + np.pi) % (2 * np.pi) - np.pi
        assert abs(got["phasediff"][r, 0] - math.degrees(p0 + abs(p) * turn)) < 1e-6


def test_local_correlation():
    n, half, lags = 20, 3, 2
    a, b = RNG.normal(size=(2, n)), RNG.normal(size=(2, n))
    got = spectral.local_correlation(a, b, half, lags)
    for r in range(2):
        for t in range(n):
            cc = []
            for k in range(-lags, lags + 1):
                at = [i for i in range(t - half, t + half + 1) if 0 <= i < n]
                m = [b[r, i + k] if 0 <= i + k < n else 0.0 for i in at]
                den = math.sqrt(sum(a[r, i] ** 2 for i in at) * sum(v * v for v in m))
                cc.append(sum(a[r, i] * v for i, v in zip(at, m)) / den if den else 0.0)
            best = max(range(len(cc)), key=lambda i: (round(cc[i], 12), -i))
            if best in (0, 2 * lags):
                assert got["shift"][r, t] == 0 and got["quality"][r, t] == 0
                continue
            l, m, h = cc[best - 1 : best + 2]
            p = (l - h) / (2 * l - 4 * m + 2 * h)
            assert abs(got["shift"][r, t] - (best - lags + p)) < 1e-9 and abs(got["quality"][r, t] - min(max(m - 0.25 * (l - h) * p, 0), 1)) < 1e-9


def test_triangle_and_local_frequency():
    x = RNG.normal(size=(1, 12))
    got = spectral.triangle_smooth(x, 3)
    at = lambda i: x[0, -1 - i if i < 0 else 23 - i if i > 11 else i]
    assert np.allclose(got[0], [sum(w * at(i + k) for k, w in zip(range(-2, 3), (1, 2, 3, 2, 1))) / 9 for i in range(12)])
    assert spectral.triangle_smooth(x, 1) is x
    t = (7 + np.arange(12)) * 0.004
    s, c = np.sin(2 * np.pi * 20 * t)[None], np.cos(2 * np.pi * 20 * t)[None]
    want = np.hypot(spectral.smooth_division(x, s, 3), spectral.smooth_division(x, c, 3))
    assert np.allclose(spectral.local_time_frequency(x, 0.004, 7, 20.0, 3), want)


def test_convex_hull(spark):
    rng = random.Random(6)
    for pts in ([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(400)], [(i, 2 * i) for i in range(5)], [(3, 3)] * 4, [(0, 0), (4, 0), (4, 4), (0, 4), (2, 0), (2, 2)]):
        got = [(r.x, r.y) for r in geometry.convex_hull(spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double").repartition(7)).orderBy("seq").collect()]
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        corners = {p for p in set(pts) if len(set(pts)) < 3 or any(all(cross(p, q, o) > 0 or (cross(p, q, o) == 0 and (o[0] - p[0]) * (q[0] - p[0]) + (o[1] - p[1]) * (q[1] - p[1]) > 0) for o in set(pts) - {p, q}) for q in set(pts) - {p})}
        assert set(got) == {(float(x), float(y)) for x, y in corners} and len(got) == len(set(got))
        if len(got) > 2:
            assert all(cross(got[i], got[(i + 1) % len(got)], p) >= 0 for i in range(len(got)) for p in pts)


def test_simplified_lines(spark):
    rng = random.Random(7)
    rows = [(k, i, i + rng.uniform(-0.3, 0.3), math.sin(i / 3) * 4, rng.uniform(-2, 2)) for k in "ab" for i in range(30)] + [("c", 0, 1.0, 1.0, 1.0), ("d", 0, 1.0, 1.0, 1.0), ("d", 1, 1.0, 1.0, 1.0)]
    tolerances = (0.5, 0.8, 2.5)
    got = {}
    for r in geometry.simplified(spark.createDataFrame(rows, "k string, n int, x double, y double, z double"), "k", "n", tolerances).collect():
        got.setdefault(r.k, set()).add(r.n)

    def split(p, a, z):
        off = []
        for i in range(a + 1, z):
            chord = p[z] - p[a]
            t = min(max((p[i] - p[a]) @ chord / max(chord @ chord, 1e-300), 0), 1)
            off.append(np.abs(p[i] - p[a] - t * chord).max())
        if not off or max(off) <= 1:
            return set()
        k = a + 1 + off.index(max(off))
        return {k} | split(p, a, k) | split(p, k, z)

    for k in "abcd":
        p = np.array([r[2:] for r in rows if r[0] == k]) / np.array(tolerances)
        assert got[k] == {0, len(p) - 1} | split(p, 0, len(p) - 1)


def test_small_helpers(spark):
    assert volumes.default_gate(0.004, 0.0279) == pytest.approx((-0.028, 0.028))
    assert volumes.component_names(0.004, 25.0) == ["25 Hz", "50 Hz", "75 Hz", "100 Hz"]
    assert volumes.displayed_frequency(0.1, 125.0, False) == 0.5 and volumes.displayed_frequency(100.0, 125.0, True) == 62500.0
    df = spark.createDataFrame([(0,), (3,), (9,)], "m int")
    assert [r.k for r in df.select(volumes.mode_index(F.col("m"), 5).alias("k")).collect()] == [0, 3, 4]
