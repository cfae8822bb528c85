"""Recursive filters, reassignment, empirical modes, peaks, warps and equalisation against direct computation."""

import math

import numpy as np
import pytest

from traceflow.functions import kernels3d
from traceflow.operators import decomposition as D
from traceflow.operators import picks as P
from traceflow.operators.stencil import Tile

RNG = np.random.default_rng(5)


def test_iir_is_its_recursion():
    x, num, den = RNG.normal(size=(3, 30)), RNG.normal(size=(2, 4)) * 0.3, RNG.normal(size=(2, 2)) * 0.3
    got = D.iir(x, num, den)
    for r in range(3):
        for f in range(2):
            y = []
            for t in range(30):
                y.append(sum(num[f, j] * x[r, t - j] for j in range(4) if t >= j) - sum(den[f, j] * y[t - 1 - j] for j in range(2) if t > j))
            assert np.allclose(got[r, f], y)


def test_highpass_and_back():
    num, den = D.butterworth_highpass(0.2)
    response = lambda w: abs(np.polyval(num[::-1], np.exp(-1j * w)) / np.polyval(np.append(1, den)[::-1], np.exp(-1j * w)))
    assert response(0) < 1e-12 and abs(response(0.2 * math.pi) - math.sqrt(0.5)) < 1e-12 and abs(response(math.pi) - 1) < 1e-12
    flat = np.full((1, 40), 3.0)
    assert np.abs(D.forward_backward(flat, num, den)).max() < 1e-12  # a constant has no transient
    x = RNG.normal(size=(2, 50))
    assert np.allclose(D.forward_backward(x, num, den)[:, ::-1].shape, x.shape)
    low = (np.array([0.5, 0.5]), np.array([0.0]))
    line = np.arange(20.0)[None]
    assert np.allclose(D.forward_backward(line, *low)[0, 1:-1], line[0, 1:-1])  # no delay


def test_reassigned_against_direct_convolution():
    dt, step, count, n = 0.004, 10.0, 8, 60
    x = RNG.normal(size=(2, n))
    s = 6 * math.sqrt(step) / (math.sqrt(2 * math.pi * dt) * 27 * math.exp(-3))
    t = np.arange(n) * dt
    want = np.zeros((2, count, n))
    for r in range(2):
        for k in range(count):
            p = -s + 2j * math.pi * step * (k + 1)
            h = dt * s**4 * t**3 / 6 * np.exp(p * t)
            dh = dt * s**4 * (t**2 / 2 + p * t**3 / 6) * np.exp(p * t)
            w, wd, wt = (np.convolve(x[r], g)[:n] for g in (h, dh, t * h))
            for i in range(n):
                e = w[i] + 1e-10 * (1 + 1j)
                away = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))
                z = min(max(i - away((wt[i] / e).real / dt), 0), n - 1)
                f = min(max(away(((wd[i] / e).imag / (2 * math.pi) - step) / step), 0), count - 1)
                want[r, f, z] += abs(w[i])
    assert np.abs(D.reassigned(x, dt, step, count) - want).max() < 1e-8


def test_reassigned_ridge_of_a_chirp():
    dt, n = 0.002, 600
    t = np.arange(n) * dt
    x = np.cos(2 * np.pi * (20 * t + 20 * t * t))[None]  # 20 + 40 t
    got = D.reassigned(x, dt, 2.0, 60)[0]
    ridge = (np.argmax(got, 0) + 1) * 2.0
    inside = slice(120, 480)
    assert np.abs(ridge - (20 + 40 * t))[inside].mean() < 3
    spread = (got[:, inside] > 0.05 * got[:, inside].max(0)).sum(0).mean()
    assert spread < 8
    late = D.at_gate(got[None], (0.008, 0.012), dt)[0]
    assert np.array_equal(late[:, :-5], got[:, 5:]) and np.isnan(late[:, -5:]).all()


# The published test vector of the segmentation.
AMPLITUDES = [1.0, 1.5, 1.8, 0.5, 4.0, 5.0, 3.0, 1.0, 0.5, 1.0, 3.0, 1.5, 0.5, 1.0, 1.5, 3.0, 4.0, 2.0, 1.0, 0.5, 0.5, 0.4, 0.4]


def test_segments():
    spectrum = np.zeros((2, 44), complex)
    spectrum[0, :23] = AMPLITUDES
    d = D.Decomposition.of_spectrum(spectrum, 10)
    assert d.bounds[0, :5].tolist() == [0, 3, 8, 12, 22] and d.rank[0, :5].tolist() == [5, 16, 10, 2, -1]
    assert np.allclose(d.central()[0, :4], np.array([2, 5, 10, 16]) * 2 * np.pi / 44) and np.isnan(d.central()[0, 4:]).all()
    assert d.count.tolist() == [4, 0]
    two = D.Decomposition.of_spectrum(spectrum, 2)
    assert two.peaks[0].tolist() == [5, 16] and two.bounds[0].tolist() == [0, 8, 22]  # the lowest of the first of equals


@pytest.mark.parametrize("pad", ["none", "one_sided", "mirror", "symmetric"])
@pytest.mark.parametrize("n", [40, 41])
def test_modes(pad, n):
    x = RNG.normal(size=(6, n))
    d = D.Decomposition(x, 100, pad)
    every = sum(np.nan_to_num(d.mode(m)) for m in range(100))
    assert np.abs(every - x).max() < 1e-9  # all bands together are the trace
    few = D.Decomposition(x, 3, pad)
    for m in range(3):
        f, a = few.frequency(m, 0.004)
        assert np.allclose(a, np.abs(few.analytic(m))) and (f >= 0).all() and (f[:, -2:] == 0).all()
        assert any(np.allclose(few.by_rank(r)[0], few.mode(m)[0]) for r in range(3))


def test_mode_signal():
    t = np.linspace(0, 1, 1001)
    x = (np.cos(900 * np.pi * t) + 2 * np.cos(8 * np.pi * t) + 5 * np.cos(40 * np.pi * t))[None]
    d = D.Decomposition(x, 3, "none")
    assert np.abs(np.sort(d.central()[0]) / (2 * np.pi * 0.001) - [4, 20, 450]).max() < 1
    assert np.abs(d.by_rank(0)[0] - 5 * np.cos(40 * np.pi * t))[200:800].max() < 0.5
    f, a = d.frequency(1, 0.001)
    assert np.abs(f[0, 200:800] - 20).max() < 2 and np.abs(a[0, 200:800] - 5).max() < 0.5
    fe, ae = d.energy_frequency(1, 0.001)
    assert abs(np.median(fe[0, 200:800]) - 20) < 1 and abs(np.median(ae[0, 200:800]) - 5) < 0.3
    by = d.spectrum_by_frequency(0.001, 5.0, 100)[0]
    want = np.zeros((100, 1001))
    for m in range(3):
        f, a = d.frequency(m, 0.001)
        for z in range(1001):
            for k in range(100):
                if (k + 1) * 5 - 2.5 <= f[0, z] < (k + 1) * 5 + 2.5:
                    want[k, z] += a[0, z]
    assert np.allclose(by, want)
    line = np.linspace(1, 9, 50)[None]
    assert np.abs(D.Decomposition(line, 2, deramp=True).spectrum).max() < 1e-9
    assert D.Decomposition(line, 2, taper=5).n == 50 and np.isnan(D.Decomposition(np.zeros((1, 9)), 2).mode(0)).all()


def test_circular_kernels():
    def j1(x):  # its integral
        t = (np.arange(20000) + 0.5) * np.pi / 20000
        return np.cos(t - x * np.sin(t)).mean()

    for x in (0.0, 0.3, 2.0, 7.5, 11.9, 12.1, 30.0, 80.0):
        assert abs(kernels3d.bessel_j1(np.array([x]))[0] - j1(x)) < 1e-9
    k = kernels3d.circular("low", 9, 0.5)
    assert k.shape == (9, 9) and abs(k.sum() - 1) < 1e-12 and np.allclose(k, k.T) and np.allclose(k, k[::-1]) and (k[0] == 0).all()  # a half size of 4 is filled with one of 3
    df = lambda n: math.prod(range(n, 0, -2))
    raw = lambda m, n: df(3) ** 4 * math.pi ** (m % 2 + n % 2) * 0.5 * j1(math.pi * 0.5 * math.hypot(m, n)) / (2 ** (m % 2 + n % 2 + 1) * df(3 + m) * df(3 - m) * df(3 + n) * df(3 - n) * math.hypot(m, n))
    small = kernels3d.circular("low", 7, 0.5)
    assert abs(small[3, 5] / small[3, 4] - raw(2, 0) / raw(1, 0)) < 1e-8 and abs(small[6, 5] / small[3, 4] - raw(3, 2) / raw(1, 0)) < 1e-8
    high, stop, band = (kernels3d.circular(t, 7, 0.5) for t in ("high", "reject", "band"))
    one = np.zeros((7, 7))
    one[3, 3] = 1
    assert np.allclose(high + small, one) and np.allclose(stop + band, one)
    assert np.allclose(stop, kernels3d.circular("low", 7, 0.4) + kernels3d.circular("high", 7, 0.6))


def test_monotone_cubic():
    x, y = np.array([0.0, 1, 3, 4, 7]), np.array([0.0, 2, 2.5, -1, -1])
    at = np.linspace(0, 7, 200)
    got = P.monotone_cubic(x, y, at)
    assert np.allclose(P.monotone_cubic(x, y, x), y)
    for a, b, u, v in zip(x, x[1:], y, y[1:]):
        seg = got[(at >= a) & (at <= b)]
        assert seg.min() >= min(u, v) - 1e-12 and seg.max() <= max(u, v) + 1e-12
    # by hand: the slope at 1 is 3 * 3 / (5 / 2 + 4 / 0.25) with spacings 1 and 2
    eps = 1e-6
    slope = (P.monotone_cubic(x, y, np.array([1 + eps]))[0] - 2) / eps
    assert abs(slope - 9 / (5 / 2 + 4 / 0.25)) < 1e-4
    assert np.allclose(P.monotone_cubic(np.array([0.0, 2]), np.array([1.0, 5]), np.array([0.5, 1])), [2, 3])


def test_signed_envelope():
    assert P.local_maxima(np.array([0.0, 1, 1, 1, 0, 2, 3, 3])).tolist() == [2]
    t = np.arange(200)
    x = np.stack([np.exp(-(((t - 60) / 12) ** 2)) - np.exp(-(((t - 140) / 12) ** 2)), np.zeros(200)])
    got = P.signed_envelope(x)
    assert got[0, 60] > 0.5 and got[0, 140] < -0.5 and got[0, 0] == 0 and got[0, -1] == 0 and (got[1] == 0).all()
    assert (P.signed_envelope(np.array([[1.0, 2.0]])) == 0).all()


@pytest.mark.parametrize("band", [None, 3])
def test_warp(band):
    for n, m in ((1, 1), (1, 5), (7, 4), (12, 12)):
        a, b = RNG.integers(0, 4, (9, n)).astype(float), RNG.integers(0, 4, (9, m)).astype(float)
        got = P.warped(a, b, band)
        for r in range(9):
            cost, came = {}, {}
            for i in range(n):
                for j in range(m):
                    if band is not None and abs(i - j) > band + abs(n - m):
                        continue
                    ways = [(cost.get(k, math.inf), w, k) for w, k in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1)))]
                    best = min(ways) if (i, j) != (0, 0) else (0, 0, None)
                    cost[i, j], came[i, j] = best[0] + (a[r, i] - b[r, j]) ** 2, best[2]
            at, want = (n - 1, m - 1), {}
            while at is not None:
                want.setdefault(at[1], at[0])
                at = came[at]
            assert got[r].tolist() == [want[j] for j in range(m)]
    v = P.warp_velocity(np.arange(10.0)[None], np.arange(10.0)[None])
    assert np.isnan(v[0, 0]) and (v[0, 1:] == 2000).all()


def test_wavelet_peaks():
    t = np.arange(300)
    x = sum(h * np.exp(-(((t - c) / w) ** 2)) for h, c, w in ((3, 50, 6), (2, 120, 9), (4, 220, 5)))[None] + 0.01 * np.sin(t * 1.7)[None]
    got = np.flatnonzero(P.wavelet_peaks(x, list(range(1, 17)))[0])
    assert all(np.abs(got - c).min() <= 3 for c in (50, 120, 220))
    w = P.wavelet_transform(x, [4])[0, 0]
    assert np.allclose(w, np.convolve(x[0], P.mexican_hat(40, 4), "same"))
    w = P.wavelet_transform(x[:, :50], [9])[0, 0]
    assert np.allclose(w, np.convolve(x[0, :50], P.mexican_hat(50, 9), "same"))
    assert (P.wavelet_peaks(np.zeros((2, 40)), [1, 2, 3]) == 0).all()


def test_equalisation_of_a_section():
    assert np.allclose(P.clipped(np.array([[9, 1, 0, 2]]), np.array([4.0])), [[4, 3, 1.5, 3.5]]) or np.isclose(P.clipped(np.array([[9, 1, 0, 2]]), np.array([4.0])).sum(), 12)
    samples = RNG.normal(size=(5, 5, 40))
    tile = Tile(samples, np.ones((5, 5), bool), 1)
    got = P.adaptive_equalisation(tile, 0.004, 1, 15, 0.1)
    for x in range(3):
        for y in range(3):
            block, own, out = samples[x : x + 3, y : y + 3], samples[x + 1, y + 1], np.zeros(40)
            for sign in (1, -1):
                part = np.maximum(sign * block, 0)
                top = part.max()
                windows = [(0, 15), (15, 30), (30, 40)]
                ranks = []
                for a, z in windows:
                    h = np.histogram(part[:, :, a:z] / top, 256, (0, 1))[0].astype(float)
                    limit = max(0.1 * h.sum(), 1)
                    left = (h - limit).clip(0).sum()
                    h = h.clip(max=limit)
                    while left > 1e-12 and (h < limit).any():
                        h[h < limit] += left / (h < limit).sum()
                        left = (h - limit).clip(0).sum()
                        h = h.clip(max=limit)
                    ranks.append(np.cumsum(h) / h.sum())
                for z in range(40):
                    v = min(int(max(sign * own[z], 0) / top * 256), 255)
                    middles = [(a + b - 1) / 2 for a, b in windows]
                    out[z] += sign * top * np.interp(z, middles, [r[v] for r in ranks])
            num, den = D.butterworth_highpass(2.0 * 2 * 0.004)
            assert np.allclose(got[x, y], D.forward_backward(out[None], num, den)[0], atol=1e-9)
