"""Dips and tensor measures of planes and of hand-made eigenvalues, vector filters by brute force, curvature of a sphere."""

import numpy as np
import pytest

from traceflow.functions import kernels3d as K
from traceflow.operators import dips as D
from traceflow.operators import decomposition, polynomials, structure
from traceflow.operators.stencil import Tile, along_z

RNG = np.random.default_rng(9)


def tile(fn, h, side=3, n=40, there=None):
    x, y, z = np.meshgrid(np.arange(side + 2 * h, dtype=float), np.arange(side + 2 * h, dtype=float), np.arange(n, dtype=float), indexing="ij")
    return Tile(fn(x, y, z), np.ones(x.shape[:2], bool) if there is None else there, h)


def test_measures_of_eigenvalues():
    got = D.tensor_measures(3.0, 2.0, 1.0)
    want = {"cline": 1 / 3, "cplane": 1 / 5, "planarity": 1 / 3, "coherency": 1 / 25, "cfault": 1 / 3 * 4 / 5, "cchaos": 4 * 3 * 1 * 6 / 16, "ctype": (1 + 1 + 4) / 14}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    q, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    t = q @ np.diag([3.0, 2.0, 1.0]) @ q.T
    full = D.of_tensor(*(np.array([v]) for v in (t[0, 0], t[1, 1], t[2, 2], t[0, 1], t[0, 2], t[1, 2])), inl_factor=0.5, crl_factor=2.0)
    assert all(abs(full[k][0] - v) < 1e-9 for k, v in want.items())
    assert abs(full["inl_dip"][0] + q[0, 0] / q[2, 0] * 0.5) < 1e-9 and abs(full["crl_dip"][0] + q[1, 0] / q[2, 0] * 2) < 1e-9
    assert abs(full["true_dip"][0] - np.hypot(full["inl_dip"][0], full["crl_dip"][0])) < 1e-12
    shapes = structure._shapes(tuple(np.array([v]) for v in (t[0, 0], t[1, 1], t[2, 2], t[0, 1], t[0, 2], t[1, 2])))
    assert abs(shapes["cfault"][0] - 4 / 15) < 1e-9 and abs(shapes["coherency"][0] - 1 / 25) < 1e-9


@pytest.mark.parametrize("points", [3, 5])
def test_tensor_of_a_plane(points):
    t = tile(lambda x, y, z: np.sin(0.3 * (z + 0.5 * x - 0.25 * y)), points // 2 + 1)
    got = D.gradient_tensor(t, points, inl_factor=2.0)
    mid = (slice(None), slice(None), slice(5, 35))
    assert np.abs(got["inl_dip"][mid] + 1.0).max() < 0.02 and np.abs(got["crl_dip"][mid] - 0.25).max() < 0.02 and got["coherency"][mid].min() > 0.9


def test_tensor_by_brute_force():
    """One sample near a trace's end, from the definition: 5-point gradients of the reflected block, products, Gaussian, eigenvalues."""
    t = tile(lambda x, y, z: RNG.normal(size=x.shape), 3, side=1, n=12)
    got = D.gradient_tensor(t, 5)
    s = np.pad(t.samples, ((0, 0), (0, 0), (9, 9)), mode="symmetric")

    def grad(x, y, z):
        block = s[x - 2 : x + 3, y - 2 : y + 3, z + 9 - 2 : z + 9 + 3]
        d, w = K.FARID5_D, K.FARID5_S
        return np.array([np.einsum("ijk,i,j,k", block, a, b, c) for a, b, c in ((d, w, w), (w, d, w), (w, w, d))])

    g = K.gaussian(3)
    for z in (0, 1, 6, 11):
        tensor = np.zeros((3, 3))
        for i in range(3):
            for j in range(3):
                for k in range(3):
                    at = z + k - 1
                    at = -1 - at if at < 0 else 23 - at if at > 11 else at
                    v = grad(2 + i, 2 + j, at)
                    tensor += g[i] * g[j] * g[k] * np.outer(v, v)
        e = np.linalg.eigvalsh(tensor)[::-1]
        assert np.allclose([got[f"e{i + 1}"][0, 0, z] for i in range(3)], e)
        assert abs(got["coherency"][0, 0, z] - ((e[0] - e[1]) / (e[0] + e[1])) ** 2) < 1e-9


def test_phase_dips_of_a_plane():
    t = tile(lambda x, y, z: np.cos(0.9 * (z + 0.4 * x + 0.2 * y)), 2, n=80)
    for got in (D.phase(t), D.phase_tensor(t), D.phase_tensor(t, weighted=False), D.filtered_phase(t, "mean"), D.filtered_phase(t, "l2", half_z=1)):
        mid = got["inl_dip"].shape[2] // 2
        assert np.abs(got["inl_dip"][:, :, mid] + 0.4).max() < 0.03 and np.abs(got["crl_dip"][:, :, mid] + 0.2).max() < 0.03
    assert D.phase_tensor(t)["cplane"][1, 1, 40] > 0.99
    taps = D.analytic_taps(15, 0.9)
    w = np.exp(-1j * np.outer(np.linspace(-np.pi, np.pi, 81), np.arange(-15, 16))) @ taps
    assert abs(abs(w[60]) - 2) < 0.02 and abs(w[20]) < 0.02  # twice the middle of the positive frequencies, nothing of the negative


@pytest.mark.parametrize("kind", ["mean", "l1", "l2", "x3"])
def test_vector_filter(kind):
    h, half, n = 1, 2, 9
    there = np.ones((5, 5), bool)
    there[1, 2] = False
    t = Tile(np.zeros((5, 5, n)), there, 2)
    v = np.stack([np.where(there[1:-1, 1:-1, None][..., :] if False else np.ones((5, 5, 1), bool), RNG.normal(size=(5, 5, n)), 0)[:3, :3] for _ in range(3)])
    got = D.vector_filter(Tile(np.zeros((3, 3, n)), np.ones((3, 3), bool), 1), tuple(v), kind, h, half)
    dist = {"l1": lambda d: np.abs(d).sum(), "l2": lambda d: (d * d).sum(), "x3": lambda d: np.abs(d).sum() + np.abs(d).max()}
    for z in range(n):
        c = min(max(z, half), n - half - 1)
        members = [v[:, i, j, c + k] for i in range(3) for j in range(3) for k in range(-half, half + 1)]
        want = np.mean(members, 0) if kind == "mean" else min(members, key=lambda m: round(sum(dist[kind](m - o) for o in members), 12))
        assert np.allclose([g[0, 0, z] for g in got], want)
    assert all(np.isnan(g).all() for g in D.vector_filter(Tile(np.zeros((3, 3, 4)), np.ones((3, 3), bool), 1), tuple(v[..., :4]), kind, h, half))
    assert t.nx == 1


def test_filtered_dips_of_a_constant():
    a, b = tile(lambda x, y, z: 0.3 + 0 * x, 1), tile(lambda x, y, z: -0.2 + 0 * x, 1)
    for kind in ("mean", "l1", "l2"):
        got = D.filtered_dips(a, b, kind, inl_factor=0.5, crl_factor=0.8)
        assert np.allclose(got["inl_dip"], 0.3) and np.allclose(got["crl_dip"], -0.2)
    g = D.of_gradients(*(tile(lambda x, y, z, c=c: c + 0 * x, 1) for c in (0.5, -0.25, 1.0)))
    assert np.allclose(g["inl_dip"], -0.5) and np.allclose(g["crl_dip"], 0.25)
    assert np.allclose(D.rank_one(*(np.array([v]) for v in (0.5, -0.25, 1.0)))["inl_dip"], -0.5)


def test_reflection():
    x = np.arange(5.0)[None]
    assert along_z(x, [1.0, 0, 0], "reflect").tolist() == [[0, 0, 1, 2, 3]] and along_z(x, [0, 0, 1.0], "reflect").tolist() == [[1, 2, 3, 4, 4]]
    assert along_z(x, [1.0, 0, 0]).tolist() == [[0, 0, 1, 2, 3]] and along_z(x, [0, 0, 1.0]).tolist() == [[1, 2, 3, 4, 0]]


def test_curvature_of_spheres_and_cylinders():
    p = RNG.normal(size=(20, 3)) + [0, 0, 4]
    x, y, z = p.T
    # normals (x, y, z) / z of spheres around the origin
    got = K.shape_curvatures(x / z, y / z, 1 / z, 0 * z, -x / z**2, 0 * z, 1 / z, -y / z**2)
    r = np.sqrt((p * p).sum(1))
    assert np.allclose(got["mean"], -1 / r) and np.allclose(got["gauss"], 1 / r**2) and np.allclose(got["kmin"], got["kmax"], atol=1e-6)
    r = np.hypot(x, z)
    got = K.shape_curvatures(x / z, 0 * z, 1 / z, 0 * z, -x / z**2, 0 * z, 0 * z, 0 * z)
    assert np.allclose(got["mean"], -0.5 / r) and np.allclose(got["gauss"], 0, atol=1e-12) and np.allclose(got["kmin"], -1 / r, atol=1e-6) and np.allclose(got["kmax"], 0, atol=1e-6)


def test_polynomial_fits():
    """A polynomial gives its own coefficients (odd ones turned), at every size; ends are zero."""
    want = [0.5, 1.0, -2.0, 0.25, 0.1, -0.3, 0.2, 0.4, -0.6, 0.7]
    for sizes in ((3, 3, 3), (3, 3, 5), (5, 3, 7)):
        h = max(sizes[0], sizes[1]) // 2

        def f(x, y, z, h=h):
            x, y, z = x - h, y - h, z - 10
            terms = [1, x, y, z, x * x, y * y, z * z, x * y, x * z, y * z]
            return sum(a * t for a, t in zip(want, terms)) + 0 * x

        t = tile(f, h, side=1, n=21)
        got = [c[0, 0] for c in polynomials.coefficients(t, sizes)]
        sign = [1, -1, -1, -1, 1, 1, 1, 1, 1, 1]
        assert np.allclose([g[10] for g in got], [s * w for s, w in zip(sign, want)])
        assert all((g[: sizes[2] // 2] == 0).all() and (g[-(sizes[2] // 2) :] == 0).all() for g in got)
        shape = polynomials.shapes(t, sizes)
        b = np.array([-1.0, 2.0, -0.25])
        a = np.array([[0.1, 0.2, -0.3], [0.2, -0.3, 0.35], [-0.3, 0.35, 0.2]])
        e = np.linalg.eigvalsh(a @ a.T + np.outer(b, b) / (8 * ((min(sizes) - 1) * 0.2) ** 2))[::-1]
        assert np.allclose([shape[f"e{i + 1}"][0, 0, 10] for i in range(3)], e)
        d = polynomials.tensor_dips(t, "first", sizes, inl_factor=0.5)
        assert abs(d["inl_dip"][0, 0, 10] - -b[0] / b[2] * 0.5) < 1e-6
        v = np.linalg.eigh(4 * a @ a.T)[1][:, -1]
        assert abs(polynomials.tensor_dips(t, "second", sizes)["crl_dip"][0, 0, 10] - -v[1] / v[2]) < 1e-6


def test_polynomial_norms():
    t = tile(lambda x, y, z: RNG.normal(size=x.shape), 1, side=2, n=80)
    c = polynomials.coefficients(t)
    g = c[1] ** 2 + c[2] ** 2 + c[3] ** 2
    share = polynomials.tensor_dips(t, "minmax")["weight"]
    assert np.allclose(share, (g - g.min(-1, keepdims=True)) / (g.max(-1, keepdims=True) - g.min(-1, keepdims=True)))
    moving = polynomials.tensor_dips(t, "dynamic")["weight"]
    for z in (0, 10, 40, 79):
        m = min(max(z, 25), 54)
        w = g[..., m - 25 : m + 26]
        assert np.allclose(moving[..., z], (g[..., z] - w.min(-1)) / (w.max(-1) - w.min(-1)))
    with pytest.raises(ValueError):
        polynomials.tensor_dips(t, "other")
    smooth = polynomials.smooth_dips(t, 2.0)
    rough = polynomials.shapes(t)["inl_dip"]
    rough = np.nan_to_num(np.where(np.abs(rough) > 2, 0, rough))
    num, den = decomposition.butterworth_lowpass(0.3, 4)
    assert abs(abs(np.polyval(num[::-1], np.exp(-0.3j * np.pi)) / np.polyval(np.append(1, den)[::-1], np.exp(-0.3j * np.pi))) - np.sqrt(0.5)) < 1e-9
    x = rough[0, 0]
    long = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    assert np.allclose(smooth["inl_dip"][0, 0], decomposition.forward_backward(long[None], num, den)[0, 15:-15])
