"""Modelling and inversion against dense matrices, wavelet files, and undefined parts of logs."""

import numpy as np
import pytest

from traceflow.operators import modelling as M


def dense(n, taps):
    """W D as matrices."""
    d = np.zeros((n, n))
    for i in range(1, n - 1):
        d[i, i - 1], d[i, i + 1] = -0.5, 0.5
    w = np.zeros((n, n))
    for i in range(n):
        for k, t in enumerate(taps):
            j = i - (k - len(taps) // 2)
            if 0 <= j < n:
                w[i, j] = t
    return w @ d


TAPS = [[1.0], [0.2, 1.0, -0.4], [0.5, 1.0, 0.3, -0.2], M.ricker(30.0, 0.004, 6), list(np.linspace(-1, 2, 41))]


@pytest.mark.parametrize("taps", TAPS)
@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 64])
def test_inversion_is_the_dense_solve(taps, n):
    rng = np.random.default_rng(n)
    x, m0 = rng.normal(size=(5, n)), rng.normal(size=(5, n))
    a = dense(n, [t / 2 for t in taps])
    want = m0 + np.linalg.solve(a.T @ a + 0.03 * np.eye(n), a.T @ (x - m0 @ a.T).T).T
    got = M.inverted(x, m0, taps, 0.03)
    assert np.abs(got["impedance"] - want).max() < 1e-9
    assert np.abs(got["residual"] - (x - want @ a.T)).max() < 1e-9
    assert np.abs(M.convolved(M.slope(x), taps) - x @ dense(n, taps).T).max() < 1e-12


def test_inversion_over_a_volume(spark):
    """The damping is of the whole volume, whatever the partitions; traces of other lengths, undefined samples and an empty table."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20 + i % 3).tolist(), [1.0] * (20 + i % 3)) for i in range(30)]
    rows[4][1][3] = None
    df = spark.createDataFrame(rows, "id long, s array<double>, m array<double>")
    top = max(v for _, s, _ in rows for v in s if v is not None)
    taps = M.ricker(25.0, 0.004, 5)
    for parts in (1, 7):
        got = {r.id: r for r in M.poststack_inversion(df.repartition(parts), taps, "s", "m", ["id"], percent=2.0).collect()}
        for i, s, m in rows:
            want = M.inverted(np.array([[v or 0.0 for v in s]]), np.array([m]), taps, 0.02 * top)
            assert np.allclose(got[i].impedance, want["impedance"][0], atol=1e-12) and np.allclose(got[i].residual, want["residual"][0], atol=1e-12)
    assert M.poststack_inversion(df.limit(0), taps, "s", "m", ["id"]).count() == 0
    flat = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 1.0])], df.schema)
    assert M.poststack_inversion(flat, taps, "s", "m", ["id"]).first().impedance == [None, None]


def test_logs_are_extended():
    log = np.array([[0.0, 0, 2, 3, 0, 5, 0], [0] * 7, [1, 2, 3, 4, 5, 6, 7]])
    full, inside = M.extended(log)
    assert full.tolist() == [[2, 2, 2, 3, 0, 5, 5], [0] * 7, [1, 2, 3, 4, 5, 6, 7]]
    assert inside.astype(int).tolist() == [[0, 0, 1, 1, 1, 0, 0], [0] * 7, [1, 1, 1, 1, 1, 1, 0]]


def test_reflectivity_of_an_interface():
    """At normal incidence only impedance counts; Fatti's terms, given impedances, agree with Aki-Richards' for small contrasts."""
    r = np.array([[0.5]])
    vp, vs, rho = M.reflection_weights(0.0, r, "akirich")
    assert (vp, vs, rho) == (0.5, 0.0, 0.5)
    a, f = M.reflection_weights(25.0, r, "akirich"), M.reflection_weights(25.0, r, "fatti")
    dvp, dvs, drho = 0.1, 0.07, 0.03
    one = a[0] * dvp + a[1] * dvs + a[2] * drho
    # with changes of ln impedance and ln shear impedance in place of ln velocities
    two = f[0] * (dvp + drho) + f[1] * (dvs + drho) + f[2] * drho
    assert abs(one - two).max() < 1e-12
    with pytest.raises(ValueError):
        M.reflection_weights(1.0, r, "other")


def test_wavelet_file(spark, tmp_path):
    path = str(tmp_path / "w.wvlt")
    with open(path, "w") as f:
        f.write("\n".join(["header"] * 8 + ["!", "0.5 ! first", "1.0", "", "-0.25", "! end"]))
    assert M.wavelet_taps(spark, path) == [0.5, 1.0, -0.25]
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 4.0, 8.0, 0.0])], "id long, s array<double>")
    got = M.poststack_modelling(df, M.wavelet_taps(spark, path), "s", ["id"]).first().value
    full = np.array([1.0, 1, 2, 4, 8, 8])
    want = dense(6, [0.25, 0.5, -0.125]) @ full
    assert got[0] is None and got[4:] == [None, None] and np.allclose(got[1:4], want[1:4])
    with open(path, "w") as f:
        f.write("\n".join(["header"] * 9))
    with pytest.raises(ValueError):
        M.wavelet_taps(spark, path)
