"""Kernels against their invariants, files and the stream against a round trip."""

import numpy as np
import pytest

from traceflow.functions import kernels3d as K
from traceflow.operators import spectral, stencil, structure
from traceflow.sources import files
from traceflow.streaming import ties


# The published test vector of the segmentation.
def test_segmentation():
    half = [1, 1.5, 1.8, 0.5, 4, 5, 3, 1, 0.5, 1, 3, 1.5, 0.5, 1, 1.5, 3, 4, 2, 1, 0.5, 0.5, 0.4, 0.4]
    bounds, peaks = spectral.segments(np.array(half), 10)
    assert bounds == [0, 3, 8, 12, 22] and peaks == [2, 5, 10, 16]


def test_tie_estimate_finds_shift_phase_and_scale():
    t = np.arange(128) * 0.004
    a = np.exp(-((t - 0.25) ** 2) / 0.002) * np.cos(2 * np.pi * 30 * (t - 0.25))
    b = 2 * spectral.corrected(a[None, :], 0.016, 35.0, 1.0, 0.004)
    got = spectral.tie_estimate(a[None, :], b, 0.004, 0.1)
    assert got["zdiff"][0, 0] == pytest.approx(0.016, abs=0.002)
    assert got["phasediff"][0, 0] == pytest.approx(35, abs=6)
    assert got["ampdiff"][0, 0] == pytest.approx(2, rel=0.02) and got["quality"][0, 0] > 0.95
    none = spectral.tie_estimate(np.zeros((1, 64)), np.zeros((1, 64)), 0.004, 0.1)
    assert [none[k][0, 0] for k in ("zdiff", "phasediff", "ampdiff", "quality")] == [0, 0, 1, 0]


def test_modes_add_up():
    x = np.random.default_rng(0).normal(size=(3, 64))
    assert np.allclose(np.nansum(spectral.modes(x, 40), 1), x)


def test_recursive_spectrum_peaks_at_the_frequency():
    t = np.arange(256) * 0.004
    got = spectral.recursive_spectrum(np.sin(2 * np.pi * 40 * t)[None, :], 0.004, 0.2, 10.0, 10)
    assert np.argmax(got[0, :, 128]) == 3


def test_smooth_division_recovers_a_smooth_ratio():
    t = np.linspace(0, 1, 100)
    den = 1 + 0.3 * np.sin(40 * t)[None, :]
    ratio = 2 + np.cos(3 * t)[None, :]
    assert np.abs(spectral.smooth_division(ratio * den, den, 3) - ratio).max() < 0.1


def ramp(gx, gy, gz):
    i, j, k = np.meshgrid(*[np.arange(12.0)] * 3, indexing="ij")
    s = gx * i + gy * j + gz * k
    return stencil.Tile(s, np.ones(s.shape[:2], bool), 2)


def test_gradient_of_a_ramp_is_its_slope():
    for d, s in ((K.KROON3_D, K.KROON3_S), (K.FARID5_D, K.FARID5_S)):
        got = stencil.separable(ramp(2, 0, 0), d, s, s)
        assert np.allclose(got[..., 4:8], 2, atol=0.02)


def test_dips_of_a_plane():
    got = structure.gradient_dips(ramp(0.5, 0.25, 1.0))
    assert np.allclose(got["inl_dip"][..., 3:9], -0.5) and np.allclose(got["crl_dip"][..., 3:9], -0.25)
    tensor = structure.tensor_attributes(ramp(0.5, 0.25, 1.0))
    assert np.allclose(tensor["inl_dip"][..., 4:8], -0.5, atol=1e-6) and np.allclose(tensor["cplane"][..., 4:8], 1, atol=1e-6)


def test_filter_keeps_a_constant():
    t = stencil.Tile(np.full((9, 9, 9), 3.0), np.ones((9, 9), bool), 2)
    got = structure.least_variance(t, 3, 3.0)
    assert np.allclose(got["mean"], 3) and np.allclose(got["median"], 3) and (got["element"] == 0).all()


def test_missing_neighbour_is_the_centre():
    t = ramp(1, 0, 0)
    t.there[4, 4] = False
    t.samples[4, 4] = np.nan
    assert np.allclose(t.neighbour(1, 0)[1, 2], t.centre()[1, 2])


def test_files_round_trip(spark, tmp_path):
    rows = [("A", 1, "B", 2, 0.5, 1.5, 3.0, -20.0, 1.1, 0.9), ("A", 5, "3D x", 0, 0.0, 0.0, -1.0, 2.0, 0.8, 0.4)]
    df = spark.createDataFrame(rows, ties.SCHEMA)
    files.write_ties(df, f"{tmp_path}/t")
    assert sorted(map(tuple, files.read_ties(spark, f"{tmp_path}/t").collect())) == sorted(rows)
    cor = spark.createDataFrame([("A", 1.5, -3.0, 0.9), ("3D x", 0.0, 0.0, 1.0)], "line string, shift double, phase double, amp double")
    files.write_corrections(cor, f"{tmp_path}/c")
    assert sorted(map(tuple, files.read_corrections(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, cor.collect()))


def test_stream_keeps_the_newest(spark, tmp_path):
    one = [("A", 1, "B", 2, 0.0, 0.0, 3.0, 0.0, 1.0, 0.9)]
    two = [("B", 2, "A", 1, 0.0, 0.0, 5.0, 0.0, 2.0, 0.9), ("C", 1, "A", 7, 0.0, 0.0, 1.0, 0.0, 1.0, 0.5)]
    for n, rows in enumerate((one, two)):
        spark.createDataFrame(rows, ties.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = ties.keep_current(spark.readStream.schema(ties.SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/cp")
        q.awaitTermination()
    got = {(r.line_a, r.line_b): (r.zdiff, r.ampdiff) for r in spark.read.parquet(f"{tmp_path}/t/v=1").collect()}
    assert got == {("A", "B"): (-5.0, 0.5), ("A", "C"): (-1.0, 1.0)}
