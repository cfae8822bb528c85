"""Queries of the spectral attributes, and the relational halves of theirs that SQL can state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from traceflow.operators import decomposition, picks, spectral
from traceflow.sources import views

from .registry import query, sql

DT = 0.004


def _run(name, fn, outputs, view=views.traces, inputs=("samples",)):
    @query(name)
    def run(spark, sf_dir):
        got = spectral.map_traces(view(spark, sf_dir), fn, list(inputs), outputs, ["vec_id"])
        return views.samples(got, *outputs).select("vec_id", "z", *[F.round(o, 6).alias(o) for o in outputs])


def _named(stack, prefix):
    return {f"{prefix}{k + 1}": stack[:, k] for k in range(stack.shape[1])}


_run("analytic_signal", spectral.analytic_signal, ["real", "imaginary", "envelope", "phase"])
_run("instantaneous_frequency", lambda x: {"frequency": spectral.instantaneous_frequency(x, DT)}, ["frequency"])
_run("rspec", lambda x: _named(spectral.recursive_spectrum(x, DT, 10 * DT, 15.0, 8), "f"), [f"f{k}" for k in range(1, 9)])
_run("rspec_reassigned", lambda x: _named(decomposition.reassigned(x, DT, 15.0, 8), "f"), [f"f{k}" for k in range(1, 9)])
_run("ltf", lambda x: {f"f{k}": spectral.local_time_frequency(x, DT, 0, 20.0 * k, 5) for k in (1, 2, 3)}, ["f1", "f2", "f3"])
_run("signed_envelope", lambda x: {"value": picks.signed_envelope(x)}, ["value"])
_run("wavelet_peaks", lambda x: {"value": picks.wavelet_peaks(x, list(range(1, 9)))}, ["value"])
_run("warp_velocity", lambda a, b: {"value": picks.warp_velocity(a, b, band=12)}, ["value"], views.intercept_gradient, ("a", "b"))
_run("mistie_cc", lambda a, b: spectral.tie_estimate(a, b, DT, 8 * DT), ["zdiff", "phasediff", "ampdiff", "quality"], views.intercept_gradient, ("a", "b"))
_run("local_xcorr", lambda a, b: spectral.local_correlation(a, b, 5, 3), ["shift", "quality"], views.intercept_gradient, ("a", "b"))
_run("triangle_smooth", lambda x: {"value": spectral.triangle_smooth(x, 4)}, ["value"])


MODES = 3
STEP, COUNT = 15.0, 8
# the spectrum of each trace with 64 zeros behind it; its three largest maxima, the lowest amplitudes between them, and the bands they bound
BANDS = """k AS (SELECT unnest(range(65)) AS k),
spec AS (SELECT vec_id, k, sum(amp * cos(2 * pi() * k * z / 128)) AS re, -sum(amp * sin(2 * pi() * k * z / 128)) AS im FROM cube, k GROUP BY vec_id, k),
amps AS (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS r FROM (SELECT vec_id, k, sqrt(re * re + im * im) AS a FROM spec WHERE k < 64) WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
top AS (SELECT vec_id, k, a, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, k) AS rank FROM amps WHERE a > l AND a > r QUALIFY rank <= 3),
peak AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS mode, lead(k) OVER (PARTITION BY vec_id ORDER BY k) AS next FROM top),
cut AS (SELECT p.vec_id, p.mode, any_value(p.k) AS k, any_value(p.rank) AS rank, CASE WHEN any_value(p.next) IS NULL THEN 64 ELSE arg_min(m.k, {'a': m.a, 'k': m.k}) END AS high FROM peak p JOIN amps m ON m.vec_id = p.vec_id AND m.k BETWEEN p.k AND coalesce(p.next, p.k) GROUP BY p.vec_id, p.mode),
band AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY vec_id ORDER BY mode) + 1, 0) AS low FROM cut)"""
ANALYTIC = BANDS + """, ana AS (SELECT b.vec_id, b.mode, z.z, sum(w * (re * cos(2 * pi() * s.k * z.z / 128) - im * sin(2 * pi() * s.k * z.z / 128))) / 128 AS x, sum(w * (re * sin(2 * pi() * s.k * z.z / 128) + im * cos(2 * pi() * s.k * z.z / 128))) / 128 AS y
 FROM band b JOIN (SELECT *, CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END AS w FROM spec) s ON s.vec_id = b.vec_id AND s.k BETWEEN b.low AND b.high CROSS JOIN (SELECT unnest(range(64)) AS z) z GROUP BY b.vec_id, b.mode, z.z)"""


def _decomposed(x):
    return decomposition.Decomposition(x, MODES)


@query("efd_peaks_topk", sql("cube", BANDS + " SELECT vec_id, CAST(mode AS BIGINT) AS mode, CAST(k AS BIGINT) AS bin, CAST(rank AS BIGINT) AS rank, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM band"))
def efd_peaks_topk(spark, sf_dir):
    """The largest maxima of each trace's spectrum, in order and by rank, and the bins of their bands."""

    def run(x):
        d = _decomposed(x)
        rank = np.argmax(d.rank[:, None, :] == d.peaks[:, :, None], 2) + 1
        low = np.where(np.arange(MODES) == 0, 0, d.bounds[:, :-1] + 1)
        return {n: np.where(d.peaks >= 0, v, np.nan) for n, v in (("bin", d.peaks), ("rank", rank), ("low", low), ("high", d.bounds[:, 1:]))}

    got = spectral.map_traces(views.traces(spark, sf_dir), run, ["samples"], ["bin", "rank", "low", "high"], ["vec_id"])
    rows = views.samples(got, "bin", "rank", "low", "high").where("bin is not null")
    return rows.select("vec_id", (F.col("z") + 1).alias("mode"), *[F.col(c).cast("long").alias(c) for c in ("bin", "rank", "low", "high")])


@query("efd_modes", sql("cube", ANALYTIC + " SELECT vec_id, z, round(max(CASE WHEN mode = 1 THEN x END), 6) AS m1, round(max(CASE WHEN mode = 2 THEN x END), 6) AS m2, round(max(CASE WHEN mode = 3 THEN x END), 6) AS m3 FROM ana GROUP BY vec_id, z"))
def efd_modes(spark, sf_dir):
    """The parts of each trace in its bands."""
    outputs = [f"m{m + 1}" for m in range(MODES)]
    got = spectral.map_traces(views.traces(spark, sf_dir), lambda x: {o: _decomposed(x).mode(m) for m, o in enumerate(outputs)}, ["samples"], outputs, ["vec_id"])
    return views.samples(got, *outputs).select("vec_id", "z", *[F.round(o, 6).alias(o) for o in outputs])


@query("efd_by_rank", sql("cube", ANALYTIC + " SELECT a.vec_id, a.z, round(x, 6) AS value FROM ana a JOIN band b ON b.vec_id = a.vec_id AND b.mode = a.mode WHERE rank = 1"))
def efd_by_rank(spark, sf_dir):
    """Each trace's part around the largest peak of its spectrum."""
    got = spectral.map_traces(views.traces(spark, sf_dir), lambda x: {"value": _decomposed(x).by_rank(0)}, ["samples"], ["value"], ["vec_id"])
    return views.samples(got, "value").select("vec_id", "z", F.round("value", 6).alias("value"))


@query("efd_bin_sum", sql("cube", ANALYTIC + """, turn AS (SELECT *, CASE WHEN z < 62 THEN atan2(lead(y) OVER w * x - lead(x) OVER w * y, lead(x) OVER w * x + lead(y) OVER w * y) ELSE 0 END AS t FROM ana WINDOW w AS (PARTITION BY vec_id, mode ORDER BY z)),
f AS (SELECT vec_id, z, sqrt(x * x + y * y) AS a, CASE WHEN t < 0 THEN t + pi() ELSE t END / (2 * pi() * 0.004) AS f FROM turn)
SELECT vec_id, z, CAST(floor(f / 15 + 0.5) AS BIGINT) AS bin, round(sum(a), 6) AS total FROM f WHERE floor(f / 15 + 0.5) BETWEEN 1 AND 8 GROUP BY ALL"""))
def efd_bin_sum(spark, sf_dir):
    """The amplitudes of the modes, summed by the multiple of 15 Hz nearest to their instantaneous frequencies; bins without any have no row."""
    outputs = [f"f{k + 1}" for k in range(COUNT)]
    got = spectral.map_traces(views.traces(spark, sf_dir), lambda x: _named(_decomposed(x).spectrum_by_frequency(DT, STEP, COUNT), "f"), ["samples"], outputs, ["vec_id"])
    each = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("bin"), F.col(o).alias("total")) for k, o in enumerate(outputs)])
    return views.samples(got, *outputs).select("vec_id", "z", F.explode(each).alias("b")).select("vec_id", "z", "b.bin", F.round("b.total", 6).alias("total")).where("b.total > 0")
