"""Queries over the trace lattice."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from traceflow.functions import kernels3d as K
from traceflow.operators import dips, picks, polynomials, stencil, structure
from traceflow.sources import views

from .registry import query, sql


def _values(df, *outputs, digits=6):
    return views.samples(df, *outputs).select("vec_id", "z", *[F.round(o, digits).alias(o) for o in outputs])


def _weights(name, kernel):
    return f"{name}(o, w) AS (VALUES " + ", ".join(f"({i - len(kernel) // 2}, CAST({k!r} AS DOUBLE))" for i, k in enumerate(kernel)) + ")"


STENCIL = """p AS (SELECT c.vec_id, c.z, sum(x.w * y.w * coalesce(n.amp, c.amp)) AS v
 FROM cube c CROSS JOIN wx x CROSS JOIN wy y LEFT JOIN cube n ON n.inl = c.inl + x.o AND n.crl = c.crl + y.o AND n.z = c.z GROUP BY c.vec_id, c.z)
SELECT p.vec_id, p.z, round(sum(k.w * q.v), 6) AS value FROM p CROSS JOIN wz k JOIN p q ON q.vec_id = p.vec_id AND q.z = p.z + k.o GROUP BY p.vec_id, p.z"""


# The weights of the published operators once more, and those of the smoothing and wavenumber kernels from their formulas, so that the SQL doesn't lean on the library's.
SQL_WEIGHTS = {
    "one": [1.0],
    "three": [1.0, 1.0, 1.0],
    "kroon3_d": [-0.5, 0.0, 0.5],
    "kroon3_s": [0.178947, 0.642105, 0.178947],
    "farid5_d": [-0.109604, -0.276691, 0.0, 0.276691, 0.109604],
    "farid5_s": [0.037659, 0.249153, 0.426375, 0.249153, 0.037659],
    "farid7_d": [-0.018708, -0.125376, -0.193091, 0.0, 0.193091, 0.125376, 0.018708],
    "farid7_s": [0.004711, 0.069321, 0.245410, 0.361117, 0.245410, 0.069321, 0.004711],
    "farid5_dd": [0.232905, 0.002668, -0.471147, 0.002668, 0.232905],
    "farid5_ss": [0.030320, 0.249724, 0.439911, 0.249724, 0.030320],
    "scharr3_d": [-0.5, 0.0, 0.5],
    "scharr3_s": [0.12026, 0.75948, 0.12026],
    "scharr3_dd": [1.0, -2.0, 1.0],
    "scharr3_ss": [0.21478, 0.57044, 0.21478],
    "scharr3_mixed": [0.5, 0.0, -0.5],
    "prewitt_d": [-1.0, 0.0, 1.0],
    "prewitt_s": [1.0, 1.0, 1.0],
    "gauss3": [0.10650697891920076, 0.7869860421615985, 0.10650697891920076],
    "gauss5": [0.02691315637385274, 0.23336768374143024, 0.4794383197694339, 0.23336768374143024, 0.02691315637385274],
    "low": [0.0, 0.2037123692007372, 0.5925752615985256, 0.2037123692007372, 0.0],
    "high": [0.0, -0.2037123692007372, 0.4074247384014744, -0.2037123692007372, 0.0],
    "band": [-0.0366126844633692, -0.057756105989120315, 0.18873758090497916, -0.057756105989120315, -0.0366126844633692],
    "reject": [0.0366126844633692, 0.057756105989120315, 0.8112624190950208, 0.057756105989120315, 0.0366126844633692],
}
LIBRARY = {
    "one": [1.0], "three": [1.0, 1.0, 1.0], "gauss3": K.gaussian(3), "gauss5": K.gaussian(5),
    "low": K.lowpass(2, 0.5), "high": K.highpass(2, 0.5), "band": K.bandpass(2, 0.2, 0.6), "reject": K.bandreject(2, 0.2, 0.6),
}


def _separable(name, *weights):
    """weights: names of those along inlines, crosslines and the trace."""
    kx, ky, kz = (LIBRARY[w] if w in LIBRARY else getattr(K, w.upper()) for w in weights)
    wx, wy, wz = (SQL_WEIGHTS[w] for w in weights)
    halo = max(len(kx), len(ky)) // 2

    @query(name, sql("cube", ", ".join((_weights("wx", wx), _weights("wy", wy), _weights("wz", wz), STENCIL))))
    def run(spark, sf_dir):
        return _values(stencil.map_tiles(views.traces(spark, sf_dir), lambda t: {"value": stencil.separable(t, kx, ky, kz)}, ["value"], halo), "value")


_separable("stencil_sum", "three", "three", "one")
for _name in ("kroon3", "farid5", "farid7"):
    _separable(f"gradient_{_name}_inl", f"{_name}_d", f"{_name}_s", f"{_name}_s")
    _separable(f"gradient_{_name}_crl", f"{_name}_s", f"{_name}_d", f"{_name}_s")
    _separable(f"gradient_{_name}_z", f"{_name}_s", f"{_name}_s", f"{_name}_d")
# 2-D lines: a stepout along the trace number only.
_separable("gradient_2d_trc", "one", "kroon3_d", "kroon3_s")
_separable("gradient_2d_z", "one", "kroon3_s", "kroon3_d")
for _at, _axis in enumerate(("inl", "crl", "z")):
    _separable(f"farid_second_{_axis}", *[f"farid5_{'dd' if i == _at else 'ss'}" for i in range(3)])
for _at, _axis in enumerate("xyz"):
    _separable(f"scharr_d{_axis}", *[f"scharr3_{'d' if i == _at else 's'}" for i in range(3)])
    _separable(f"scharr_d{_axis}{_axis}", *[f"scharr3_{'dd' if i == _at else 'ss'}" for i in range(3)])
    _separable(f"prewitt_d{_axis}", *[f"prewitt_{'d' if i == _at else 's'}" for i in range(3)])
for _pair, _flat in (("xy", 2), ("xz", 1), ("yz", 0)):
    _separable(f"scharr_d{_pair}", *["scharr3_s" if i == _flat else "scharr3_mixed" for i in range(3)])
_separable("farid_dxx", "farid5_dd", "farid5_ss", "farid5_ss")
_separable("gaussian_smooth", "gauss3", "gauss3", "gauss5")
_separable("kk_rect_lowpass", "low", "low", "one")
_separable("kk_rect_highpass", "high", "high", "one")
_separable("kk_rect_bandpass", "band", "band", "one")
_separable("kk_rect_bandreject", "reject", "reject", "one")


def _second(tile):
    """The matrix of second derivatives of each sample."""
    m, s, dd, ss = K.SCHARR3_MIXED, K.SCHARR3_S, K.SCHARR3_DD, K.SCHARR3_SS
    of = lambda x, y, z: stencil.separable(tile, x, y, z)
    return {"xx": of(dd, ss, ss), "yy": of(ss, dd, ss), "zz": of(ss, ss, dd), "xy": of(m, m, s), "xz": of(m, s, m), "yz": of(s, m, m)}


HESSIAN = {"xx": ("dd", "ss", "ss"), "yy": ("ss", "dd", "ss"), "zz": ("ss", "ss", "dd"), "xy": ("mixed", "mixed", "s"), "xz": ("mixed", "s", "mixed"), "yz": ("s", "mixed", "mixed")}


@query("hessian", sql("cube", "k(o, d, s, dd, ss, mixed) AS (VALUES (-1, -0.5, 0.12026, 1.0, 0.21478, 0.5), (0, 0.0, 0.75948, -2.0, 0.57044, 0.0), (1, 0.5, 0.12026, 1.0, 0.21478, -0.5)), p AS (SELECT c.vec_id, c.z, "
    + ", ".join(f"sum(CAST(x.{a} * y.{b} AS DOUBLE) * coalesce(n.amp, c.amp)) AS p{n}" for n, (a, b, _) in HESSIAN.items())
    + " FROM cube c CROSS JOIN k x CROSS JOIN k y LEFT JOIN cube n ON n.inl = c.inl + x.o AND n.crl = c.crl + y.o AND n.z = c.z GROUP BY c.vec_id, c.z) SELECT p.vec_id, p.z, "
    + ", ".join(f"round(sum(CAST(k.{c} AS DOUBLE) * q.p{n}), 6) AS {n}" for n, (_, _, c) in HESSIAN.items()) + " FROM p CROSS JOIN k JOIN p q ON q.vec_id = p.vec_id AND q.z = p.z + k.o GROUP BY p.vec_id, p.z"))
def hessian(spark, sf_dir):
    return _values(stencil.map_tiles(views.traces(spark, sf_dir), _second, list(HESSIAN), 1), *HESSIAN)


_LPA = K.polynomial_weights(3)


def _fitted_weights():
    """The same weights for the SQL, from the definition: the fit of a unit sample at each place, Gaussian deviation 0.4, by an orthogonal factorisation."""
    o = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    root = np.array([math.exp(-(i * i + j * j + k * k) / (4 * 0.4**2)) for i, j, k in o])
    basis = np.array([[1, i, j, k, i * i, j * j, k * k, i * j, i * k, j * k] for i, j, k in o], float)
    q, r = np.linalg.qr(root[:, None] * basis)
    return (np.linalg.solve(r, q.T) * root).reshape(10, 3, 3, 3)


_SQL_LPA = _fitted_weights()
for _i, _name in enumerate(("lpa_smooth", "lpa_r1", "lpa_r2", "lpa_r3", "lpa_r4", "lpa_r5", "lpa_r6", "lpa_r7", "lpa_r8", "lpa_r9")):
    _w, _v = _LPA[_i], _SQL_LPA[_i]
    _body = "w(i, j, k, w) AS (VALUES " + ", ".join(f"({a - 1}, {b - 1}, {c - 1}, CAST({float(_v[a, b, c])!r} AS DOUBLE))" for a in range(3) for b in range(3) for c in range(3)) + """),
p AS (SELECT c.vec_id, c.z, o.i, o.j, coalesce(n.amp, c.amp) AS amp FROM cube c CROSS JOIN (SELECT DISTINCT i, j FROM w) o LEFT JOIN cube n ON n.inl = c.inl + o.i AND n.crl = c.crl + o.j AND n.z = c.z)
SELECT c.vec_id, c.z, round(sum(w.w * p.amp), 6) AS value FROM cube c CROSS JOIN w JOIN p ON p.vec_id = c.vec_id AND p.z = c.z + w.k AND p.i = w.i AND p.j = w.j GROUP BY c.vec_id, c.z"""

    def _lpa(spark, sf_dir, w=_w):
        return _values(stencil.map_tiles(views.traces(spark, sf_dir), lambda t: {"value": structure.block_sum(t, w)}, ["value"], 1), "value")

    query(_name, sql("cube", _body))(_lpa)

MLV = """o AS (SELECT i, j, k, e, n[e + 1] AS v FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS k), (SELECT unnest(range(13)) AS e), (SELECT {n} AS n)),
el AS (SELECT i, j, k, e FROM o WHERE i * v[1] + j * v[2] + k * v[3] = 0),
p AS (SELECT c.vec_id, c.z, o.i, o.j, coalesce(n.amp, c.amp) AS amp FROM cube c CROSS JOIN (SELECT DISTINCT i, j FROM el) o LEFT JOIN cube n ON n.inl = c.inl + o.i AND n.crl = c.crl + o.j AND n.z = c.z),
s AS (SELECT c.vec_id, c.z, el.e, round(var_samp(p.amp), 12) AS var, avg(p.amp) AS mean, median(p.amp) AS median FROM cube c CROSS JOIN el JOIN p ON p.vec_id = c.vec_id AND p.z = c.z + el.k AND p.i = el.i AND p.j = el.j GROUP BY c.vec_id, c.z, el.e)
SELECT vec_id, z, CAST(round(arg_min({value}, {{'v': var, 'e': e}}), 6) AS DOUBLE) AS {name} FROM s GROUP BY vec_id, z"""
# The elements' normals, written out here as well, so that the SQL doesn't lean on the library's list.
_NORMALS = "[[0, 0, 1], [0, 1, -1], [0, 1, 1], [1, 0, -1], [1, 0, 1], [1, 1, 1], [1, 1, -1], [1, -1, 1], [-1, 1, 1], [0, 1, 0], [1, 0, 0], [1, -1, 0], [-1, -1, 0]]"
for _name, _value in (("mean", "mean"), ("median", "median"), ("element", "e")):

    def _mlv(spark, sf_dir, output=_name):
        return _values(stencil.map_tiles(views.traces(spark, sf_dir), lambda t: structure.least_variance(t, 3, 3.0), [output], 1), output)

    query(f"mlv_{_name}", sql("cube", MLV.format(n=_NORMALS, value=_value, name=_name)))(_mlv)


@query("mlv_trimmed")
def mlv_trimmed(spark, sf_dir):
    return _values(stencil.map_tiles(views.traces(spark, sf_dir), lambda t: structure.least_variance(t, 3, 1.5), ["trimmed"], 1), "trimmed")


GRADS = """g AS (SELECT c.vec_id, c.z,
 sum(CASE WHEN o.j = 0 THEN o.i * coalesce(n.amp, c.amp) / 2 END) AS gx, sum(CASE WHEN o.i = 0 THEN o.j * coalesce(n.amp, c.amp) / 2 END) AS gy,
 any_value((c.up - c.down) / 2) AS gz
 FROM (SELECT *, coalesce(lead(amp) OVER w, 0) AS up, coalesce(lag(amp) OVER w, 0) AS down FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z)) c CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(i, j)
 LEFT JOIN cube n ON n.inl = c.inl + o.i AND n.crl = c.crl + o.j AND n.z = c.z GROUP BY c.vec_id, c.z)"""


@query("dip_from_gradients", sql("cube", GRADS + " SELECT vec_id, z, round(-gy / nullif(gz, 0), 4) AS crl_dip, round(-gx / nullif(gz, 0), 4) AS inl_dip FROM g"))
def dip_from_gradients(spark, sf_dir):
    return _values(stencil.map_tiles(views.traces(spark, sf_dir), structure.gradient_dips, ["crl_dip", "inl_dip"], 1), "crl_dip", "inl_dip", digits=4)


@query("dip_true", sql("cube_ig", "SELECT vec_id, z, round(sqrt(a * a + b * b), 6) AS dip, round(degrees(atan2(b, a)), 6) AS azimuth FROM cube_ig"))
def dip_true(spark, sf_dir):
    df = views.samples(views.intercept_gradient(spark, sf_dir), "a", "b")
    return df.select("vec_id", "z", F.round(F.hypot("a", "b"), 6).alias("dip"), F.round(F.degrees(F.atan2("b", "a")), 6).alias("azimuth"))


def _plane_of_e1(tile):
    """Of 3-point gradients the planarity is relative to the first eigenvalue alone."""
    got = dips.gradient_tensor(tile)
    return {**got, "cplane": got["planarity"]}


_DIPS = ["crl_dip", "inl_dip", "true_dip", "azimuth"]
for _name, _fn, _outputs, _halo in (
    ("structure_tensor_dip", _plane_of_e1, ["crl_dip", "inl_dip", "cplane", "coherency"], 2),
    ("structure_tensor_dip5", lambda t: dips.gradient_tensor(t, 5, inl_factor=0.5, crl_factor=0.8), [*_DIPS, "coherency"], 3),
    ("tensor_shapes", dips.gradient_tensor, ["e1", "e2", "e3", "cline", "cplane", "cfault", "cchaos", "ctype"], 2),
    ("phase_dip", dips.phase, ["crl_dip", "inl_dip"], 1),
    ("phase_tensor_dip", dips.phase_tensor, ["crl_dip", "inl_dip", "cplane"], 2),
    ("vector_median_dip_l1", structure.median_dips("l1"), ["crl_dip", "inl_dip"], 1),
    ("vector_median_dip_l2", structure.median_dips("l2"), ["crl_dip", "inl_dip"], 1),
    ("vector_median_dip_x3", structure.median_dips("x3"), ["crl_dip", "inl_dip"], 1),
    ("vector_mean_dip", structure.median_dips("mean"), ["crl_dip", "inl_dip"], 1),
    ("filtered_gradient_dip", lambda t: dips.filtered_gradient(t, "l2", half_z=1), _DIPS, 2),
    ("filtered_phase_dip", lambda t: dips.filtered_phase(t, "mean", half_z=1), _DIPS, 2),
    ("phase_tensor_dip_even", lambda t: dips.phase_tensor(t, weighted=False), _DIPS, 2),
    ("tensor_dip", lambda t: dips.rank_one(*dips.gradient(t, K.KROON3_D, K.KROON3_S)), _DIPS, 1),
    ("lpa_tensor", structure.polynomial_tensor, ["e1", "e2", "e3", "crl_dip", "inl_dip"], 1),
    ("lpa_shapes", lambda t: polynomials.shapes(t, (3, 3, 5)), ["e1", "e2", "e3", "cline", "cplane", "cfault", "cchaos", "ctype"], 1),
    ("lpa_dip", lambda t: polynomials.smooth_dips(t, 2.0), ["crl_dip", "inl_dip"], 1),
    *[(f"lpa_tensor_dip_{n}", lambda t, n=n: polynomials.tensor_dips(t, n, inl_factor=0.5, crl_factor=0.8), [*_DIPS, "weight"], 1) for n in polynomials.NORMS],
    ("adaptive_equalisation", lambda t: {"value": picks.adaptive_equalisation(t, 0.004, 1, 21, 0.1)}, ["value"], 1),
):

    def _run(spark, sf_dir, fn=_fn, outputs=_outputs, halo=_halo):
        return _values(stencil.map_tiles(views.traces(spark, sf_dir), fn, outputs, halo), *outputs)

    query(_name)(_run)



# The circular kernels of 7 x 7 taps at half the Nyquist frequency (low-passes at 0.5, 0.4 and 0.6), by offsets in falling order; from the integral of the Bessel function.
CIRCULAR = """low(a, b, w5, w4, w6) AS (VALUES (0, 0, 1.9483926690513226e-1, 1.2581189479687160e-1, 2.8967823166165119e-1),
 (1, 0, 1.2424453868991377e-1, 9.0618305009006556e-2, 1.5791251080414578e-1),
 (1, 1, 7.5708352326634920e-2, 6.4225118730375633e-2, 7.6680505444005273e-2),
 (2, 0, 2.1181961226601400e-2, 2.9662005885158989e-2, 2.3122348813064421e-3),
 (2, 1, 7.7739282398598024e-3, 1.9293598288326191e-2, -1.0474316681975022e-2),
 (2, 2, -6.7960497803120903e-3, 2.9207434959917116e-3, -1.3540562846261775e-2),
 (3, 0, -6.8597525573729813e-3, 4.9295546950865949e-4, -9.9310512350804445e-3),
 (3, 1, -6.6090312674094076e-3, -9.2328311459118821e-4, -7.1889568512086433e-3),
 (3, 2, -3.9905401422433541e-3, -2.3478459146358860e-3, -9.9931613516423970e-4),
 (3, 3, -5.3758029216217581e-4, -1.4170408074575661e-3, 1.4719843731677686e-3)),
o AS (SELECT i, j, CASE WHEN i = 0 AND j = 0 THEN 1.0 ELSE 0.0 END AS one, w5, w4, w6 FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) JOIN low ON a = greatest(abs(i), abs(j)) AND b = least(abs(i), abs(j)))
SELECT c.vec_id, c.z, round(sum(CAST({w} AS DOUBLE) * coalesce(n.amp, c.amp)), 6) AS value FROM cube c CROSS JOIN o LEFT JOIN cube n ON n.inl = c.inl + o.i AND n.crl = c.crl + o.j AND n.z = c.z GROUP BY c.vec_id, c.z"""
for _name, _kind, _weight in (("lowpass", "low", "w5"), ("highpass", "high", "(one - w5)"), ("bandreject", "reject", "(w4 + one - w6)"), ("bandpass", "band", "(w6 - w4)")):

    def _circular(spark, sf_dir, kind=_kind):
        return _values(stencil.map_tiles(views.traces(spark, sf_dir), structure.circular(kind, 7, 0.5), ["value"], 3), "value")

    query(f"kk_circular_{_name}", sql("cube", CIRCULAR.format(w=_weight)))(_circular)


@query("filtered_dips")
def filtered_dips(spark, sf_dir):
    """The L1 vector median of given dips."""
    t = views.intercept_gradient(spark, sf_dir).select("vec_id", "inl", "crl", F.concat("a", "b").alias("samples"))

    def run(tile):
        n = tile.samples.shape[-1] // 2
        a, b = (stencil.Tile(tile.samples[..., p], tile.there, tile.h) for p in (slice(0, n), slice(n, 2 * n)))
        return dips.filtered_dips(a, b, "l1", 1, 1, 0.5, 0.8)

    return _values(stencil.map_tiles(t, run, _DIPS, 1), *_DIPS)


# Coefficients of a block of 3 x 3 x 5 samples: the SQL's weights from the normal equations, to be turned around by the convolution.
def _block_weights():
    o = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in range(-2, 3)]
    w = np.array([math.exp(-(i * i + j * j) / (2 * 0.4**2) - k * k / (2 * 0.8**2)) for i, j, k in o])
    b = np.array([[1, i, j, k, i * i, j * j, k * k, i * j, i * k, j * k] for i, j, k in o], float)
    return o, np.linalg.solve(b.T @ (w[:, None] * b), (w[:, None] * b).T)


_PLACES, _COEFFICIENTS = _block_weights()
_LPA_SQL = "w(i, j, k, " + ", ".join(f"w{c}" for c in range(10)) + ") AS (VALUES " + ", ".join(f"({i}, {j}, {k}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in _COEFFICIENTS[:, n]) + ")" for n, (i, j, k) in enumerate(_PLACES)) + """),
p AS (SELECT c.vec_id, c.z, o.i, o.j, coalesce(n.amp, c.amp) AS amp FROM cube c CROSS JOIN (SELECT DISTINCT i, j FROM w) o LEFT JOIN cube n ON n.inl = c.inl - o.i AND n.crl = c.crl - o.j AND n.z = c.z)
SELECT c.vec_id, c.z, """ + ", ".join(f"CASE WHEN c.z BETWEEN 2 AND 61 THEN round(sum(w{c} * p.amp), 6) ELSE 0 END AS r{c}" for c in range(10)) + " FROM cube c CROSS JOIN w LEFT JOIN p ON p.vec_id = c.vec_id AND p.z = c.z - w.k AND p.i = w.i AND p.j = w.j GROUP BY c.vec_id, c.z"


@query("lpa_coefficients", sql("cube", _LPA_SQL))
def lpa_coefficients(spark, sf_dir):
    """All ten coefficients of blocks that are longer along the trace."""
    names = [f"r{c}" for c in range(10)]
    return _values(stencil.map_tiles(views.traces(spark, sf_dir), lambda t: dict(zip(names, polynomials.coefficients(t, (3, 3, 5)))), names, 1), *names)
