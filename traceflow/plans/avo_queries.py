"""AVO and polarization queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from traceflow.operators import avo, polar
from traceflow.sources import views

from .registry import query, sql

THETA = avo.crossplot_angle_of(1.0)
C, S = repr(math.cos(THETA)), repr(math.sin(THETA))


def _samples(spark, sf_dir):
    return views.samples(views.intercept_gradient(spark, sf_dir), "a", "b")


def _out(df, column):
    return df.select("vec_id", "z", F.round(column.cast("double"), 6).alias("value"))


def _register(name, make, expression):
    """make(intercept, gradient) is called with columns when the query runs: columns can't be made before there is a session."""
    query(name, sql("cube_ig", f"SELECT vec_id, z, round(CAST({expression} AS DOUBLE), 6) AS value FROM cube_ig"))(lambda spark, sf_dir: _out(_samples(spark, sf_dir), make(F.col("a"), F.col("b"))))


LITHO = f"(b * {C} - a * {S})"
_register("avo_fluid_factor", avo.fluid_factor, f"a * {C} + b * {S}")
_register("avo_lithology", avo.lithology_factor, LITHO)
_register("avo_porosity", avo.porosity_factor, f"CASE WHEN abs(b - a) <= 1e-10 THEN 0 WHEN b > a THEN -{LITHO} ELSE {LITHO} END")
_register("avo_xplot_angle", avo.crossplot_angle, f"CASE WHEN a <> 0 AND b <> 0 THEN degrees(acos(least(greatest({LITHO} / sqrt(a * a + b * b), -1.0), 1.0))) - CASE WHEN b > a THEN 180 ELSE 0 END END")
_register("avo_xplot_dev", lambda i, g: avo.crossplot_deviation(i, g, 0.1, 0.2, 0.3), "sqrt(a * a / 0.1 ** 2 + b * b / 0.2 ** 2 - 2 * 0.3 * a * b / (0.1 * 0.2))")
_register("avo_class", lambda i, g: avo.avo_class(i, g, 1.0, 0.02), "CASE WHEN abs(a) <= 0.02 THEN CASE WHEN b > a THEN -2 ELSE 2 END WHEN b <= a AND b >= 0 AND a <= 0 THEN 4 WHEN b > a AND b <= 0 AND a >= 0 THEN -4 WHEN b <= a AND b < 0 AND a <= 0 THEN 3 WHEN b > a AND b >= 0 AND a >= 0 THEN -3 WHEN b <= a AND b < 0 AND a >= 0 THEN 1 WHEN b > a AND b > 0 AND a <= 0 THEN -1 END")

EVENT = """s AS (SELECT vec_id, z, sum(a * a) OVER w AS a2, sum(b * b) OVER w AS b2, sum(a * b) OVER w AS ab FROM cube_ig
 WINDOW w AS (PARTITION BY vec_id ORDER BY z ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""
ANGLE = "degrees(atan(2 * ab / nullif(a2 - b2 + sqrt(4 * ab * ab + (a2 - b2) * (a2 - b2)), 0)))"
QUALITY = "sqrt(4 * ab * ab + (a2 - b2) * (a2 - b2)) / nullif(a2 + b2, 0)"


def _event(spark, sf_dir, half=5):
    return views.samples(polar.event_sums(views.intercept_gradient(spark, sf_dir), half), "a2", "b2", "ab2")


SUMS = ("a2", "b2", "ab2")


@query("polar_event", sql("cube_ig", EVENT.format(h=5) + f" SELECT vec_id, z, round({ANGLE}, 6) AS event_angle, round({QUALITY}, 6) AS quality FROM s"))
def polar_event(spark, sf_dir):
    return _event(spark, sf_dir).select("vec_id", "z", F.round(polar.angle_of(*map(F.col, SUMS)), 6).alias("event_angle"), F.round(polar.quality_of(*map(F.col, SUMS)), 6).alias("quality"))


STRENGTH = """m AS (SELECT vec_id, z, arg_min({{'a': a, 'b': b}}, {{'k': a, 'z': z}}) OVER w AS lo, arg_max({{'a': a, 'b': b}}, {{'k': a, 'z': -z}}) OVER w AS hi FROM cube_ig
 WINDOW w AS (PARTITION BY vec_id ORDER BY z ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
st AS (SELECT vec_id, z, sqrt(lo.a * lo.a + lo.b * lo.b) + sqrt(hi.a * hi.a + hi.b * hi.b) AS strength FROM m)"""


@query("polar_strength", sql("cube_ig", STRENGTH.format(h=5) + " SELECT vec_id, z, round(strength, 6) AS strength FROM st"))
def polar_strength(spark, sf_dir):
    df = views.intercept_gradient(spark, sf_dir).withColumn("strength", polar.strength(5))
    return views.samples(df, "strength").select("vec_id", "z", F.round("strength", 6).alias("strength"))


BACK = """p AS (SELECT c.vec_id, c.z, coalesce(n.a, c.a) AS a, coalesce(n.b, c.b) AS b
 FROM cube_ig c CROSS JOIN (SELECT unnest(range(-1, 2)) AS i) CROSS JOIN (SELECT unnest(range(-1, 2)) AS j)
 LEFT JOIN cube_ig n ON n.inl = c.inl + i AND n.crl = c.crl + j AND n.z = c.z),
g AS (SELECT vec_id, z, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM p GROUP BY vec_id, z),
bg AS (SELECT vec_id, z, sum(aa) OVER w AS a2, sum(bb) OVER w AS b2, sum(ab) OVER w AS ab FROM g
 WINDOW w AS (PARTITION BY vec_id ORDER BY z ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
ba AS (SELECT vec_id, z, """ + ANGLE + " AS background FROM bg)"


def _background(spark, sf_dir):
    return polar.background_sums(views.intercept_gradient(spark, sf_dir), 1, 10).select("vec_id", "z", polar.angle_of(*map(F.col, SUMS)).alias("background"))


@query("polar_background", sql("cube_ig", BACK + " SELECT vec_id, z, round(background, 6) AS background FROM ba"))
def polar_background(spark, sf_dir):
    return _background(spark, sf_dir).select("vec_id", "z", F.round("background", 6).alias("background"))


def _difference(spark, sf_dir):
    event = _event(spark, sf_dir).select("vec_id", "z", polar.angle_of(*map(F.col, SUMS)).alias("event"))
    return event.join(_background(spark, sf_dir), ["vec_id", "z"]).withColumn("difference", F.col("event") - F.col("background"))


EA = EVENT.format(h=5) + f", ev AS (SELECT vec_id, z, {ANGLE} AS event FROM s)"


@query("polar_difference", sql("cube_ig", BACK + ", " + EA + " SELECT vec_id, z, round(event - background, 6) AS difference FROM ba JOIN ev USING (vec_id, z)"))
def polar_difference(spark, sf_dir):
    return _difference(spark, sf_dir).select("vec_id", "z", F.round("difference", 6).alias("difference"))


@query("polar_product", sql("cube_ig", BACK + ", " + EA + ", " + STRENGTH.format(h=5) + " SELECT vec_id, z, round((event - background) * strength, 6) AS product FROM ba JOIN ev USING (vec_id, z) JOIN st USING (vec_id, z)"))
def polar_product(spark, sf_dir):
    s = views.samples(views.intercept_gradient(spark, sf_dir).withColumn("strength", polar.strength(5)), "strength")
    return _difference(spark, sf_dir).join(s, ["vec_id", "z"]).select("vec_id", "z", F.round(F.col("difference") * F.col("strength"), 6).alias("product"))


def _view(n):
    return views.stacks5 if n == 5 else views.stacks


def _stacks(spark, sf_dir, n):
    return views.samples(_view(n)(spark, sf_dir), *[f"s{i + 1}" for i in range(n)])


def _fit(n, degrees):
    x = [math.sin(math.radians(d)) ** 2 for d in degrees]
    cols, view = [f"s{i + 1}" for i in range(n)], "stacks5" if n == 5 else "stacks"
    values = ", ".join(f"({v!r}, {c})" for v, c in zip(x, cols))
    body = f"""f AS (SELECT vec_id, z, (SELECT regr_intercept(y, x) FROM (VALUES {values}) t(x, y)) AS intercept, (SELECT regr_slope(y, x) FROM (VALUES {values}) t(x, y)) AS gradient, (SELECT regr_r2(y, x) FROM (VALUES {values}) t(x, y)) AS quality FROM {view})
SELECT vec_id, z, round(intercept, 6) AS intercept, round(gradient, 6) AS gradient, round(quality, 6) AS quality FROM f"""

    @query(f"avo_ig{n}", sql(view, body))
    def fitted(spark, sf_dir):
        f = avo.fit_angles([F.col(c) for c in cols], degrees)
        return _stacks(spark, sf_dir, n).select("vec_id", "z", *[F.round(f[k], 6).alias(k) for k in ("intercept", "gradient", "quality")])

    block = f"""f AS (SELECT vec_id, z, (SELECT regr_intercept(y, x) FROM (VALUES {values}) t(x, y)) AS i, (SELECT regr_slope(y, x) FROM (VALUES {values}) t(x, y)) AS g, {', '.join(cols)} FROM {view}),
e AS (SELECT vec_id, z, {' + '.join(f'({c} - i - g * {v!r}) ** 2' for v, c in zip(x, cols))} AS sse FROM f),
v AS (SELECT vec_id, var_pop(y) * count(*) AS total FROM (SELECT vec_id, unnest([{', '.join(cols)}]) AS y FROM {view}) GROUP BY vec_id)
SELECT vec_id, z, round(1 - sse / nullif(total, 0), 6) AS quality FROM e JOIN v USING (vec_id)"""

    @query(f"avo_ig{n}_block_quality", sql(view, block))
    def block_quality(spark, sf_dir):
        df = _view(n)(spark, sf_dir)
        every = F.concat(*cols)
        mean = F.aggregate(every, F.lit(0.0), lambda s, v: s + v) / F.size(every)
        total = F.aggregate(every, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        keyed = df.withColumn("total", total)
        f = avo.fit_angles([F.col(c) for c in cols], degrees)
        return views.samples(keyed, *cols, keys=("vec_id", "total")).select("vec_id", "z", F.round(1 - f["sse"] / F.nullif("total", F.lit(0.0)), 6).alias("quality"))


_fit(3, [10.0, 20.0, 30.0])
_fit(4, [8.0, 16.0, 24.0, 32.0])
_fit(5, [6.0, 12.0, 18.0, 24.0, 30.0])


# The least-squares weights of the stacks for the three terms at 10, 20, 30 and at 8, 16, 24, 32 degrees, from the normal equations in exact fractions.
FATTI = {
    3: [[1.485890753511932, -0.576351822333069, 0.09046106882113719], [-1.7915935544228925, 6.01497421470928, -3.723380660286388], [-32.16343747752634, 55.03601558567109, -21.872578108144754]],
    4: [[1.0611960567764709, 0.2587273486838364, -0.43012393417665234, 0.1102005287163451], [-0.6728972789838158, 1.5419475527435202, 2.441788024172137, -2.8108382979318414], [-19.375782255298436, 10.124862806307062, 28.363384893653834, -18.11246544466246]],
}


def _fatti(n, degrees):
    cols = [f"s{i + 1}" for i in range(n)]
    names = ["rp", "rs", "rd"]
    terms = ", ".join(f"{' + '.join(f'{k!r}::DOUBLE * {c}' for k, c in zip(row, cols))} AS {name}" for row, name in zip(FATTI[n], names))
    body = f"f AS (SELECT *, {terms} FROM stacks)"
    if n == 4:  # what the terms leave of a sample, against the variation of all stacks of its trace
        left = " + ".join(f"power({c} - (1 + power(tan(radians({d})), 2)) * rp + 8 * power(sin(radians({d})), 2) / 2.25 * rs + (power(tan(radians({d})), 2) - 4 * power(sin(radians({d})), 2) / 2.25) * rd, 2)" for c, d in zip(cols, degrees))
        body += f", v AS (SELECT vec_id, var_pop(s) * count(*) AS total FROM (SELECT vec_id, unnest([{', '.join(cols)}]) AS s FROM stacks) GROUP BY vec_id) SELECT f.vec_id, z, round(rp, 5) AS rp, round(rs, 5) AS rs, round(rd, 5) AS rd, round(1 - ({left}) / nullif(total, 0), 5) AS quality FROM f JOIN v USING (vec_id)"
    else:
        body += " SELECT vec_id, z, round(rp, 5) AS rp, round(rs, 5) AS rs, round(rd, 5) AS rd FROM f"

    @query(f"fatti{n}", sql("stacks", body))
    def fitted(spark, sf_dir):
        s = _view(n)(spark, sf_dir).withColumn("total", avo.variation([F.col(c) for c in cols]))
        rows = views.samples(s, *cols, keys=("vec_id", "total"))
        got = avo.fit_fatti([F.col(c) for c in cols], degrees, F.col("total"))
        return rows.select("vec_id", "z", *[F.round(got[name], 5).alias(name) for name in ([*names, "quality"] if n == 4 else names)])


_fatti(3, [10.0, 20.0, 30.0])
_fatti(4, [8.0, 16.0, 24.0, 32.0])


@query("shuey_ig", sql("stacks", """v AS (SELECT vec_id, z, 3 + s1 AS vp, 1.5 + s2 / 2 AS vs, 2.2 + s3 / 4 AS rho FROM stacks),
l AS (SELECT a.vec_id, a.z, b.vp, b.vs, b.rho, c.vp AS vp1, c.vs AS vs1, c.rho AS rho1 FROM v a JOIN v b ON b.vec_id = a.vec_id AND b.z = greatest(a.z - 1, 0) JOIN v c ON c.vec_id = a.vec_id AND c.z = greatest(a.z, 1)),
r AS (SELECT vec_id, z, 2 * (vp1 - vp) / (vp + vp1) AS p, 2 * (vs1 - vs) / (vs + vs1) AS q, 2 * (rho1 - rho) / (rho + rho1) AS d, (vs + vs1) / (vp + vp1) AS k FROM l)
SELECT vec_id, z, round(0.5 * (p + d), 6) AS intercept, round(0.5 * p - 2 * k * k * (d + 2 * q), 6) AS gradient FROM r"""))
def shuey_ig(spark, sf_dir):
    """Each sample has the interface above it; the first has the first interface, too."""
    df = views.stacks(spark, sf_dir).select("vec_id", F.transform("s1", lambda x: 3 + x).alias("vp"), F.transform("s2", lambda x: 1.5 + x / 2).alias("vs"), F.transform("s3", lambda x: 2.2 + x / 4).alias("rho"))
    names = ("vp", "vs", "rho")
    above = {f"{c}0": F.concat(F.slice(c, F.lit(1), F.lit(1)), F.slice(c, F.lit(1), F.size(c) - 1)) for c in names}
    below = {c: F.concat(F.slice(c, F.lit(2), F.lit(1)), F.slice(c, F.lit(2), F.size(c) - 1)) for c in names}
    df = df.withColumns(above).withColumns(below)
    i, g = avo.shuey(*[F.col(c) for c in ("vp0", "vs0", "rho0", "vp", "vs", "rho")])
    return views.samples(df, "vp0", "vs0", "rho0", "vp", "vs", "rho").select("vec_id", "z", F.round(i, 6).alias("intercept"), F.round(g, 6).alias("gradient"))
