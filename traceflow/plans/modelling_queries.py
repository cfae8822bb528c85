"""Queries of modelling and inversion: the wavelet's taps and the weights of the angle are written out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.operators import modelling
from traceflow.sources import views

from .registry import query, sql

TAPS = [-0.2, 0.1, 1.0, 0.3, -0.1]


def _logs(spark, sf_dir):
    """vec_id, log: log impedances that begin and end at other samples in each trace; 0 where there is none."""
    t = views.traces(spark, sf_dir)
    inside = lambda z: (z >= F.col("vec_id") % 5) & (z <= 63 - F.col("vec_id") % 4)
    return t.select("vec_id", F.transform("samples", lambda x, z: F.when(inside(z), 8 + x).otherwise(F.lit(0.0))).alias("log"))


CONVOLVED = "-0.2 * coalesce(lead(d, 2) OVER w, 0) + 0.1 * coalesce(lead(d) OVER w, 0) + 1.0 * d + 0.3 * coalesce(lag(d) OVER w, 0) - 0.1 * coalesce(lag(d, 2) OVER w, 0)"


@query("poststack_modelling", sql("cube", f"""lg AS (SELECT vec_id, z, CASE WHEN z >= vec_id % 5 AND z <= 63 - vec_id % 4 THEN 8 + amp ELSE 0 END AS v FROM cube),
lim AS (SELECT vec_id, min(z) AS a, max(z) AS b FROM lg WHERE v <> 0 GROUP BY vec_id),
fl AS (SELECT l.vec_id, l.z, a, b, f.v FROM lg l JOIN lim USING (vec_id) JOIN lg f ON f.vec_id = l.vec_id AND f.z = greatest(a, least(b, l.z))),
sl AS (SELECT *, coalesce((lead(v) OVER w - lag(v) OVER w) / 2, 0) AS d FROM fl WINDOW w AS (PARTITION BY vec_id ORDER BY z))
SELECT vec_id, z, CASE WHEN z >= a AND z < b THEN round(({CONVOLVED}) / 2, 6) END AS value FROM sl WINDOW w AS (PARTITION BY vec_id ORDER BY z)"""))
def poststack_modelling(spark, sf_dir):
    got = modelling.poststack_modelling(_logs(spark, sf_dir), TAPS, "log", ["vec_id"])
    return views.samples(got, "value").select("vec_id", "z", F.round("value", 6).alias("value"))


PRE = """lg AS (SELECT vec_id, z, CASE WHEN z >= vec_id % 3 THEN 90 + 10 * s1 ELSE 0 END AS dt, CASE WHEN z <= 15 - vec_id % 2 THEN 180 + 15 * s2 ELSE 0 END AS ds, 2.3 + 0.2 * s3 AS rh FROM stacks),
l1 AS (SELECT vec_id, min(z) AS a, max(z) AS b FROM lg WHERE dt <> 0 GROUP BY vec_id), l2 AS (SELECT vec_id, max(z) AS b2 FROM lg WHERE ds <> 0 GROUP BY vec_id),
fl AS (SELECT l.vec_id, l.z, a, b, ln(1e6 / f.dt) AS p, ln(1e6 / g.ds) AS s, ln(l.rh) AS r, f.dt / g.ds AS ratio FROM lg l JOIN l1 USING (vec_id) JOIN l2 USING (vec_id) JOIN lg f ON f.vec_id = l.vec_id AND f.z = greatest(a, l.z) JOIN lg g ON g.vec_id = l.vec_id AND g.z = least(b2, l.z)),
m AS (SELECT *, avg(ratio) OVER (PARTITION BY vec_id) AS k FROM fl),
sl AS (SELECT vec_id, z, a, b, coalesce({terms}, 0) AS d FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY z))
SELECT vec_id, z, CASE WHEN z >= a AND z < b THEN round({conv}, 6) END AS value FROM sl WINDOW w AS (PARTITION BY vec_id ORDER BY z)"""
SLOPE = "((lead({c}) OVER w - lag({c}) OVER w) / 2)"
AKI = " + ".join(f"({g}) * {SLOPE.format(c=c)}" for g, c in (("0.5 / (cos(radians(12)) * cos(radians(12)))", "p"), ("-4 * k * k * sin(radians(12)) * sin(radians(12))", "s"), ("0.5 - 2 * k * k * sin(radians(12)) * sin(radians(12))", "r")))
FATTI = " + ".join(f"({g}) * {SLOPE.format(c=c)}" for g, c in (("0.5 * (1 + tan(radians(12)) * tan(radians(12)))", "p"), ("-4 * k * k * sin(radians(12)) * sin(radians(12))", "s"), ("2 * k * k * sin(radians(12)) * sin(radians(12)) - 0.5 * tan(radians(12)) * tan(radians(12))", "r")))


def _prestack(name, method, terms):
    @query(name, sql("stacks", PRE.format(terms=terms, conv=CONVOLVED)))
    def run(spark, sf_dir):
        s = views.stacks(spark, sf_dir)
        logs = s.select("vec_id", F.transform("s1", lambda x, z: F.when(z >= F.col("vec_id") % 3, 90 + 10 * x).otherwise(F.lit(0.0))).alias("dt"), F.transform("s2", lambda x, z: F.when(z <= 15 - F.col("vec_id") % 2, 180 + 15 * x).otherwise(F.lit(0.0))).alias("ds"), F.transform("s3", lambda x: 2.3 + 0.2 * x).alias("rh"))
        got = modelling.prestack_modelling(logs, TAPS, ["dt", "ds", "rh"], ["vec_id"], 12.0, method)
        return views.samples(got, "value").select("vec_id", "z", F.round("value", 6).alias("value"))


_prestack("prestack_akirich", "akirich", AKI)
_prestack("prestack_fatti", "fatti", FATTI)


@query("poststack_inversion")
def poststack_inversion(spark, sf_dir):
    """Log impedance from each trace, damped towards a smooth background by a constant of the whole volume."""
    t = views.traces(spark, sf_dir).withColumn("background", F.transform("samples", lambda _, z: 8 + 0.01 * z))
    got = modelling.poststack_inversion(t, modelling.ricker(25.0, 0.004, 12), "samples", "background", ["vec_id"])
    return views.samples(got, "impedance", "residual").select("vec_id", "z", F.round("impedance", 6).alias("impedance"), F.round("residual", 6).alias("residual"))
