"""Queries along single traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.functions import arrays as A
from traceflow.sources import views

from .registry import query, sql


def _array(name, make, body, views_sql="arr"):
    @query(name, sql(views_sql, body))
    def run(spark, sf_dir):
        df = views.traces(spark, sf_dir).select("vec_id", make(F.col("samples")).alias("v"))
        return views.samples(df, "v").select("vec_id", "z", F.round(F.col("v").cast("double"), 6).alias("value"))


def _list(expression):
    return f"SELECT vec_id, unnest(range(len(v))) AS z, round(CAST(unnest(v) AS DOUBLE), 6) AS value FROM (SELECT vec_id, {expression} AS v FROM arr)"


def _window(expression):
    return f"SELECT vec_id, z, round(CAST({expression} AS DOUBLE), 6) AS value FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


_array("mirror_pad", A.mirror_pad, _list("list_concat(list_concat(list_reverse(s[1:32]), s), list_reverse(s[33:64]))"))
_array("symmetric_pad", A.symmetric_pad, _list("list_concat(list_concat(list_reverse(s[2:33]), s), list_reverse(s[32:63]))"))
_array("fftshift", A.fft_shift, _list("list_concat(s[33:64], s[1:32])"))
TAPER = [0.0, 0.14644660940672627, 0.5, 0.8535533905932737, 1.0]
_array("cos_taper", lambda a: A.cos_taper(a, 5), f"SELECT vec_id, z, round(amp * CASE WHEN z < 5 THEN ({TAPER!r})[z + 1] WHEN z >= 59 THEN ({TAPER!r})[64 - z] ELSE 1.0 END, 6) AS value FROM cube", "cube")
_array("deramp", A.deramp, "SELECT vec_id, z, round(amp - (first + (last - first) * z / 63), 6) AS value FROM (SELECT *, first_value(amp) OVER w AS first, last_value(amp) OVER w AS last FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", "cube")
_array("win_sum", lambda a: A.window_sum(a, 5), _window("sum(amp) OVER w"), "cube")
_array("win_mean", lambda a: A.window_mean(a, 5), _window("avg(amp) OVER w"), "cube")
_array("win_ssq", lambda a: A.window_norm(a, 5), _window("sqrt(sum(amp * amp) OVER w)"), "cube")
_array("win_min", lambda a: A.window_min(a, 5), _window("min(amp) OVER w"), "cube")
_array("win_max", lambda a: A.window_max(a, 5), _window("max(amp) OVER w"), "cube")
_array("win_argmin", lambda a: A.window_arg(a, 5, False), _window("arg_min(z, {'v': amp, 'z': z}) OVER w"), "cube")
_array("win_argmax", lambda a: A.window_arg(a, 5, True), _window("arg_max(z, {'v': amp, 'z': -z}) OVER w"), "cube")
_array("tkeo", A.tkeo, "SELECT vec_id, z, round(amp * amp - coalesce(lag(amp) OVER w * lead(amp) OVER w, 0), 6) AS value FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z)", "cube")
FIR = [0.25, 0.5, 0.0, -0.5, -0.25]
_array("fir", lambda a: A.fir(a, FIR), "SELECT vec_id, z, round(" + " + ".join(f"{k!r} * coalesce({'lag' if j < 2 else 'lead'}(amp, {abs(j - 2)}) OVER w, 0)" for j, k in enumerate(FIR) if k) + ", 6) AS value FROM cube WINDOW w AS (PARTITION BY vec_id ORDER BY z)", "cube")
_array("zc_block", A.zero_crossing_block, """g AS (SELECT *, CASE WHEN amp < 0 THEN -1 ELSE 1 END AS sign FROM cube),
c AS (SELECT *, CASE WHEN sign <> lag(sign) OVER (PARTITION BY vec_id ORDER BY z) THEN 1 ELSE 0 END AS step FROM g),
l AS (SELECT *, sum(step) OVER (PARTITION BY vec_id ORDER BY z) AS lobe FROM c)
SELECT vec_id, z, round(CASE WHEN sign < 0 THEN min(amp) OVER (PARTITION BY vec_id, lobe) ELSE max(amp) OVER (PARTITION BY vec_id, lobe) END, 6) AS value FROM l""", "cube")


@query("analytic_statistics", sql("cube", "SELECT vec_id, round(avg(amp), 6) AS mean, round(var_samp(amp), 6) AS variance, round(median(amp), 6) AS median, round(quantile_cont(amp, 0.75) - quantile_cont(amp, 0.25), 6) AS iqr, round((SELECT avg(x) FROM (SELECT unnest(list(amp)) AS x) WHERE abs(x - avg(amp)) <= 1.5 * stddev_samp(amp)), 6) AS trimmed FROM cube GROUP BY vec_id"))
def analytic_statistics(spark, sf_dir):
    """Mean, variance, median, interquartile range and mean within 1.5 deviations, of each trace."""
    trace = F.col("samples")
    n = F.size(trace)
    mean = F.aggregate(trace, F.lit(0.0), lambda s, x: s + x) / n
    variance = F.aggregate(trace, F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / (n - 1)
    o = F.col("sorted")
    q = lambda p: F.get(o, F.floor((n - 1) * p).cast("int")) + ((n - 1) * p - F.floor((n - 1) * p)) * (F.get(o, F.ceil((n - 1) * p).cast("int")) - F.get(o, F.floor((n - 1) * p).cast("int")))
    df = views.traces(spark, sf_dir).withColumn("mean", mean).withColumn("variance", variance).withColumn("sorted", F.array_sort("samples"))
    inner = F.filter(trace, lambda x: F.abs(x - F.col("mean")) <= 1.5 * F.sqrt("variance"))
    trimmed = F.aggregate(inner, F.lit(0.0), lambda s, x: s + x) / F.size(inner)
    return df.select("vec_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round(q(0.5), 6).alias("median"), F.round(q(0.75) - q(0.25), 6).alias("iqr"), F.round(trimmed, 6).alias("trimmed"))
