"""Mistie and network-adjustment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceflow.operators import estimation, ties
from traceflow.operators.saved import new_path
from traceflow.sources import files, views

from .registry import query, sql

COLS = "line_a, trc_a, line_b, trc_b"
VALUES = ["zdiff", "phasediff", "ampdiff", "quality"]


def _rounded(df, *keys, values=VALUES, digits=6):
    return df.select(*keys, *[F.round(v, digits).alias(v) for v in values])


def _r(values=VALUES, digits=6):
    return ", ".join(f"round({v}, {digits}) AS {v}" for v in values)


KEY = "least({'l': line_a, 't': trc_a}, {'l': line_b, 't': trc_b}), greatest({'l': line_a, 't': trc_a}, {'l': line_b, 't': trc_b})"


@query("mistie_dedupe", sql("misties", f"d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY okey, zdiff, phasediff, ampdiff) AS n FROM misties) SELECT okey, {COLS}, {_r()} FROM d WHERE n = 1"))
def mistie_dedupe(spark, sf_dir):
    return _rounded(ties.keep_first(views.misties(spark, sf_dir), ["okey", "zdiff", "phasediff", "ampdiff"]), "okey", *COLS.split(", "))


for _replace in (True, False):
    _order = ["okey", "zdiff", "phasediff", "ampdiff"]

    def _upsert(spark, sf_dir, replace=_replace):
        m = views.misties(spark, sf_dir)
        turned = m.where("okey % 3 = 0").select("okey", F.col("line_b").alias("line_a"), F.col("trc_b").alias("trc_a"), F.col("line_a").alias("line_b"), F.col("trc_a").alias("trc_b"), (-F.col("zdiff")).alias("zdiff"), (-F.col("phasediff")).alias("phasediff"), (1 / F.col("ampdiff")).alias("ampdiff"), "quality")
        return _rounded(ties.upsert(m.where("okey % 3 <> 0"), turned, replace, ["okey", "zdiff", "phasediff", "ampdiff"]), "okey", *COLS.split(", "))

    query(f"mistie_upsert_{'replace' if _replace else 'keep'}", sql("misties", f"d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN (okey % 3 = 0) = {str(_replace).lower()} THEN 0 ELSE 1 END, okey, zdiff, phasediff, ampdiff) AS n FROM misties) SELECT okey, {COLS}, {_r()} FROM d WHERE n = 1"))(_upsert)


@query("mistie_lines", sql("misties", "SELECT line_a AS line FROM misties UNION SELECT line_b FROM misties"))
def mistie_lines(spark, sf_dir):
    return ties.lines(views.misties(spark, sf_dir))


@query("mistie_union", sql("misties", "SELECT okey, zdiff FROM misties UNION ALL SELECT okey, zdiff FROM misties WHERE quality >= 0.9"))
def mistie_union(spark, sf_dir):
    m = views.misties(spark, sf_dir)
    return m.unionByName(ties.good(m, 0.9)).select("okey", "zdiff")


@query("mistie_filter", sql("misties", f"SELECT okey, {COLS}, {_r()} FROM misties WHERE quality >= 0.75"))
def mistie_filter(spark, sf_dir):
    return _rounded(ties.good(views.misties(spark, sf_dir), 0.75), "okey", *COLS.split(", "))


CORR = "cor AS (SELECT s_suppkey AS line, CAST(s_acctbal AS DOUBLE) / 1000 AS shift, CAST(s_acctbal AS DOUBLE) / 100 AS phase, 1 + abs(CAST(s_acctbal AS DOUBLE)) / 10000 AS amp FROM supplier WHERE s_suppkey % 5 <> 0)"


def _corrections(spark, sf_dir):
    b = F.col("s_acctbal").cast("double")
    return views.table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("line"), (b / 1000).alias("shift"), (b / 100).alias("phase"), (1 + F.abs(b) / 10000).alias("amp"))


RES = """SELECT okey, line_a, trc_a, line_b, trc_b, round(CASE WHEN a.line IS NULL OR b.line IS NULL THEN zdiff ELSE zdiff - a.shift + b.shift END, 6) AS zdiff,
 round(CASE WHEN a.line IS NULL OR b.line IS NULL THEN phasediff ELSE phasediff - a.phase + b.phase END, 6) AS phasediff,
 round(CASE WHEN a.line IS NULL OR b.line IS NULL THEN ampdiff ELSE ampdiff / a.amp * b.amp END, 6) AS ampdiff, round(quality, 6) AS quality
FROM misties LEFT JOIN cor a ON a.line = line_a LEFT JOIN cor b ON b.line = line_b"""


@query("mistie_residual", sql("misties", CORR + " " + RES))
def mistie_residual(spark, sf_dir):
    return _rounded(ties.residuals(views.misties(spark, sf_dir), _corrections(spark, sf_dir)), "okey", *COLS.split(", "))


@query("mistie_merge_corrections", sql("misties", CORR + ", n AS (SELECT DISTINCT line_a AS line FROM misties UNION SELECT line_b FROM misties) SELECT line, coalesce(c.shift, 0) AS shift, coalesce(c.phase, 0) AS phase, coalesce(c.amp, 1) AS amp FROM n FULL JOIN cor c USING (line)"))
def mistie_merge_corrections(spark, sf_dir):
    return ties.merge_corrections(ties.new_corrections(views.misties(spark, sf_dir)), _corrections(spark, sf_dir), replace=True)


@query("glob_lookup", "WITH c AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN '3D survey ' || s_suppkey ELSE 'line ' || s_suppkey END AS line, CAST(s_acctbal AS DOUBLE) AS shift FROM supplier) SELECT '3D' AS line, arg_min(shift, line) AS shift, 0.0::DOUBLE AS phase, 1.0::DOUBLE AS amp FROM c WHERE line LIKE '3D%'")
def glob_lookup(spark, sf_dir):
    k = F.col("s_suppkey")
    cor = views.table(spark, sf_dir, "supplier").select(F.when(k % 7 == 0, F.concat(F.lit("3D survey "), k.cast("string"))).otherwise(F.concat(F.lit("line "), k.cast("string"))).alias("line"), F.col("s_acctbal").cast("double").alias("shift"), F.lit(0.0).alias("phase"), F.lit(1.0).alias("amp"))
    return ties.correction_of("3D", cor)


CROSSINGS = """sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(trcnr) OVER w AS nxt FROM stations WINDOW w AS (PARTITION BY line ORDER BY trcnr)),
cr AS (SELECT a.line AS line_a, b.line AS line_b, a.trcnr AS ta0, a.nxt AS ta1, b.trcnr AS tb0, b.nxt AS tb1, a.x, a.y, a.x2 - a.x AS dxa, a.y2 - a.y AS dya, b.x2 - b.x AS dxb, b.y2 - b.y AS dyb, b.x AS xb, b.y AS yb
  FROM sg a JOIN sg b ON a.line < b.line AND (a.line + b.line) % 2 = 1 AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL AND greatest(a.x, a.x2) >= least(b.x, b.x2) AND least(a.x, a.x2) <= greatest(b.x, b.x2) AND greatest(a.y, a.y2) >= least(b.y, b.y2) AND least(a.y, a.y2) <= greatest(b.y, b.y2)),
ct AS (SELECT *, (dxb * (y - yb) - dyb * (x - xb)) / nullif(dyb * dxa - dxb * dya, 0) AS ua, (dxa * (y - yb) - dya * (x - xb)) / nullif(dyb * dxa - dxb * dya, 0) AS ub FROM cr),
crossings AS (SELECT line_a, CASE WHEN ua < 0.5 THEN ta0 ELSE ta1 END AS trc_a, line_b, CASE WHEN ub < 0.5 THEN tb0 ELSE tb1 END AS trc_b, min(x + ua * dxa) AS x, arg_min(y + ua * dya, x + ua * dxa) AS y FROM ct WHERE ua BETWEEN 0 AND 1 AND ub BETWEEN 0 AND 1 GROUP BY ALL)"""


@query("line_crossings", sql("stations", CROSSINGS + " SELECT line_a, trc_a, line_b, trc_b, round(x, 6) AS x, round(y, 6) AS y FROM crossings"))
def line_crossings(spark, sf_dir):
    return _rounded(ties.line_crossings(views.stations2d(spark, sf_dir)), *COLS.split(", "), values=["x", "y"])


@query("mistie_horizon_2d", sql("stations", CROSSINGS + " SELECT line_a, trc_a, line_b, trc_b, round(coalesce((b.z - a.z) * 2, 0), 6) AS zdiff FROM crossings LEFT JOIN stations a ON a.line = line_a AND a.trcnr = trc_a LEFT JOIN stations b ON b.line = line_b AND b.trcnr = trc_b"))
def mistie_horizon_2d(spark, sf_dir):
    return _rounded(ties.line_horizon_ties(views.stations2d(spark, sf_dir), views.horizon2d(spark, sf_dir), 2.0), *COLS.split(", "), values=["zdiff"])


@query("mistie_estimate_2d")
def mistie_estimate_2d(spark, sf_dir):
    """Time, phase and amplitude differences at all crossings of 2-D lines, from the traces there; crossings without a trace keep 0, 0, 1, 0."""
    traces = views.line_traces(spark, sf_dir).select("line", "trcnr", F.lit(0.0).alias("z0"), F.lit(0.004).alias("step"), "samples")
    got = estimation.lines_by_traces(views.stations2d(spark, sf_dir), traces, (0.0, 0.252), 8 * 0.004)
    return got.select(*COLS.split(", "), *[F.round(v, 6).alias(v) for v in VALUES])


@query("mistie_2d3d_avg", sql("misties", "SELECT line_a, round(avg(zdiff), 6) AS zdiff, round(degrees(atan2(avg(sin(radians(phasediff))), avg(cos(radians(phasediff))))), 6) AS phasediff, round(avg(ampdiff), 6) AS ampdiff, round(avg(quality), 6) AS quality FROM misties GROUP BY line_a"))
def mistie_2d3d_avg(spark, sf_dir):
    return _rounded(ties.piece_means(views.misties(spark, sf_dir), "line_a"), "line_a")


@query("apply_horizon_shift", sql("horizon2d", CORR + " SELECT h.line, trcnr, round(z + coalesce(shift, 0) / 1000, 8) AS z FROM horizon2d h LEFT JOIN cor c ON c.line = h.line"))
def apply_horizon_shift(spark, sf_dir):
    return ties.shifted_horizon(views.horizon2d(spark, sf_dir), _corrections(spark, sf_dir), 1000.0).select("line", "trcnr", F.round("z", 8).alias("z"))


def _unrolled(value, k, where, wrap=False):
    parts = [f"r0 AS (SELECT line_a, line_b, {value} AS d FROM misties WHERE {where})", "c0 AS (SELECT line_a AS line, 0.0::DOUBLE AS c FROM r0 UNION SELECT line_b, 0.0::DOUBLE FROM r0)"]
    for i in range(k):
        parts.append(f"e{i} AS (SELECT line, avg(v) AS step FROM (SELECT line_a AS line, d - a.c + b.c AS v FROM r{i} JOIN c{i} a ON a.line = line_a JOIN c{i} b ON b.line = line_b UNION ALL SELECT line_b, -(d - a.c + b.c) FROM r{i} JOIN c{i} a ON a.line = line_a JOIN c{i} b ON b.line = line_b) GROUP BY line)")
        parts.append(f"c{i + 1} AS (SELECT line, CASE WHEN line = 1 THEN 0.0 ELSE c + 0.75 * coalesce(step, 0) END AS c FROM c{i} LEFT JOIN e{i} USING (line))")
        d = f"CASE WHEN abs(d - 360 - (a.c - b.c)) < abs(d - (a.c - b.c)) THEN d - 360 WHEN abs(d + 360 - (a.c - b.c)) < abs(d - (a.c - b.c)) THEN d + 360 ELSE d END" if wrap else "d"
        parts.append(f"r{i + 1} AS (SELECT line_a, line_b, {d} AS d FROM r{i} JOIN c{i + 1} a ON a.line = line_a JOIN c{i + 1} b ON b.line = line_b)")
    return sql("misties", ", ".join(parts) + f" SELECT line, round(c, 6) AS c FROM c{k}")


@query("adjust_z_k5", _unrolled("zdiff", 5, "quality >= 0.75"))
def adjust_z_k5(spark, sf_dir):
    return ties.adjust(views.misties(spark, sf_dir), "zdiff", [1], 0.75, 5).withColumn("c", F.round("c", 6))


@query("adjust_phase_k3", _unrolled("phasediff * 10", 3, "quality >= 0.75", True))
def adjust_phase_k3(spark, sf_dir):
    m = views.misties(spark, sf_dir).withColumn("p", F.col("phasediff") * 10)
    return ties.adjust(m, "p", [1], 0.75, 3, phase=True).withColumn("c", F.round("c", 6))


@query("adjust_amp_k5", _unrolled("log10(ampdiff)", 5, "quality >= 0.75"))
def adjust_amp_k5(spark, sf_dir):
    m = views.misties(spark, sf_dir).withColumn("l", F.log10("ampdiff"))
    return ties.adjust(m, "l", [1], 0.75, 5).withColumn("c", F.round("c", 6))


AMP_START = """g AS (SELECT * FROM misties), st AS (SELECT coalesce(-avg(CASE WHEN line_a IN (1, 2) THEN log10(ampdiff) WHEN line_b IN (1, 2) THEN -log10(ampdiff) END), 0) AS s FROM g),
en AS (SELECT line_a AS line, line_a IN (1, 2) OR line_b IN (1, 2) AS near FROM g UNION ALL SELECT line_b, line_a IN (1, 2) OR line_b IN (1, 2) FROM g)"""


@query("amplitude_start", sql("misties", AMP_START + " SELECT line, round(CASE WHEN bool_or(near) THEN 0 ELSE any_value(s) END, 6) AS c FROM en, st GROUP BY line"))
def amplitude_start(spark, sf_dir):
    m = views.misties(spark, sf_dir)
    return ties.start_values(m, [1, 2], ties.amplitude_start(m, [1, 2])).withColumn("c", F.round("c", 6))


@query("mistie_erase", sql("misties", f"SELECT okey, {COLS}, {_r()} FROM misties WHERE line_a % 3 <> 0 AND line_b % 3 <> 0"))
def mistie_erase(spark, sf_dir):
    m = views.misties(spark, sf_dir)
    return _rounded(ties.erased(m, ties.lines(m).where("line % 3 = 0")), "okey", *COLS.split(", "))


@query("mistie_set_values", sql("misties", "u AS (SELECT line_a, trc_a, line_b, trc_b, max(zdiff) + 1 AS nz FROM misties WHERE okey % 4 = 0 GROUP BY ALL) SELECT okey, line_a, trc_a, line_b, trc_b, round(coalesce(nz, zdiff), 6) AS zdiff, round(quality, 6) AS quality FROM misties LEFT JOIN u USING (line_a, trc_a, line_b, trc_b)"))
def mistie_set_values(spark, sf_dir):
    m = views.misties(spark, sf_dir)
    new = m.where("okey % 4 = 0").groupBy(*COLS.split(", ")).agg((F.max("zdiff") + 1).alias("zdiff"))
    return _rounded(ties.with_values(m, new), "okey", *COLS.split(", "), values=["zdiff", "quality"])


@query("correction_upsert_keep", sql("misties", CORR + ", n AS (SELECT DISTINCT line_a AS line FROM misties UNION SELECT line_b FROM misties) SELECT line, CASE WHEN n.line IS NULL THEN shift ELSE 0 END AS shift, CASE WHEN n.line IS NULL THEN phase ELSE 0 END AS phase, CASE WHEN n.line IS NULL THEN amp ELSE 1 END AS amp FROM n FULL JOIN cor c USING (line)"))
def correction_upsert_keep(spark, sf_dir):
    return ties.merge_corrections(ties.new_corrections(views.misties(spark, sf_dir)), _corrections(spark, sf_dir), replace=False)


@query("apply_horizon_shift_3d", sql("points", "c AS (SELECT arg_min(CAST(s_acctbal AS DOUBLE), s_name) AS shift FROM supplier WHERE s_suppkey % 7 = 0) SELECT id, round(v + shift / 1000, 6) AS z FROM points, c"))
def apply_horizon_shift_3d(spark, sf_dir):
    cor = views.table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("3D "), F.col("s_name")).alias("line"), F.col("s_acctbal").cast("double").alias("shift"))
    return ties.shifted_horizon3d(views.points(spark, sf_dir).select("id", F.col("v").alias("z")), cor, 1000.0).select("id", F.round("z", 6).alias("z"))


@query("adjust_network")
def adjust_network(spark, sf_dir):
    """Time, phase and amplitude corrections by the default number of steps, one after another."""
    got = ties.adjust_all(views.misties(spark, sf_dir), [1], 0.75, 20, 0.75, None)
    return got.select("line", *[F.round(c, 6).alias(c) for c in ("shift", "phase", "amp")])


#: Ties under names of lines (strings, so their ends are ordered as strings); those of every third order come from the second file.
NAMED = "named AS (SELECT okey, CAST(line_a AS VARCHAR) AS na, trc_a, CAST(line_b AS VARCHAR) AS nb, trc_b, zdiff, phasediff, ampdiff, quality, {'l': CAST(line_a AS VARCHAR), 't': trc_a} > {'l': CAST(line_b AS VARCHAR), 't': trc_b} AS turn FROM misties), turned AS (SELECT CAST(okey AS DOUBLE) AS x, CASE WHEN turn THEN nb ELSE na END AS line_a, CASE WHEN turn THEN trc_b ELSE trc_a END AS trc_a, CASE WHEN turn THEN na ELSE nb END AS line_b, CASE WHEN turn THEN trc_a ELSE trc_b END AS trc_b, round(CASE WHEN turn THEN -zdiff ELSE zdiff END, 6) + 0.0 AS zdiff, round(CASE WHEN turn THEN -phasediff ELSE phasediff END, 6) + 0.0 AS phasediff, round(CASE WHEN turn THEN 1 / ampdiff ELSE ampdiff END, 6) AS ampdiff, round(quality, 6) + 0.0 AS quality, okey % 3 = 0 AS second FROM named)"

for _name, _merge, _replace, _which in (("replace", True, True, "CASE WHEN second THEN 0 ELSE 1 END"), ("keep", True, False, "CASE WHEN second THEN 1 ELSE 0 END"), ("anew", False, True, None)):

    def _from_files(spark, sf_dir, merge=_merge, replace=_replace):
        m = views.misties(spark, sf_dir).withColumns({"line_a": F.col("line_a").cast("string"), "line_b": F.col("line_b").cast("string"), "x": F.col("okey").cast("double"), "y": F.lit(0.0)})
        first, second = new_path(spark), new_path(spark)
        files.write_ties(m.where("okey % 3 <> 0"), first, "gzip")
        files.write_ties(m.where("okey % 3 = 0"), second, "gzip")
        got = files.merge_ties(files.read_ties(spark, first), second, merge, replace)
        return got.select("x", *COLS.split(", "), *[(F.round(v, 6) + F.lit(0.0)).alias(v) for v in VALUES])

    _ranked = f"r AS (SELECT *, row_number() OVER (PARTITION BY {COLS} ORDER BY {_which or '0'}, x, zdiff, phasediff, ampdiff) AS n FROM turned{'' if _merge else ' WHERE second'})"
    query(f"mistie_files_{_name}", sql("misties", f"{NAMED}, {_ranked} SELECT x, {COLS}, zdiff, phasediff, ampdiff, quality FROM r WHERE n = 1"))(_from_files)


@query("correction_file", sql("misties", CORR + " SELECT CAST(line AS VARCHAR) AS line, CAST(shift AS DOUBLE) AS shift, CAST(phase AS DOUBLE) AS phase, CAST(amp AS DOUBLE) AS amp FROM cor"))
def correction_file(spark, sf_dir):
    """All corrections written to a file of the survey's format and read back."""
    path = new_path(spark)
    files.write_corrections(_corrections(spark, sf_dir), path)
    return files.read_corrections(spark, path)
