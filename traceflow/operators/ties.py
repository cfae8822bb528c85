"""Mistie tables: pairs of lines that cross, with their differences; and the corrections that adjust the network.

Columns: line_a, trc_a, line_b, trc_b, zdiff, phasediff, ampdiff, quality. Corrections: line, shift, phase, amp.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crossings import line_crossings
from .saved import discard, saved


def with_key(df: DataFrame) -> DataFrame:
    """Adds the key of a crossing, the same for (A, B) and (B, A), as the columns ka and kb."""
    a, b = F.struct(F.col("line_a").alias("l"), F.col("trc_a").alias("t")), F.struct(F.col("line_b").alias("l"), F.col("trc_b").alias("t"))
    return df.withColumns({"ka": F.least(a, b), "kb": F.greatest(a, b)})


def oriented(df: DataFrame) -> DataFrame:
    """Rows turned so that the smaller end comes first: differences change sign, the amplitude ratio is inverted."""
    turn = F.struct("line_a", "trc_a") > F.struct("line_b", "trc_b")
    swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return df.withColumns(
        {
            "line_a": swap("line_a", "line_b"), "trc_a": swap("trc_a", "trc_b"), "line_b": swap("line_b", "line_a"), "trc_b": swap("trc_b", "trc_a"),
            "zdiff": F.when(turn, -F.col("zdiff")).otherwise(F.col("zdiff")), "phasediff": F.when(turn, -F.col("phasediff")).otherwise(F.col("phasediff")),
            "ampdiff": F.when(turn, 1 / F.nullif("ampdiff", F.lit(0.0))).otherwise(F.col("ampdiff")),
        }
    )


def keep_first(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per crossing: the first in `order`."""
    w = Window.partitionBy("ka", "kb").orderBy(*order)
    return with_key(df).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "ka", "kb")


def upsert(old: DataFrame, new: DataFrame, replace: bool, order: list[str]) -> DataFrame:
    """old with new rows added; of a crossing in both, new's row counts if replace, else old's. Result rows are oriented."""
    both = oriented(old).withColumn("__new", F.lit(1 if replace else 0)).unionByName(oriented(new).withColumn("__new", F.lit(0 if replace else 1)))
    w = Window.partitionBy("line_a", "trc_a", "line_b", "trc_b").orderBy("__new", *order)  # oriented rows have their crossing's key in their own columns
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("line_a").alias("line")).union(df.select("line_b")).distinct()


def good(df: DataFrame, least_quality: float | None) -> DataFrame:
    return df if least_quality is None else df.where(F.col("quality") >= least_quality)


def residuals(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """zdiff, phasediff and ampdiff after corrections(line, shift, phase, amp); a row with a line that has none keeps its values."""
    side = lambda s: corrections.select(F.col("line").alias(f"line_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("shift", "phase", "amp")])
    j = df.join(side("a"), "line_a", "left").join(side("b"), "line_b", "left")
    both = F.col("shift_a").isNotNull() & F.col("shift_b").isNotNull()
    out = {
        "zdiff": F.when(both, F.col("zdiff") - F.col("shift_a") + F.col("shift_b")).otherwise(F.col("zdiff")),
        "phasediff": F.when(both, F.col("phasediff") - F.col("phase_a") + F.col("phase_b")).otherwise(F.col("phasediff")),
        "ampdiff": F.when(both, F.col("ampdiff") / F.nullif("amp_a", F.lit(0.0)) * F.col("amp_b")).otherwise(F.col("ampdiff")),
    }
    return j.withColumns(out).select(*df.columns)


def correction_of(name: str, corrections: DataFrame) -> DataFrame:
    """The correction of a name; "3D" means the first name that starts with it. No such name: 0, 0, 1."""
    hit = corrections.where(F.col("line").startswith("3D") if name == "3D" else F.col("line") == name).agg(F.min_by(F.struct("shift", "phase", "amp"), "line").alias("c"))
    return hit.select(F.lit(name).alias("line"), F.coalesce("c.shift", F.lit(0.0)).alias("shift"), F.coalesce("c.phase", F.lit(0.0)).alias("phase"), F.coalesce("c.amp", F.lit(1.0)).alias("amp"))


def merge_corrections(old: DataFrame, new: DataFrame, replace: bool) -> DataFrame:
    a, b = (new, old) if replace else (old, new)
    names = ("shift", "phase", "amp")
    j = a.select("line", *[F.col(c).alias(f"{c}_1") for c in names]).join(b.select("line", *[F.col(c).alias(f"{c}_2") for c in names]), "line", "full")
    return j.select("line", *[F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in names])


def new_corrections(df: DataFrame) -> DataFrame:
    return lines(df).select("line", F.lit(0.0).alias("shift"), F.lit(0.0).alias("phase"), F.lit(1.0).alias("amp"))


#: Corrections of so many lines at most (about 100 bytes each) are broadcast to the ties; more meet them by shuffled joins.
MOST_LINES = 1_000_000


def _met(rows: DataFrame, corrections: DataFrame, few: bool) -> DataFrame:
    """rows with the corrections ca and cb of both lines."""
    hint = F.broadcast if few else lambda df: df
    a = corrections.select(F.col("line").alias("line_a"), F.col("c").alias("ca"))
    b = corrections.select(F.col("line").alias("line_b"), F.col("c").alias("cb"))
    return rows.join(hint(a), "line_a").join(hint(b), "line_b")


def _jacobi(rows: DataFrame, corrections: DataFrame, references: list, damping: float, few: bool) -> DataFrame:
    """One damped step: each end of a tie moves by the mean of its residuals; reference lines stay at zero. A line's sums are combined before the shuffle."""
    r = _met(rows, corrections, few).withColumn("r", F.col("d") - F.col("ca") + F.col("cb"))
    ends = r.select(F.explode(F.array(F.struct(F.col("line_a").alias("line"), F.col("r").alias("v")), F.struct(F.col("line_b").alias("line"), (-F.col("r")).alias("v")))).alias("e")).groupBy("e.line").agg(F.avg("e.v").alias("step"))
    moved = F.col("c") + damping * F.coalesce("step", F.lit(0.0))
    return corrections.join(ends, "line", "left").select("line", F.when(F.col("line").isin(references), F.lit(0.0)).otherwise(moved).alias("c"))


def _turned(phase: str, ca: str, cb: str) -> Column:
    off = lambda d: F.abs(d - (F.col(ca) - F.col(cb)))
    d = F.col(phase)
    return F.when(off(d - 360) < off(d), d - 360).when(off(d + 360) < off(d), d + 360).otherwise(d)


def _rewrapped(rows: DataFrame, corrections: DataFrame, few: bool) -> DataFrame:
    """Phase observations turned by 360 degrees where that brings them nearer to the corrections' difference."""
    return _met(rows, corrections, few).withColumn("d", _turned("d", "ca", "cb")).select(*rows.columns)


def rms(rows: DataFrame, corrections: DataFrame, few: bool = False) -> float | None:
    r = F.col("d") - F.col("ca") + F.col("cb")
    return _met(rows, corrections, few).agg(F.sqrt(F.avg(r * r)).alias("x")).first().x


def amplitude_start(df: DataFrame, references: list) -> float:
    """The logarithm (base 10) of the amplitude that lines start with which meet no reference line: minus the mean of log10(ampdiff) of
    the ties of reference lines, seen from them; 0 without such ties. One number comes to the driver."""
    is_a, is_b = F.col("line_a").isin(references), F.col("line_b").isin(references)
    log = F.when(is_a, F.log10("ampdiff")).when(is_b, -F.log10("ampdiff"))
    return -(df.agg(F.avg(log).alias("x")).first().x or 0.0)


def start_values(df: DataFrame, references: list, start: float) -> DataFrame:
    """line, c of all lines: 0 for those that tie with a reference line, else start."""
    ends = df.select(F.explode(F.array("line_a", "line_b")).alias("line"), (F.col("line_a").isin(references) | F.col("line_b").isin(references)).alias("near"))
    return ends.groupBy("line").agg(F.max("near").alias("near")).select("line", F.when(F.col("near"), F.lit(0.0)).otherwise(F.lit(start)).alias("c"))


def adjust(df: DataFrame, value: str, references: list, least_quality: float = 0.5, iterations: int = 20, damping: float = 0.75, delta: float | None = None, phase: bool = False, start: DataFrame | None = None) -> DataFrame:
    """line, c: corrections that take the misties of a network down by damped Jacobi steps.

    value: the difference's column (a logarithm for amplitudes). delta: stop when the RMS changes by no more; this takes an action
    a step. start: line, c to start with, else all lines of good ties start at 0. Each step's corrections (one row a line) are checkpointed,
    so a step's plan doesn't hold those before; so are phases that were turned. Only the last step's corrections stay in the shared folder.
    """
    rows = good(df, least_quality).select("line_a", "line_b", F.col(value).alias("d")).persist(StorageLevel.MEMORY_AND_DISK)  # every step reads the ties
    cor = saved(start.select("line", "c") if start is not None else lines(rows).select("line", F.lit(0.0).alias("c")))
    few, last, kept = cor.count() <= MOST_LINES, None, rows
    for _ in range(iterations):
        before, cor = cor, saved(_jacobi(rows, cor, references, damping, few), 1 if few else None)
        discard(before)
        if phase:
            before, rows = rows, saved(_rewrapped(rows, cor, few))
            discard(before)
        if delta is not None:
            now = rms(rows, cor, few)
            if now is None or (last is not None and abs(last - now) <= delta):
                break
            last = now
    kept.unpersist()
    discard(rows)
    return cor


def _joint_step(rows: DataFrame, corrections: DataFrame, references: list, damping: float, few: bool, turn: bool) -> DataFrame:
    """One damped step of shift, phase and log_amp in one pass over rows(line_a, line_b, z, p, a); turned: whether a line has a phase that its corrections turn."""
    c = {"z": "shift", "p": "phase", "a": "log_amp"}
    hint = F.broadcast if few else lambda df: df
    side = lambda s: hint(corrections.select(F.col("line").alias(f"line_{s}"), *[F.col(v).alias(f"{k}_{s}") for k, v in c.items()]))
    j = rows.join(side("a"), "line_a").join(side("b"), "line_b")
    j = j.select("line_a", "line_b", *[(F.col(k) - F.col(f"{k}_a") + F.col(f"{k}_b")).alias(k) for k in "za"], (_turned("p", "p_a", "p_b") if turn else F.col("p")).alias("d"), "p", "p_a", "p_b")
    j = j.select("line_a", "line_b", "z", "a", (F.col("d") - F.col("p_a") + F.col("p_b")).alias("r"), (F.col("d") != F.col("p")).alias("turned"))
    ends = F.array(*[F.struct(F.col(f"line_{s}").alias("line"), *[(sign * F.col(v)).alias(k) for k, v in (("z", "z"), ("p", "r"), ("a", "a"))], "turned") for s, sign in (("a", 1.0), ("b", -1.0))])
    steps = j.select(F.explode(ends).alias("e")).groupBy("e.line").agg(*[F.avg(f"e.{k}").alias(k) for k in c], F.max("e.turned").alias("turned"))
    fixed = F.col("line").isin(references)
    moved = [F.when(fixed, F.lit(0.0)).otherwise(F.col(v) + damping * F.coalesce(k, F.lit(0.0))).alias(v) for k, v in c.items()]
    return corrections.drop("turned").join(steps, "line", "left").select("line", *moved, F.coalesce("turned", F.lit(False)).alias("turned"))


def _adjust_jointly(df: DataFrame, references: list, least_quality: float, iterations: int, damping: float) -> DataFrame:
    """line, shift, phase, log_amp after so many steps: the ties are written once and read once a step for all three. Phases are turned as they are read; only after a step that
    turned any are the ties written anew, so that the next turn goes on from there."""
    ties = saved(df.select("line_a", "line_b", F.col("zdiff").alias("z"), F.col("phasediff").alias("p"), F.log10("ampdiff").alias("a"), "ampdiff", "quality"))
    rows = good(ties, least_quality).select("line_a", "line_b", "z", "p", "a")
    start = start_values(ties, references, amplitude_start(ties, references))
    cor = saved(start.select("line", F.lit(0.0).alias("shift"), F.lit(0.0).alias("phase"), F.col("c").alias("log_amp")))
    few, own = cor.count() <= MOST_LINES, ties
    for i in range(iterations):
        before, cor = cor, saved(_joint_step(rows, cor, references, damping, few, turn=i > 0), 1 if few else None)  # phases are first turned by the first step's corrections
        if i < iterations - 1 and cor.where("turned").limit(1).count():
            c = before.select("line", F.col("phase").alias("c"))
            last, rows = own, saved(_rewrapped(rows.withColumnRenamed("p", "d"), c, few).withColumnRenamed("d", "p"))
            own = rows
            discard(last)
        discard(before)
    discard(own)
    return cor


def adjust_all(df: DataFrame, references: list, least_quality: float = 0.5, iterations: int = 200, damping: float = 0.75, delta: float | None = 1e-4) -> DataFrame:
    """line, shift, phase, amp: the three adjustments, amplitudes as logarithms from their start value; one after another if each stops by its own RMS (delta), else together."""
    if delta is None:
        return _adjust_jointly(df, references, least_quality, iterations, damping).select("line", "shift", "phase", F.pow(F.lit(10.0), "log_amp").alias("amp"))
    amp = df.withColumn("log_amp", F.log10("ampdiff"))
    z = adjust(df, "zdiff", references, least_quality, iterations, damping, delta).withColumnRenamed("c", "shift")
    p = adjust(df, "phasediff", references, least_quality, iterations, damping, delta, phase=True).withColumnRenamed("c", "phase")
    a = adjust(amp, "log_amp", references, least_quality, iterations, damping, delta, start=start_values(df, references, amplitude_start(df, references)))
    return a.join(z, "line", "left").join(p, "line", "left").select("line", F.coalesce("shift", F.lit(0.0)).alias("shift"), F.coalesce("phase", F.lit(0.0)).alias("phase"), F.pow(F.lit(10.0), "c").alias("amp"))


def erased(df: DataFrame, names: DataFrame) -> DataFrame:
    """Ties without those of the lines in names(line)."""
    for c in ("line_a", "line_b"):
        df = df.join(names.select(F.col("line").alias(c)).distinct(), c, "left_anti")
    return df


def with_values(df: DataFrame, new: DataFrame) -> DataFrame:
    """Ties with the values of new(line_a, trc_a, line_b, trc_b, ...) where it has the same crossing; null there keeps the old value."""
    keys, values = ["line_a", "trc_a", "line_b", "trc_b"], [c for c in new.columns if c not in ("line_a", "trc_a", "line_b", "trc_b")]
    j = df.join(new.select(*keys, *[F.col(c).alias(f"__{c}") for c in values]), keys, "left")
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in values}).select(*df.columns)


def shifted_horizon3d(horizon: DataFrame, corrections: DataFrame, factor: float = 1.0) -> DataFrame:
    """z of horizon(inl, crl, z) plus the shift of the correction named 3D, in the survey's units; without such a correction there is no row."""
    one = corrections.where(F.col("line").cast("string").startswith("3D")).agg(F.min_by("shift", "line").alias("__shift")).where("__shift is not null")
    return horizon.crossJoin(F.broadcast(one)).withColumn("z", F.col("z") + F.col("__shift") / factor).drop("__shift")  # one row


def shifted_horizon(horizon: DataFrame, corrections: DataFrame, factor: float = 1.0) -> DataFrame:
    """z of horizon(line, trcnr, z) plus its line's shift, in the survey's units; lines without a correction stay."""
    j = horizon.join(corrections.select("line", "shift"), "line", "left")
    return j.withColumn("z", F.col("z") + F.coalesce("shift", F.lit(0.0)) / factor).drop("shift")


def horizon_ties(horizon: DataFrame, crossings: DataFrame, factor: float = 1.0) -> DataFrame:
    """crossings with zdiff = (zB - zA) * factor of horizon(line, trcnr, z); 0 where either is undefined."""
    a, b = (horizon.select(F.col("line").alias(f"line_{s}"), F.col("trcnr").alias(f"trc_{s}"), F.col("z").alias(f"z_{s}")) for s in "ab")
    j = crossings.join(a, ["line_a", "trc_a"], "left").join(b, ["line_b", "trc_b"], "left")
    return j.select("line_a", "trc_a", "line_b", "trc_b", F.coalesce((F.col("z_b") - F.col("z_a")) * factor, F.lit(0.0)).alias("zdiff"))


def line_horizon_ties(stations: DataFrame, horizon: DataFrame, factor: float = 1.0) -> DataFrame:
    """The crossings of stations(line, trcnr, x, y) with x, y and zdiff as in horizon_ties; z of horizon(line, trcnr, z) comes along with the stations instead of meeting each crossing."""

    def zdiff(units, p, q):
        z = units["z"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        d = (z[q] - z[p]) * factor
        there = units["z"].is_valid().to_numpy(zero_copy_only=False)
        return {"zdiff": pa.array(np.where(there[p] & there[q], d, 0.0))}

    return line_crossings(stations, carried=horizon.select("line", "trcnr", "z"), out="zdiff double", value=zdiff)


def piece_means(df: DataFrame, key: str) -> DataFrame:
    """Per piece: mean zdiff, amplitude and quality, and the circular mean of the phases; null where no trace succeeded."""
    p = F.radians("phasediff")
    return df.groupBy(key).agg(F.avg("zdiff").alias("zdiff"), F.degrees(F.atan2(F.avg(F.sin(p)), F.avg(F.cos(p)))).alias("phasediff"), F.avg("ampdiff").alias("ampdiff"), F.avg("quality").alias("quality"))
