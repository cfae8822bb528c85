"""Reading parts of trace volumes: ranges of lines and samples, traces at given positions, extents, and volumes side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(column: str, limits: tuple[int, int] | None) -> Column:
    return F.lit(True) if limits is None else F.col(column).between(*limits)


def trace_range(traces: DataFrame, inl: tuple[int, int] | None = None, crl: tuple[int, int] | None = None, z: tuple[int, int] | None = None, samples: str = "samples") -> DataFrame:
    """Traces of a range of inlines and crosslines, their samples cut to z (all limits inclusive). A 2-D line is one inline, its trace numbers are crosslines."""
    got = traces.where(between("inl", inl) & between("crl", crl))
    return got if z is None else got.withColumn(samples, F.slice(samples, z[0] + 1, z[1] - z[0] + 1))


def traces_at(traces: DataFrame, positions: DataFrame) -> DataFrame:
    """The traces at positions(inl, crl): an equi-join; positions without a trace have no row."""
    return positions.select("inl", "crl").distinct().join(traces, ["inl", "crl"])


def volume_range(traces: DataFrame, samples: str = "samples") -> DataFrame:
    """One row: first, last and step of inlines and crosslines, and the number of samples. A step is the smallest distance of two neighbours."""
    from pyspark.sql import Window

    def axis(c: str) -> DataFrame:
        values = traces.select(c).distinct()
        part = values.withColumn("part", F.floor(F.col(c) / 4096))  # neighbours within a part; parts meet by their ends
        inner = part.withColumn("d", F.col(c) - F.lag(c).over(Window.partitionBy("part").orderBy(c)))
        ends = part.groupBy("part").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        gaps = ends.withColumn("d", F.col("lo") - F.lag("hi").over(Window.orderBy("part")))
        steps = inner.select("d").unionByName(gaps.select("d")).agg(F.min("d").alias(f"{c}_step"))
        return values.agg(F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1")).crossJoin(F.broadcast(steps))  # one row each

    n = traces.agg(F.max(F.size(samples)).cast("long").alias("n_samples"))
    return axis("inl").crossJoin(F.broadcast(axis("crl"))).crossJoin(F.broadcast(n))


def common_range(ranges: DataFrame, key: str, start: str = "z0", stop: str = "z1") -> DataFrame:
    """Per key the range that all its datasets share, and its middle; none if they don't overlap."""
    got = ranges.groupBy(key).agg(F.max(start).alias("z0"), F.min(stop).alias("z1")).where("z0 <= z1")
    return got.withColumn("middle", (F.col("z0") + F.col("z1")) / 2)


def side_by_side(first: DataFrame, second: DataFrame, names: tuple[str, str], samples: tuple[str, str] = ("samples", "samples")) -> DataFrame:
    """inl, crl and both volumes' samples where both have a trace: one equi-join on the position."""
    a, b = (v.select("inl", "crl", F.col(s).alias(n)) for v, s, n in zip((first, second), samples, names))
    return a.join(b, ["inl", "crl"])


def steps_agree(first: DataFrame, second: DataFrame) -> bool:
    """Whether two volumes have the same inline and crossline steps, as inputs of one attribute must. Two rows come to the driver."""
    steps = [volume_range(v).select("inl_step", "crl_step").first() for v in (first, second)]
    return steps[0] == steps[1]


def default_gate(z_step: float, length: float) -> tuple[float, float]:
    """A gate of about `length` around the sample, in whole steps."""
    n = round(length / z_step) * z_step
    return -n, n


def component_names(z_step: float, step: float) -> list[str]:
    """Names of the outputs of a spectrum: a frequency each, below the Nyquist frequency."""
    nyquist = 0.5 / z_step
    names, f = [], step
    while f < nyquist:
        names.append(f"{f:g} Hz")
        f += step
    return names


def displayed_frequency(step: float, nyquist: float, in_depth: bool) -> float:
    """The step of frequencies as shown: within 0.5 and half the Nyquist frequency, times 1000 where z is a depth."""
    return min(max(step, 0.5), nyquist / 2) * (1000 if in_depth else 1)


def mode_index(selected: Column | int, most: int) -> Column:
    """A selected mode, within the modes that there are."""
    return F.least(F.lit(most - 1), selected if isinstance(selected, Column) else F.lit(selected))
