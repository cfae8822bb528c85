"""Misties from data: 2-D lines against each other and against a volume, by traces or by horizons, in one table; and corrections applied to traces.

Traces are rows with an array of samples, its first z (z0) and its step. Ties are line_a, trc_a, line_b, trc_b, x, y, zdiff, phasediff, ampdiff, quality;
a tie whose traces are absent or without energy keeps 0, 0, 1, 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ties
from .crossings import line_crossings
from .lists import arrays, lengths, matrix
from .spectral import tie_estimate

#: Largest lag and gate for each kind of z (seconds, metres, feet).
DEFAULTS = {"time": {"longest": 0.1, "gate": (0.5, 1.5)}, "metres": {"longest": 150.0, "gate": (750.0, 2500.0)}, "feet": {"longest": 300.0, "gate": (2400.0, 8200.0)}}
VALUES = ("zdiff", "phasediff", "ampdiff", "quality")


def shift_estimate(a: np.ndarray, b: np.ndarray, dt: float, longest: float) -> dict[str, np.ndarray]:
    """Shift and quality that take trace a to trace b, by their cross-correlation alone; phases are 0 and ratios 1."""
    n = a.shape[1]
    size = 2 * n
    cc = np.fft.irfft(np.fft.rfft(b, size, axis=1) * np.conj(np.fft.rfft(a, size, axis=1)), size, axis=1)
    most = min(max(1, int(longest / dt)), n)
    lags = np.concatenate([np.arange(most), np.arange(-most, 0)])
    at = lags[np.argmax(cc[:, lags % size], 1)]
    r = np.arange(len(a))
    m, l, h = cc[r, at % size], cc[r, (at - 1) % size], cc[r, (at + 1) % size]
    with np.errstate(all="ignore"):
        part = np.nan_to_num((l - h) / (2 * l - 4 * m + 2 * h))
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        ok = (na > 0) & (nb > 0)
        quality = np.where(ok, np.minimum(1, (m - 0.25 * (l - h) * part) / (na * nb)), 0.0)
    out = {"zdiff": np.where(ok, (at + part) * dt, 0.0), "phasediff": np.zeros(len(a)), "ampdiff": np.ones(len(a)), "quality": quality}
    return {k: v[:, None] for k, v in out.items()}


def resampled(samples: np.ndarray, z0: float, step: float, gate: tuple[float, float], new_step: float) -> np.ndarray:
    """Traces [.., z] of one beginning and step, within a gate at another step: linear between samples, 0 beyond the ends and where they are undefined."""
    z = gate[0] + new_step * np.arange(int(round((gate[1] - gate[0]) / new_step)) + 1)
    n = samples.shape[-1]
    if not n:
        return np.zeros((*samples.shape[:-1], len(z)))
    x, at = np.nan_to_num(samples), np.round((z - z0) / step, 9)
    low = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
    part = at - low
    return np.where((at >= 0) & (at <= n - 1), (1 - part) * x[..., low] + part * x[..., np.minimum(low + 1, n - 1)], 0.0)


def estimated(pairs: DataFrame, keys: list[str], gate: tuple[float, float], longest: float, z_only: bool = False, factor: float = 1.0) -> DataFrame:
    """keys, VALUES and ok (both traces have energy in the gate) of pairs with a_samples, a_z0, a_step and b_samples, b_z0, b_step; null traces are absent.

    Both traces of a pair are brought to the smaller of their steps within the gate. factor turns z into the unit of zdiff.
    """
    columns = [f"{s}_{c}" for s in "ab" for c in ("samples", "z0", "step")]
    df = pairs.select(*keys, *columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keys)]] + [f"{v} double" for v in VALUES] + ["ok boolean"])

    def run(batches):
        for b in batches:
            n = b.num_rows
            out = {"zdiff": np.zeros(n), "phasediff": np.zeros(n), "ampdiff": np.ones(n), "quality": np.zeros(n)}
            fine = np.zeros(n, bool)
            held = {c: b.column(c) for c in columns}
            number = {c: held[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns if not c.endswith("samples")}
            there = (held["a_samples"].is_valid().to_numpy(zero_copy_only=False) & held["b_samples"].is_valid().to_numpy(zero_copy_only=False)).astype(bool)
            for c in number:
                there &= np.isfinite(number[c])
            size = {k: lengths(held[f"{k}_samples"]) for k in "ab"}
            rows = np.flatnonzero(there)
            # rows whose traces begin alike, with like steps and lengths, are taken together
            kinds, of = np.unique(np.stack([*(number[f"{k}_{c}"][rows] for k in "ab" for c in ("z0", "step")), size["a"][rows], size["b"][rows]], 1), axis=0, return_inverse=True)
            for i, (a_z0, a_step, b_z0, b_step, _, _) in enumerate(kinds.tolist()):
                every = rows[of.ravel() == i]
                s = min(a_step, b_step)
                for at in np.array_split(every, -(-len(every) // 256)):
                    x, y = (resampled(matrix(held[f"{k}_samples"].take(pa.array(at)), 0.0), z0, step, gate, s) for k, z0, step in (("a", a_z0, a_step), ("b", b_z0, b_step)))
                    got = (shift_estimate if z_only else tie_estimate)(x, y, s, longest)
                    fine[at] = (x != 0).any(1) & (y != 0).any(1)
                    for v in VALUES:
                        out[v][at] = got[v][:, 0]
            out["zdiff"] = out["zdiff"] * factor
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(out[v]) for v in VALUES] + [pa.array(fine)], names=[*keys, *VALUES, "ok"])

    return df.mapInArrow(run, schema)


def pair_estimates(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, dt: float, longest: float, z_only: bool = False, rows: int = 2048) -> dict[str, np.ndarray]:
    """VALUES that take trace x[p] to trace y[q], for many pairs of few traces: as tie_estimate, or shift_estimate if z_only, with one spectrum a trace and only the lags looked at."""
    n = x.shape[1]
    size, most = 2 * n, max(1, int(longest / dt))
    most = min(most, n) if z_only else most
    lags = np.arange(-most - 1, most + 1)
    f = np.arange(n + 1)
    place, column = np.unique(lags % size, return_inverse=True)  # lags beyond the traces come round again
    back = np.where((f == 0) | (f == n), 1.0, 2.0)[:, None] / size * np.exp(2j * np.pi * (f[:, None] * place % size) / size)
    fx, fy = np.conj(np.fft.rfft(x, size, axis=1)), np.fft.rfft(y, size, axis=1)
    ex, ey = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    order = np.concatenate([np.arange(most), np.arange(-most, 0)]) + most + 1  # of equal peaks the first of these counts
    out = {v: np.empty(len(p)) for v in VALUES}
    for k in range(0, len(p), rows):
        of = slice(k, k + rows)
        full = ((fx[p[of]] * fy[q[of]]) @ back)[:, column]
        cc = full.real if z_only else np.abs(full)
        at, r = order[np.argmax(cc[:, order], 1)], np.arange(len(full))
        m, l, h = cc[r, at], cc[r, at - 1], cc[r, at + 1]
        na, nb = ex[p[of]], ey[q[of]]
        ok = (na > 0) & (nb > 0)
        with np.errstate(all="ignore"):
            part = np.nan_to_num((l - h) / (2 * l - 4 * m + 2 * h))
            out["quality"][of] = np.where(ok, np.minimum(1, (m - 0.25 * (l - h) * part) / (na * nb)), 0.0)
            out["zdiff"][of] = np.where(ok, (lags[at] + part) * dt, 0.0)
            if z_only:
                out["phasediff"][of], out["ampdiff"][of] = 0.0, 1.0
            else:
                p0 = np.angle(full[r, at])
                p1 = np.angle(full[r, at + np.sign(part).astype(int)])
                out["phasediff"][of] = np.where(ok, np.degrees(p0 + np.abs(part) * np.angle(np.exp(1j * (p1 - p0)))), 0.0)
                out["ampdiff"][of] = np.where(ok, nb / na, 1.0)
    return out


def packed(traces: DataFrame) -> DataFrame:
    """line, trcnr, z0, step, n and the samples of traces as bytes: 4 a sample where that is exact, else 8; undefined ones as zero, as `resampled` takes them."""
    df = traces.select("line", "trcnr", F.col("z0").cast("double").alias("z0"), F.col("step").cast("double").alias("step"), "samples").where("samples is not null")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:4]) + ", n int, samples binary"

    def run(batches):
        for b in batches:
            size, bytes_ = lengths(b.column("samples")), [b""] * b.num_rows
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = matrix(b.column("samples").take(pa.array(at)), 0.0)
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                small = (short == x).all(1)
                for k, i in enumerate(at):
                    bytes_[i] = (short if small[k] else x.astype("<f8"))[k].tobytes() if n else b""
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("line", "trcnr", "z0", "step")], pa.array(size, pa.int32()), pa.array(bytes_, pa.binary())], names=["line", "trcnr", "z0", "step", "n", "samples"])

    return df.mapInArrow(run, schema)


def _unpacked(samples: pa.Array, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[row, sample] of the packed samples of rows `at`, all of one length."""
    held = samples.take(pa.array(at)).to_pylist()
    length = int(n[at[0]])
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * length else "<f8").astype(float) for x in held]) if length else np.zeros((len(at), 0))


def ties_of_units(gate: tuple[float, float], longest: float, z_only: bool, factor: float):
    """value for crossings.line_crossings: VALUES of pairs of units with packed traces. Both traces of a pair are brought to the smaller of their steps within the gate."""

    def value(units, p, q):
        number = {c: units[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("z0", "step", "n")}
        there = units["samples"].is_valid().to_numpy(zero_copy_only=False) & np.isfinite(number["z0"]) & np.isfinite(number["step"])
        out = {"zdiff": np.zeros(len(p)), "phasediff": np.zeros(len(p)), "ampdiff": np.ones(len(p)), "quality": np.zeros(len(p))}
        used = np.unique(np.concatenate([p, q]))
        used = used[there[used]]
        # traces that begin alike, with like steps and lengths, are taken together
        kinds, of = np.unique(np.stack([number[c][used] for c in ("z0", "step", "n")], 1), axis=0, return_inverse=True)
        kind, row = np.full(len(there), -1), np.zeros(len(there), np.int64)
        traces = []
        for i in range(len(kinds)):
            at = used[of.ravel() == i]
            kind[at], row[at] = i, np.arange(len(at))
            traces.append(_unpacked(units["samples"], number["n"], at))
        for i, (z0, step, _) in enumerate(kinds):
            for j, (z0_b, step_b, _) in enumerate(kinds):
                pairs = np.flatnonzero((kind[p] == i) & (kind[q] == j))
                if len(pairs):
                    s = min(step, step_b)
                    x, y = resampled(traces[i], z0, step, gate, s), resampled(traces[j], z0_b, step_b, gate, s)
                    for v, got in pair_estimates(x, y, row[p[pairs]], row[q[pairs]], s, longest, z_only).items():
                        out[v][pairs] = got
        out["zdiff"] = out["zdiff"] * factor
        return {v: pa.array(out[v]) for v in VALUES}

    return value


def _side(traces: DataFrame, side: str, **names: str) -> DataFrame:
    return traces.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).alias(f"{side}_{c}") for c in ("samples", "z0", "step")])


def lines_by_traces(stations: DataFrame, traces: DataFrame, gate: tuple[float, float], longest: float, z_only: bool = False, factor: float = 1.0) -> DataFrame:
    """Ties of 2-D lines at the crossings of stations(line, trcnr, x, y), from traces(line, trcnr, z0, step, samples), each once; none is lost. Traces go with the stations to the places where
    crossings are found, so neither they nor the ties are shuffled by crossing."""
    return line_crossings(stations, carried=packed(traces), out=", ".join(f"{v} double" for v in VALUES), value=ties_of_units(gate, longest, z_only, factor))


def overlaps(stations: DataFrame, nodes: DataFrame) -> DataFrame:
    """line, piece, trc1, trc2, x, y: the stretches of lines(line, trcnr, x, y) within the box of nodes(ix, iy), by the traces nearest to their ends, the smaller first; x, y: where a stretch begins."""
    box = nodes.agg(*[f(c).cast("double").alias(n) for c, a in (("ix", "x"), ("iy", "y")) for f, n in ((F.min, f"{a}_low"), (F.max, f"{a}_high"))]).where("x_low is not null")
    w = Window.partitionBy("line").orderBy("trcnr")
    seg = stations.select("line", "trcnr", F.lead("trcnr").over(w).alias("next"), *[F.col(c).cast("double").alias(f"{c}1") for c in "xy"], *[F.lead(F.col(c).cast("double")).over(w).alias(f"{c}2") for c in "xy"])
    seg = seg.where("next is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null").crossJoin(F.broadcast(box))  # one row
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for c in "xy":
        d = F.col(f"{c}2") - F.col(f"{c}1")
        s, t = F.try_divide(F.col(f"{c}_low") - F.col(f"{c}1"), d), F.try_divide(F.col(f"{c}_high") - F.col(f"{c}1"), d)
        inside = F.col(f"{c}1").between(F.col(f"{c}_low"), F.col(f"{c}_high"))
        low.append(F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(s, t)))
        high.append(F.when(d == 0, 1.0).otherwise(F.greatest(s, t)))
    seg = seg.withColumns({"low": F.greatest(*low), "high": F.least(*high)}).withColumn("on", F.coalesce(F.col("low") <= F.col("high"), F.lit(False)))
    fresh = (F.col("low") > 0) | ~F.coalesce(F.lag(F.col("on") & (F.col("high") >= 1)).over(w), F.lit(False))
    pieces = seg.withColumn("fresh", fresh.cast("long")).where("on").withColumn("piece", F.sum("fresh").over(w))
    near = lambda t: F.when(F.col(t) < 0.5, F.col("trcnr")).otherwise(F.col("next"))
    at = F.struct(near("low").alias("trc"), *[(F.col(f"{c}1") + F.col("low") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xy"])
    ends = pieces.groupBy("line", "piece").agg(F.min_by(at, "trcnr").alias("first"), F.max_by(near("high"), "trcnr").alias("last"))
    return ends.select("line", "piece", F.least("first.trc", "last").alias("trc1"), F.greatest("first.trc", "last").alias("trc2"), "first.x", "first.y")


def _traces_of(pieces: DataFrame, step: int) -> DataFrame:
    """pieces with the trace numbers they look at: every step-th but the last, or the middle one of a short piece."""
    steps = F.floor((F.col("trc2") - F.col("trc1")) / step).cast("long")
    numbers = F.when(steps >= 1, F.sequence(F.col("trc1"), F.col("trc1") + (steps - 1) * step, F.lit(step).cast("long"))).otherwise(F.array(F.floor((F.col("trc1") + F.col("trc2")) / 2).cast("long")))
    return pieces.withColumn("trcnr", F.explode(numbers))


def volume_by_traces(pieces: DataFrame, stations: DataFrame, traces: DataFrame, volume: DataFrame, gate: tuple[float, float], longest: float, name: str = "3D", step: int = 1, z_only: bool = False, factor: float = 1.0) -> DataFrame:
    """Ties of a volume(ix, iy, z0, step, samples) with the pieces of lines in it: means over the traces that both have, phases on the circle; 0, 0, 0, 0 where there is none.

    A 2-D trace meets the volume's nearest one.
    """
    each = _traces_of(pieces, step).join(stations.select("line", "trcnr", F.col("x").alias("px"), F.col("y").alias("py")), ["line", "trcnr"])
    each = each.withColumns({"ix": F.floor(F.col("px") + 0.5).cast("long"), "iy": F.floor(F.col("py") + 0.5).cast("long")})
    pairs = each.join(_side(traces, "b", line="line", trcnr="trcnr"), ["line", "trcnr"]).join(_side(volume, "a", ix="ix", iy="iy"), ["ix", "iy"])
    got = estimated(pairs, ["line", "piece"], gate, longest, z_only, factor).where("ok")
    return _of_volume(pieces, ties.piece_means(got.withColumn("k", F.struct("line", "piece")), "k").select("k.line", "k.piece", *VALUES), name, (0.0, 0.0, 0.0, 0.0))


def volume_by_horizons(pieces: DataFrame, horizon: DataFrame, stations: DataFrame, surface: DataFrame, name: str = "3D", step: int = 1, factor: float = 1.0) -> DataFrame:
    """Ties of a horizon surface(ix, iy, z) with horizon(line, trcnr, z): the mean of their differences where both are defined, else 0; ratios and qualities are 1."""
    each = _traces_of(pieces, step).join(stations.select("line", "trcnr", F.col("x").alias("px"), F.col("y").alias("py")), ["line", "trcnr"]).join(horizon.select("line", "trcnr", F.col("z").alias("z2")), ["line", "trcnr"])
    each = each.withColumns({"ix": F.floor(F.col("px") + 0.5).cast("long"), "iy": F.floor(F.col("py") + 0.5).cast("long")}).join(surface.select("ix", "iy", F.col("z").alias("z3")), ["ix", "iy"])
    mean = each.groupBy("line", "piece").agg(F.avg((F.col("z2") - F.col("z3")) * factor).alias("zdiff"))
    return _of_volume(pieces, mean.select("line", "piece", "zdiff", F.lit(0.0).alias("phasediff"), F.lit(1.0).alias("ampdiff"), F.lit(1.0).alias("quality")), name, (0.0, 0.0, 1.0, 1.0))


def _of_volume(pieces: DataFrame, values: DataFrame, name: str, none: tuple[float, ...]) -> DataFrame:
    j = pieces.join(values, ["line", "piece"], "left")
    return j.select(F.lit(name).alias("line_a"), F.col("trc1").alias("trc_a"), F.col("line").cast("string").alias("line_b"), F.col("trc2").alias("trc_b"), "x", "y", *[F.coalesce(v, F.lit(d)).alias(v) for v, d in zip(VALUES, none)])


def named(df: DataFrame) -> DataFrame:
    """Ties of 2-D lines with the lines' names as text, as in the table of all kinds."""
    return df.select(F.col("line_a").cast("string").alias("line_a"), "trc_a", F.col("line_b").cast("string").alias("line_b"), "trc_b", "x", "y", *VALUES)


def by_traces(stations: DataFrame, traces: DataFrame, volume: DataFrame | None = None, kind: str = "time", gate: tuple[float, float] | None = None, longest: float | None = None, z_only: bool = False, name: str = "3D", step: int = 1, factor: float = 1.0) -> DataFrame:
    """All ties of lines, and of a volume if given, from their traces; gate and longest lag are those of a kind of z unless given."""
    gate, longest = gate or DEFAULTS[kind]["gate"], longest or DEFAULTS[kind]["longest"]
    out = named(lines_by_traces(stations, traces, gate, longest, z_only, factor))
    if volume is not None:
        out = out.unionByName(volume_by_traces(overlaps(stations, volume), stations, traces, volume, gate, longest, name, step, z_only, factor))
    return out


def by_horizons(stations: DataFrame, horizon: DataFrame, surface: DataFrame | None = None, name: str = "3D", step: int = 1, factor: float = 1.0) -> DataFrame:
    """All ties of lines, and of a surface if given, from their horizons; ratios and qualities are 1."""
    two = ties.line_horizon_ties(stations, horizon, factor).withColumns({"phasediff": F.lit(0.0), "ampdiff": F.lit(1.0), "quality": F.lit(1.0)})
    out = named(two)
    if surface is not None:
        out = out.unionByName(volume_by_horizons(overlaps(stations, surface), horizon, stations, surface, name, step, factor))
    return out


def histogram(df: DataFrame, widths: dict[str, float]) -> DataFrame:
    """value, bin, low, n: how many rows have each value in a bin of its width; nulls aren't counted."""
    each = F.array(*[F.struct(F.lit(c).alias("value"), F.floor(F.col(c) / w).cast("long").alias("bin"), F.lit(float(w)).alias("w")) for c, w in widths.items()])
    return df.select(F.explode(each).alias("e")).where("e.bin is not null").groupBy("e.value", "e.bin", "e.w").agg(F.count("*").alias("n")).select("value", "bin", (F.col("bin") * F.col("w")).alias("low"), "n")


def hilbert_taps(half: int = 30) -> np.ndarray:
    """A Hilbert transformer of 2 * half + 1 taps, Hamming-windowed, for convolution."""
    n = np.arange(-half, half + 1)
    return np.where(n % 2 != 0, 2 / (np.pi * np.where(n == 0, 1, n)), 0.0) * (0.54 + 0.46 * np.cos(np.pi * n / half))


def corrected(x: np.ndarray, shift: np.ndarray, phase: np.ndarray, amp: np.ndarray, step: np.ndarray, half: int = 30) -> np.ndarray:
    """Traces [trace, z], each moved down by its shift (linear between samples, 0 beyond the ends), turned by its phase in degrees (180 changes the sign, others take the Hilbert transform) and scaled."""
    n = x.shape[1]
    at = np.arange(n)[None] - (shift / step)[:, None]
    low = np.floor(at).astype(np.int64)
    part = at - low
    padded = np.pad(x, ((0, 0), (1, 2)))
    take = lambda k: np.take_along_axis(padded, np.clip(k + 1, 0, n + 2), 1)
    moved = np.where((at >= 0) & (at <= n - 1), (1 - part) * take(low) + part * take(low + 1), 0.0)
    taps = hilbert_taps(half)
    size = n + 2 * half
    turned = np.fft.irfft(np.fft.rfft(moved, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)[:, half : half + n]
    angle = np.radians(phase)[:, None]
    flip = (np.abs(phase) == 180)[:, None]
    out = np.where(flip, -moved, np.where(phase[:, None] == 0, moved, moved * np.cos(angle) - turned * np.sin(angle)))
    return out * amp[:, None]


def apply_corrections(traces: DataFrame, corrections: DataFrame, keys: list[str], shift: bool = True, phase: bool = True, amp: bool = True) -> DataFrame:
    """keys and samples of traces(line, step, samples) after their lines' corrections(line, shift, phase, amp); lines without one stay. Undefined samples count as zero."""
    j = traces.join(corrections.select("line", *[F.col(c).cast("double").alias(f"__{c}") for c in ("shift", "phase", "amp")]), "line", "left")
    on = {"shift": (shift, 0.0), "phase": (phase, 0.0), "amp": (amp, 1.0)}
    df = j.select(*keys, "samples", F.col("step").cast("double").alias("__step"), *[(F.coalesce(f"__{c}", F.lit(d)) if use else F.lit(d)).alias(f"__{c}") for c, (use, d) in on.items()])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keys)]] + ["samples array<double>"])

    def run(batches):
        for whole in batches:
            size = lengths(whole.column("samples"))
            for n in np.unique(size):
                b = whole.filter(pa.array(size == n))
                of = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                x = matrix(b.column("samples"), 0.0)
                out = corrected(x, of("__shift"), of("__phase"), of("__amp"), of("__step")) if n else x
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], arrays(out)], names=[*keys, "samples"])

    return df.mapInArrow(run, schema)
