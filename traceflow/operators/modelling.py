"""Seismic traces from logs, and impedance from seismic traces: linear models of a wavelet and the derivative of a log.

A trace is modelled as W D m: D is half the difference of a sample's neighbours, zero at both ends, W the convolution with a wavelet whose
middle tap is at len // 2. Inversion finds the departure from a background that explains the trace best, with a damping that is one number for the volume.
A wavelet is a small list of taps; it travels with the function.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.sources.files import read_wavelet

from .spectral import map_traces

#: A wavelet file of more taps is taken for an error.
MOST_TAPS = 10_000


def wavelet_taps(spark, path: str) -> list[float]:
    """The taps of a wavelet file, in order."""
    rows = read_wavelet(spark, path).orderBy("seq").limit(MOST_TAPS + 1).collect()
    if not 0 < len(rows) <= MOST_TAPS:
        raise ValueError(f"{path} has no taps, or too many")
    return [r.value for r in rows]


def ricker(frequency: float, dt: float, half: int) -> list[float]:
    """A zero-phase wavelet of 2 * half + 1 taps."""
    a = (np.pi * frequency * dt * np.arange(-half, half + 1)) ** 2
    return ((1 - 2 * a) * np.exp(-a)).tolist()


def slope(x: np.ndarray) -> np.ndarray:
    """Half the difference of the neighbours along the last axis; zero at both ends."""
    out = np.zeros_like(x)
    out[..., 1:-1] = (x[..., 2:] - x[..., :-2]) / 2
    return out


def convolved(x: np.ndarray, taps: list[float]) -> np.ndarray:
    """Convolution along the last axis, cut to its length so that the middle tap stands on each sample."""
    n, middle = x.shape[-1], len(taps) // 2
    out = np.zeros_like(x)
    for k, w in enumerate(taps):
        by = k - middle  # the tap moves samples to later places
        if w and abs(by) < n:
            out[..., max(by, 0) : n + min(by, 0)] += w * x[..., max(-by, 0) : n - max(by, 0)]
    return out


def extended(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs whose leading and trailing zeros hold the first and the last other value; and where a log has its values, its last one left out."""
    n = log.shape[1]
    has = log != 0
    first, last = has.argmax(1)[:, None], n - 1 - has[:, ::-1].argmax(1)[:, None]
    z = np.arange(n)[None]
    full = np.take_along_axis(log, np.clip(z, first, last), 1)
    return full, has.any(1)[:, None] & (z >= first) & (z < last)


def poststack(log_impedance: np.ndarray, taps: list[float]) -> np.ndarray:
    """Traces of log impedances; undefined outside the log."""
    full, inside = extended(log_impedance)
    return np.where(inside, convolved(slope(full), [w / 2 for w in taps]), np.nan)


def reflection_weights(angle: float, vs_vp: np.ndarray, method: str) -> list[np.ndarray]:
    """What the slopes of ln vp, ln vs and ln density count for in the reflectivity at an angle (degrees): the Aki-Richards ("akirich") or the Fatti ("fatti") terms."""
    t = np.radians(angle)
    s = 4 * (vs_vp * np.sin(t)) ** 2
    if method == "akirich":
        return [np.full_like(s, 1 / (2 * np.cos(t) ** 2)), -s, 0.5 - s / 2]
    if method == "fatti":
        return [np.full_like(s, (1 + np.tan(t) ** 2) / 2), -s, (s - np.tan(t) ** 2) / 2]
    raise ValueError(f"unknown method {method}")


def prestack(dt: np.ndarray, dts: np.ndarray, density: np.ndarray, taps: list[float], angle: float, method: str) -> np.ndarray:
    """Traces at an angle of compressional and shear slowness (us/m) and density logs; undefined outside the first log, and where a log has no value at all."""
    (dt, inside), (dts, shear), (density, weight) = extended(dt), extended(dts), extended(density)
    some = lambda full: (full != 0).any(1)[:, None]
    with np.errstate(all="ignore"):
        vp, vs = 1e6 / dt, 1e6 / dts
        g = reflection_weights(angle, (vs / vp).mean(1)[:, None], method)
        r = sum(w * slope(np.log(m)) for w, m in zip(g, (vp, vs, density)))
    return np.where(inside & some(dts) & some(density), convolved(np.nan_to_num(r, nan=0.0, posinf=0.0, neginf=0.0), taps), np.nan)


class BandedNormal:
    """(W D)' W D + damping, for traces of n samples, as the Cholesky factor of a band: row i of `factor` holds columns i - band .. i."""

    def __init__(self, n: int, taps: tuple[float, ...], damping: float):
        self.taps, self.n = taps, n
        reach = max(len(taps) // 2, len(taps) - 1 - len(taps) // 2) + 1  # of W D around a sample
        self.band = band = min(2 * reach, n - 1)
        rows = np.zeros((n, band + 1))
        # columns that lie more than 2 * reach apart share no row of W D: impulses that far apart show their columns together
        step = 2 * reach + 1
        model = np.zeros((n, 2 * reach + 1))  # model[i, reach + i' - i] = (W D)[i', i]
        for phase in range(min(step, n)):
            unit = np.zeros(n)
            unit[phase::step] = 1
            seen = self.forward(unit[None])[0]
            for i in range(phase, n, step):
                a, z = max(0, i - reach), min(n, i + reach + 1)
                model[i, a - i + reach : z - i + reach] = seen[a:z]
        for off in range(band + 1):
            a, b = model[off:], model[: n - off]
            rows[off:, band - off] = (a[:, : 2 * reach + 1 - off] * b[:, off:]).sum(1) if off <= 2 * reach else 0.0
        rows[:, band] += damping
        self.factor = self._cholesky(rows)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return convolved(slope(x), list(self.taps))

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        """(W D)' y: correlation, then the transposed slope."""
        n, middle = self.n, len(self.taps) // 2
        w = np.zeros_like(y)
        for k, t in enumerate(self.taps):
            by = middle - k
            if t and abs(by) < n:
                w[:, max(by, 0) : n + min(by, 0)] += t * y[:, max(-by, 0) : n - max(by, 0)]
        out = np.zeros_like(y)
        out[:, 2:] += w[:, 1:-1] / 2
        out[:, :-2] -= w[:, 1:-1] / 2
        return out

    def _cholesky(self, rows: np.ndarray) -> np.ndarray:
        """Row by row: each entry takes off the product of what its two rows have before it."""
        n, band = self.n, self.band
        out = np.zeros_like(rows)
        for i in range(n):
            for j in range(max(0, i - band), i + 1):
                lo = max(0, i - band, j - band)
                s = rows[i, band - (i - j)] - out[i, band - (i - lo) : band - (i - j)] @ out[j, band - (j - lo) : band]
                out[i, band - (i - j)] = np.sqrt(s) if i == j else s / out[j, band]
        return out

    def solve(self, y: np.ndarray) -> np.ndarray:
        """All traces (rows of y) at once, sample by sample: forward, then backward."""
        n, band, f = self.n, self.band, self.factor
        x = y.T.copy()
        for i in range(n):
            lo = max(0, i - band)
            x[i] = (x[i] - f[i, band - (i - lo) : band] @ x[lo:i]) / f[i, band]
        for i in range(n - 1, -1, -1):
            x[i] /= f[i, band]
            lo = max(0, i - band)
            x[lo:i] -= f[i, band - (i - lo) : band][:, None] * x[i][None]
        return x.T


@functools.lru_cache(8)
def _normal(n: int, taps: tuple[float, ...], damping: float) -> BandedNormal:
    return BandedNormal(n, taps, damping)


def inverted(trace: np.ndarray, background: np.ndarray, taps: list[float], damping: float) -> dict[str, np.ndarray]:
    """Log impedance that explains traces, damped towards a background; and what it leaves unexplained."""
    if not trace.size:
        return {"impedance": trace, "residual": trace}
    model = _normal(trace.shape[1], tuple(w / 2 for w in taps), damping)
    left = trace - model.forward(background)
    change = model.solve(model.adjoint(left))
    return {"impedance": background + change, "residual": left - model.forward(change)}


def poststack_modelling(traces: DataFrame, taps: list[float], log: str, keys: list[str]) -> DataFrame:
    """keys and value: a trace for each array of log impedances; zeros before and after a log's values are filled, and undefined in the result."""
    return map_traces(traces, lambda x: {"value": poststack(x, taps)}, [log], ["value"], keys)


def prestack_modelling(logs: DataFrame, taps: list[float], columns: list[str], keys: list[str], angle: float = 6.0, method: str = "akirich") -> DataFrame:
    """keys and value, from the columns of compressional slowness, shear slowness and density."""
    return map_traces(logs, lambda *x: {"value": prestack(*x, taps, angle, method)}, columns, ["value"], keys)


def poststack_inversion(traces: DataFrame, taps: list[float], trace: str, background: str, keys: list[str], percent: float = 1.0) -> DataFrame:
    """keys, impedance and residual of each trace, with its background of the same length.

    The damping is `percent` hundredths of the largest sample of all traces: one aggregation, whatever the order. Without a sample above zero there is none, and
    no result. Undefined samples count as zero.
    """
    top = traces.agg(F.max(F.array_max(F.filter(trace, lambda x: ~F.isnan(x) & (x < float("inf"))))).alias("top")).first().top
    damping = percent / 100 * (top or 0.0)
    if damping <= 0:
        nothing = F.transform(trace, lambda x: F.lit(None).cast("double"))
        return traces.select(*keys, nothing.alias("impedance"), nothing.alias("residual"))
    return map_traces(traces, lambda x, b: inverted(x, b, taps, damping), [trace, background], ["impedance", "residual"], keys)
