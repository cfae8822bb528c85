"""Attributes along traces that need complex numbers or recursion: matrices of a batch's traces in, matrices out.

Each runs in mapInArrow over rows that hold whole traces, so nothing is shuffled; a batch bounds the memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lists import arrays, lengths, matrix


def map_traces(df: DataFrame, fn: Callable[..., dict[str, np.ndarray]], inputs: list[str], outputs: list[str], keys: list[str], rows: int = 256) -> DataFrame:
    """keys and an array column per output. fn takes a matrix [trace, z] per input, undefined samples as zero; a row's inputs are of one length, rows may differ.
    What it leaves non-finite becomes null."""
    df = df.select(*keys, *inputs)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keys)]] + [f"{o} array<double>" for o in outputs])

    def run(batches):
        for whole in batches:
            size = lengths(whole.column(inputs[0]))
            for n in np.unique(size):
                same = whole if (size == n).all() else whole.filter(pa.array(size == n))
                for at in range(0, same.num_rows, rows):
                    b = same.slice(at, rows)
                    got = fn(*[matrix(b.column(c), 0.0) for c in inputs])
                    yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [arrays(got[o]) for o in outputs], names=[*keys, *outputs])

    return df.mapInArrow(run, schema)


def analytic(x: np.ndarray) -> np.ndarray:
    """x + i times its Hilbert transform, by the spectrum."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def analytic_signal(x: np.ndarray) -> dict[str, np.ndarray]:
    z = analytic(x)
    return {"real": z.real, "imaginary": z.imag, "envelope": np.abs(z), "phase": np.degrees(np.angle(z))}


def instantaneous_frequency(x: np.ndarray, dt: float) -> np.ndarray:
    """Turns per unit from one sample to the next, non-negative; the last is repeated."""
    z = analytic(x)
    step = np.angle(z[:, 1:] * np.conj(z[:, :-1]))
    f = np.where(step < 0, step + np.pi, step) / (2 * np.pi * dt)
    return np.concatenate([f, f[:, -1:]], 1)


def recursive_spectrum(x: np.ndarray, dt: float, window: float, step: float, count: int) -> np.ndarray:
    """[trace, frequency, z]: amplitude at k * step, by a fourth-order recursive filter run forward and, conjugated, backward."""
    f = np.arange(1, count + 1) * step
    sigma = 6 * np.sqrt(2 / window) / (np.sqrt(2 * np.pi * dt) * 27 * np.exp(-3))
    a = np.exp((-sigma + 2j * np.pi * f) * dt)
    s4 = (sigma * dt) ** 4
    num, den = [s4 * a / 6, 2 * s4 * a**2 / 3, s4 * a**3 / 6], [-4 * a, 6 * a**2, -4 * a**3, a**4]

    def one_way(x, num, den):
        out = np.zeros((x.shape[0], count, x.shape[1]), complex)
        for t in range(x.shape[1]):
            y = sum((c[None, :] * x[:, t - i - 1, None] for i, c in enumerate(num) if t > i), np.zeros((x.shape[0], count), complex))
            out[:, :, t] = y - sum((c[None, :] * out[:, :, t - i - 1] for i, c in enumerate(den) if t > i), np.zeros((x.shape[0], count), complex))
        return out

    back = one_way(x[:, ::-1], [np.conj(c) for c in num], [np.conj(c) for c in den])
    return np.abs(one_way(x, num, den) + back[:, :, ::-1])


def segments(amplitude: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Bounds and peaks of a spectrum's bands: the `most` largest strict local maxima in order of frequency, cut at the lowest amplitude between neighbours."""
    a = amplitude
    peaks = [i for i in range(1, len(a) - 1) if a[i] > a[i - 1] and a[i] > a[i + 1]]
    peaks = sorted(sorted(peaks, key=lambda i: (-a[i], i))[:most])
    bounds = [0] + [p + int(np.argmin(a[p : q + 1])) for p, q in zip(peaks, peaks[1:])] + [len(a) - 1]
    return bounds, peaks


def modes(x: np.ndarray, most: int) -> np.ndarray:
    """[trace, mode, z]: parts of each trace in the bands of its own spectrum; NaN where it has fewer."""
    n = x.shape[1]
    spectrum = np.fft.rfft(x, axis=1)
    out = np.full((x.shape[0], most, n), np.nan)
    for r in range(x.shape[0]):
        bounds, peaks = segments(np.abs(spectrum[r]), most)
        for k in range(len(peaks)):
            band = np.zeros(spectrum.shape[1], complex)
            lo = bounds[k] + (k > 0)
            band[lo : bounds[k + 1] + 1] = spectrum[r, lo : bounds[k + 1] + 1]
            out[r, k] = np.fft.irfft(band, n)
    return out


def tie_estimate(a: np.ndarray, b: np.ndarray, dt: float, longest: float) -> dict[str, np.ndarray]:
    """Shift, phase (degrees), amplitude ratio and quality that take trace a to trace b, by the envelope of their analytic cross-correlation.

    The peak is refined by a parabola over its neighbours. Traces without energy give 0, 0, 1, 0.
    """
    n = a.shape[1]
    nfft = 2 * n
    one_sided = np.zeros(nfft)
    one_sided[0], one_sided[1:n], one_sided[n] = 1, 2, 1
    full = np.fft.ifft(np.fft.fft(b, nfft, axis=1) * np.conj(np.fft.fft(a, nfft, axis=1)) * one_sided, axis=1)
    most = max(1, int(longest / dt))
    lags = np.concatenate([np.arange(most), np.arange(-most, 0)])
    cc = np.abs(full)
    at = lags[np.argmax(cc[:, lags % nfft], 1)]
    r = np.arange(len(a))
    m, l, h = cc[r, at % nfft], cc[r, (at - 1) % nfft], cc[r, (at + 1) % nfft]
    with np.errstate(all="ignore"):
        cp = np.nan_to_num((l - h) / (2 * l - 4 * m + 2 * h))
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        quality = np.minimum(1, (m - 0.25 * (l - h) * cp) / (na * nb))
        p0, p1 = np.angle(full[r, at % nfft]), np.angle(full[r, (at + np.sign(cp).astype(int)) % nfft])
        phase = np.degrees(p0 + np.abs(cp) * np.angle(np.exp(1j * (p1 - p0))))
        ok = (na > 0) & (nb > 0)
        out = {"zdiff": np.where(ok, (at + cp) * dt, 0.0), "phasediff": np.where(ok, phase, 0.0), "ampdiff": np.where(ok, nb / na, 1.0), "quality": np.where(ok, quality, 0.0)}
    return {k: v[:, None] for k, v in out.items()}


def corrected(x: np.ndarray, shift: float, phase: float, amp: float, dt: float) -> np.ndarray:
    """Traces moved by shift (linear between samples, zero beyond the ends), turned by phase degrees and scaled."""
    t = np.arange(x.shape[1])
    moved = np.array([np.interp(t - shift / dt, t, row, left=0.0, right=0.0) for row in x]) if shift else x
    if phase == 180:
        turned = -moved
    else:
        z = analytic(moved)
        turned = z.real * np.cos(np.radians(phase)) - z.imag * np.sin(np.radians(phase))
    return amp * turned


def local_correlation(a: np.ndarray, b: np.ndarray, half: int, lags: int) -> dict[str, np.ndarray]:
    """At each sample the lag of the best normalised correlation in a window, refined by a parabola (0 at the edge of the lags), and its quality."""
    n = a.shape[1]

    def window(v):
        c = np.cumsum(np.pad(v, ((0, 0), (1, 0))), 1)
        return c[:, np.minimum(np.arange(n) + half + 1, n)] - c[:, np.maximum(np.arange(n) - half, 0)]

    rows = []
    for k in range(-lags, lags + 1):
        moved = np.zeros_like(b)
        moved[:, max(0, -k) : n - max(0, k)] = b[:, max(0, k) : n - max(0, -k)]
        with np.errstate(all="ignore"):
            rows.append(np.nan_to_num(window(a * moved) / np.sqrt(window(a * a) * window(moved * moved))))
    cc = np.stack(rows)
    best = np.argmax(np.round(cc, 12), 0)
    edge = (best == 0) | (best == 2 * lags)
    inner = np.clip(best, 1, 2 * lags - 1)
    l, m, r = (np.take_along_axis(cc, (inner + d)[None], 0)[0] for d in (-1, 0, 1))
    with np.errstate(all="ignore"):
        cp = np.nan_to_num((l - r) / (2 * l - 4 * m + 2 * r))
    return {"shift": np.where(edge, 0.0, inner - lags + cp), "quality": np.where(edge, 0.0, np.clip(m - 0.25 * (l - r) * cp, 0, 1))}


def triangle_smooth(x: np.ndarray, half: int) -> np.ndarray:
    """A triangle of 2 * half - 1 points, with reflection at the ends; half of 1 or less changes nothing."""
    if half <= 1:
        return x
    w = np.concatenate([np.arange(1, half + 1), np.arange(half - 1, 0, -1)]) / half**2
    p = np.pad(x, ((0, 0), (half - 1, half - 1)), mode="symmetric")
    return sum(k * p[:, i : i + x.shape[1]] for i, k in enumerate(w))


def smooth_division(num: np.ndarray, den: np.ndarray, half: int, iterations: int = 100, tol: float = 1e-6, damping: float = 1.0) -> np.ndarray:
    """The smooth ratio r with den * r = num, by conjugate gradients with shaping regularisation: r is a triangle smoothing of what is sought.

    A trace ends when its gradient, squared, has fallen below tol of the first or of the one before, or after `iterations`.
    """
    shape = lambda v: triangle_smooth(v, half)
    dot = lambda a, b: (a * b).sum(1)
    sought, ratio, left = np.zeros_like(num), np.zeros_like(num), num.copy()
    way = [np.zeros_like(num) for _ in range(3)]  # the direction, of what is sought, of the ratio and of the data
    first = last = None
    going = np.flatnonzero(dot(num, num) > 0)
    for step in range(iterations):
        if not len(going):
            break
        d = den[going]
        down = shape(d * left[going] + damping * ratio[going]) - damping * sought[going]
        smooth = shape(down)
        size = dot(down, down)
        if step == 0:
            first, share = size.copy(), np.zeros(len(going))
        else:
            with np.errstate(all="ignore"):
                share = np.nan_to_num(size / last)
                on = ~((share < tol) | (np.nan_to_num(size / first) < tol))
            going, first = going[on], first[on]
            down, smooth, size, share, d = down[on], smooth[on], size[on], share[on], d[on]
        for held, new in zip(way, (down, smooth, d * smooth)):
            held[going] = new + share[:, None] * held[going]
        s, m, r = (w[going] for w in way)
        with np.errstate(all="ignore"):
            by = np.nan_to_num(size / (dot(r, r) + damping * (dot(s, s) - dot(m, m))))[:, None]
        sought[going] += by * s
        ratio[going] += by * m
        left[going] -= by * r
        last = size
    return ratio


def local_time_frequency(x: np.ndarray, dt: float, z0: float, frequency: float, half: int) -> np.ndarray:
    """Amplitude of one frequency along each trace: both carriers' smooth ratios, taken together."""
    t = (z0 + np.arange(x.shape[1])) * dt
    s, c = (np.broadcast_to(g(2 * np.pi * frequency * t), x.shape) for g in (np.sin, np.cos))
    return np.hypot(smooth_division(x, s, half), smooth_division(x, c, half))
