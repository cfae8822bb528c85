"""Recursive filters, the reassigned spectrum, and empirical Fourier decomposition of traces: matrices [trace, z] in, matrices out."""

from __future__ import annotations

import math

import numpy as np

# --- recursive filters -------------------------------------------------------------------------------------------------


def iir(x: np.ndarray, num: np.ndarray, den: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """[trace, filter, z]: y[t] = sum num[:, j] x[t - j] - sum den[:, j] y[t - 1 - j] of each trace by each filter, from rest or from a state [trace, filter, order]."""
    order = max(num.shape[1] - 1, den.shape[1])
    b = np.zeros((len(num), order + 1), num.dtype)
    a = np.zeros((len(den), order), den.dtype)
    b[:, : num.shape[1]], a[:, : den.shape[1]] = num, den
    kind = np.result_type(x, num, den)
    held = np.zeros((len(x), len(num), order + 1), kind)
    if state is not None:
        held[:, :, :order] = state
    out = np.empty((len(x), len(num), x.shape[1]), kind)
    for t in range(x.shape[1]):
        now = x[:, t, None]
        y = held[:, :, 0] + b[None, :, 0] * now
        held[:, :, :-1] = held[:, :, 1:] + b[None, :, 1:] * now[..., None] - a[None] * y[..., None]
        out[:, :, t] = y
    return out


def steady_state(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The state of a filter that has seen ones for ever."""
    order = max(len(num) - 1, len(den))
    b, a = np.zeros(order + 1), np.zeros(order)
    b[: len(num)], a[: len(den)] = num, den
    level = b.sum() / (1 + a.sum())
    # each place holds what is still to come of ones seen so far
    return np.cumsum((b[1:] - a * level)[::-1])[::-1]


def forward_backward(x: np.ndarray, num: np.ndarray, den: np.ndarray, pad: int = 0) -> np.ndarray:
    """A real filter run over traces and back: each way begins as if the first sample had always been there. pad: so many samples (fewer than the trace has) go before the first and behind the last,
    the trace turned around these points."""
    rest = steady_state(num, den)
    once = lambda v: iir(v, num[None], den[None], v[:, :1, None] * rest[None, None])[:, 0]
    n = x.shape[1]
    pad = min(pad, n - 1)
    if pad > 0:
        x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    out = once(once(x)[:, ::-1])[:, ::-1]
    return out[:, max(pad, 0) : max(pad, 0) + n]


def butterworth_lowpass(cut: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A low-pass at cut (1 is the Nyquist frequency), by the bilinear transform of its poles: numerator, and denominator without its leading one."""
    k = np.arange(order)
    pole = math.tan(math.pi * cut / 2) * np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    den = np.real(np.poly((1 + pole) / (1 - pole)))
    num = np.poly(-np.ones(order))
    return num * den.sum() / num.sum(), den[1:]


def butterworth_highpass(cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order high-pass at cut (1 is the Nyquist frequency), by the bilinear transform: numerator, and denominator without its leading one."""
    w = math.tan(math.pi * cut / 2)
    scale = 1 + math.sqrt(2) * w + w * w
    return np.array([1.0, -2.0, 1.0]) / scale, np.array([2 * (w * w - 1), 1 - math.sqrt(2) * w + w * w]) / scale


# --- reassignment ------------------------------------------------------------------------------------------------------

# The polynomials of the sums of n^m r^n, m = 2, 3, 4, over (1 - r)^(m + 1).
EULERIAN = {2: [0, 1, 1], 3: [0, 1, 4, 1], 4: [0, 1, 11, 11, 1]}


def _power_filter(m: int, pole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter with the impulse response n^m pole^n: numerator, and denominator without its leading one."""
    n = np.arange(m + 2)
    den = np.stack([math.comb(m + 1, k) * (-pole) ** k for k in n], 1)
    return np.stack([c * pole**k for k, c in enumerate(EULERIAN[m])], 1), den[:, 1:]


def _round_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def reassigned(x: np.ndarray, dt: float, step: float, count: int) -> np.ndarray:
    """[trace, frequency, z]: the amplitudes of a fourth-order recursive spectrum at step, 2 step, ..., each moved to its centre of gravity in time and frequency.

    The response is h(t) = s^4 t^3 / 6 exp((-s + 2 pi i f) t); its derivative and t h(t) give the places. Amplitudes that leave the panel go to its edge.
    """
    n = x.shape[1]
    s = 6 * math.sqrt(step) / (math.sqrt(2 * math.pi * dt) * 27 * math.exp(-3))
    p = -s + 2j * np.pi * step * np.arange(1, count + 1)
    a = np.exp(p * dt)
    (n2, _), (n3, d3), (n4, d4) = (_power_filter(m, a) for m in (2, 3, 4))
    lower = np.zeros_like(n3)  # n2 over the denominator of n3
    lower[:, :3] += n2
    lower[:, 1:4] -= a[:, None] * n2
    unit = (s * dt) ** 4
    w = iir(x, unit / 6 * n3, d3)
    slope = iir(x, unit / dt * (lower / 2 + p[:, None] * dt * n3 / 6), d3)
    late = iir(x, unit * dt / 6 * n4, d4)
    size = np.abs(w)
    w = w + 1e-10 * (1 + 1j)
    to_z = np.clip(np.arange(n)[None, None] - _round_away((late / w).real / dt), 0, n - 1).astype(np.int64)
    to_f = np.clip(_round_away(((slope / w).imag / (2 * np.pi) - step) / step), 0, count - 1).astype(np.int64)
    out = np.zeros(size.shape)
    np.add.at(out, (np.arange(len(x))[:, None, None], to_f, to_z), size)
    return out


def at_gate(panel: np.ndarray, gate: tuple[float, float], dt: float) -> np.ndarray:
    """A panel [.., z] read at the centre of a gate around each sample; undefined beyond the ends."""
    by = int(_round_away(np.array((gate[0] + gate[1]) / 2 / dt)))
    out = np.full(panel.shape, np.nan)
    n = panel.shape[-1]
    if abs(by) < n:
        out[..., max(-by, 0) : n - max(by, 0)] = panel[..., max(by, 0) : n + min(by, 0)]
    return out


# --- empirical Fourier decomposition -----------------------------------------------------------------------------------


class Decomposition:
    """Spectra of traces and their bands.

    A trace is padded to twice its length ("none", "one_sided" with zeros, "mirror", "symmetric"), with its ramp taken off and its ends tapered if asked for. The `most`
    largest strict maxima of the amplitudes below the Nyquist frequency are peaks (of equal ones the lower); the lowest amplitudes between neighbours bound the bands.

    peaks[trace, mode]: bins in order, -1 where a trace has fewer; bounds[trace, mode + 1]; rank[trace, r]: the bin of the r-th largest peak, -1 likewise.
    """

    def __init__(self, x: np.ndarray, most: int, pad: str = "one_sided", deramp: bool = False, taper: int = 0):
        self.n, self.most = x.shape[1], most
        self.ramp = (x[:, :1], x[:, -1:]) if deramp else None
        if deramp:
            x = x - (x[:, :1] + (x[:, -1:] - x[:, :1]) * np.arange(self.n) / max(self.n - 1, 1))
        half = -(-self.n // 2)
        if pad == "none":
            self.first, full = 0, x
        elif pad == "one_sided":
            self.first, full = 0, np.concatenate([x, np.zeros_like(x)], 1)
        elif pad == "mirror":
            self.first, full = self.n - half, np.concatenate([x[:, : self.n - half][:, ::-1], x, x[:, self.n - half :][:, ::-1]], 1)
        elif pad == "symmetric":
            self.first, full = self.n - half, np.concatenate([x[:, 1 : self.n - half + 1][:, ::-1], x, x[:, self.n - half - 1 : self.n - 1][:, ::-1]], 1)
        else:
            raise ValueError(f"unknown padding {pad}")
        if taper > 0 and full.shape[1] >= 2 * taper:
            w = (np.cos(np.pi * (np.arange(taper) / max(taper - 1, 1) - 1)) + 1) / 2
            full = full.copy()
            full[:, :taper] *= w
            full[:, -taper:] *= w[::-1]
        self._take(np.fft.fft(full, axis=1))

    @classmethod
    def of_spectrum(cls, spectrum: np.ndarray, most: int) -> Decomposition:
        """Of spectra as they are."""
        self = cls.__new__(cls)
        self.n, self.most, self.first, self.ramp = spectrum.shape[1], most, 0, None
        self._take(spectrum)
        return self

    def _take(self, spectrum: np.ndarray) -> None:
        self.spectrum = spectrum
        rows, half = len(spectrum), spectrum.shape[1] // 2
        amp = np.abs(spectrum[:, :half])
        top = np.zeros_like(amp)
        if half > 2:
            inner = amp[:, 1:-1]
            top[:, 1:-1] = np.where((inner > amp[:, :-2]) & (inner > amp[:, 2:]), inner, 0)
        order = np.argsort(-top, axis=1, kind="stable")[:, : self.most]
        rank = np.full((rows, self.most), -1)
        rank[:, : order.shape[1]] = np.where(np.take_along_axis(top, order, 1) > 0, order, -1)
        self.rank = rank
        self.count = (rank >= 0).sum(1)
        self.peaks = np.sort(np.where(rank < 0, half, rank), 1)
        self.peaks[self.peaks == half] = -1
        bins = np.arange(half)[None]
        self.bounds = np.full((rows, self.most + 1), half)
        self.bounds[:, 0] = 0
        for m in range(1, self.most):
            both = self.peaks[:, m] >= 0
            between = (bins >= self.peaks[:, m - 1, None]) & (bins <= self.peaks[:, m, None])
            if half:
                self.bounds[both, m] = np.argmin(np.where(between, amp, np.inf), 1)[both]

    def central(self) -> np.ndarray:
        """[trace, mode]: the peaks in radians a sample; NaN where there is none."""
        return np.where(self.peaks >= 0, self.peaks * 2 * np.pi / self.spectrum.shape[1], np.nan)

    def analytic(self, mode: int) -> np.ndarray:
        """[trace, z]: the analytic signal of a mode; NaN where a trace doesn't have it."""
        size = self.spectrum.shape[1]
        k = np.arange(size)[None]
        low, high = self.bounds[:, mode, None], self.bounds[:, mode + 1, None]
        band = (k >= np.where(low == 0, 0, low + 1)) & (k <= high) & (k <= size // 2)
        weight = np.where((k == 0) | (2 * k == size), 1.0, 2.0)
        z = np.fft.ifft(np.where(band, self.spectrum * weight, 0), axis=1)[:, self.first : self.first + self.n]
        return np.where((self.peaks[:, mode] >= 0)[:, None], z, np.nan)

    def mode(self, mode: int) -> np.ndarray:
        """[trace, z]: the part of the trace in a mode's band."""
        return self.analytic(mode).real

    def by_rank(self, r: int) -> np.ndarray:
        """[trace, z]: the mode of the r-th largest peak."""
        out = np.full((len(self.spectrum), self.n), np.nan)
        for m in range(self.most):
            own = (self.rank[:, r] >= 0) & (self.peaks[:, m] == self.rank[:, r])
            if own.any():
                out[own] = self.mode(m)[own]
        return out

    def frequency(self, mode: int, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """Instantaneous frequency (turns per unit, the half turn added where it is negative; 0 for the last two samples) and amplitude of a mode."""
        z = self.analytic(mode)
        f = np.zeros(z.shape)
        if self.n > 2:
            f[:, :-2] = np.angle(z[:, 1:-1] * np.conj(z[:, :-2]))
        f[np.isnan(z)] = np.nan
        return np.where(f < 0, f + np.pi, f) / (2 * np.pi * dt), np.abs(z)

    def energy_frequency(self, mode: int, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """Instantaneous frequency and amplitude of a mode by energy separation; NaN where they don't exist."""

        def energy(v: np.ndarray) -> np.ndarray:
            out = v * v
            out[:, 1:-1] -= v[:, :-2] * v[:, 2:]
            return out

        x = self.mode(mode)
        back, ahead = x.copy(), x.copy()
        back[:, 1:] -= x[:, :-1]
        ahead[:, :-1] = x[:, 1:] - x[:, :-1]
        with np.errstate(all="ignore"):
            e = energy(x)
            c = 1 - (energy(back) + energy(ahead)) / (4 * e)
            return np.arccos(c) / (2 * np.pi * dt), np.sqrt(e / (1 - c * c))

    def spectrum_by_frequency(self, dt: float, step: float, count: int) -> np.ndarray:
        """[trace, k, z]: the amplitudes of all modes whose instantaneous frequency is nearest to (k + 1) step, summed."""
        rows = len(self.spectrum)
        out = np.zeros((rows, count, self.n))
        z = np.broadcast_to(np.arange(self.n), (rows, self.n))
        for m in range(self.most):
            f, a = self.frequency(m, dt)
            with np.errstate(invalid="ignore"):
                k = np.floor(f / step + 0.5) - 1
                r, c = np.nonzero((k >= 0) & (k < count))
            np.add.at(out, (r, k[r, c].astype(np.int64), z[r, c]), a[r, c])
        return out
