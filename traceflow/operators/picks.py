"""Peaks, warps and equalised amplitudes of traces: matrices [trace, z] in, matrices out."""

from __future__ import annotations

import math

import numpy as np

from .decomposition import butterworth_highpass, forward_backward
from .spectral import analytic
from .stencil import Tile

# --- envelope times the interpolated sign of its peaks -----------------------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than both neighbours; the middle of a level top."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    value = x[first]
    last = np.append(first[1:], len(x)) - 1
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    return (first[top] + last[top]) // 2


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic Hermite interpolation that keeps the order of neighbouring values: slopes are harmonic means, 0 at turning points."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        same = d[:-1] * d[1:] > 0
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(all="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)

        def end(h0, h1, d0, d1):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if s * d0 <= 0:
                return 0.0
            return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]


def signed_envelope(x: np.ndarray) -> np.ndarray:
    """The envelope times a curve through the signs at its peaks: that of the larger of the real and the imaginary part there, 0 at both ends.
    Without a peak the result is 0."""
    z = analytic(x)
    envelope = np.abs(z)
    out = np.zeros(x.shape)
    places = np.arange(x.shape[1], dtype=float)
    for r in range(len(x)):
        top = local_maxima(envelope[r])
        if not len(top):
            continue
        there = z[r, top]
        larger = np.where(np.abs(there.real) > np.abs(there.imag), there.real, there.imag)
        knots = np.concatenate([[0], top, [x.shape[1] - 1]]).astype(float)
        signs = np.concatenate([[0], np.where(larger < 0, -1, 1), [0]]).astype(float)
        out[r] = monotone_cubic(knots, signs, places) * envelope[r]
    return out


# --- dynamic time warping ----------------------------------------------------------------------------------------------

#: Cells of the moves that are held at once.
WARP_CELLS = 1 << 25


def warped(a: np.ndarray, b: np.ndarray, band: int | None = None) -> np.ndarray:
    """[trace, sample of b]: the last sample of a on the cheapest path that pairs the samples of a and b in order.

    The cost is the sum of squared differences; of equal predecessors the diagonal comes first, then that of the sample of a before. band: how far
    places may lie apart, beyond the difference of the lengths; all pairs without one. All traces move on together, one antidiagonal at a time.
    """
    n, m = a.shape[1], b.shape[1]
    reach = max(n, m) if band is None else band + abs(n - m)
    width = min(2 * reach + 1, n + m)
    out = np.zeros((len(a), m), np.int64)
    if not n or not m:
        return out
    some = max(1, WARP_CELLS // max(1, n * width))
    for at in range(0, len(a), some):
        out[at : at + some] = _warped(a[at : at + some], b[at : at + some], reach)
    return out


def _warped(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    rows, n, m = len(a), a.shape[1], b.shape[1]
    width = min(2 * reach + 1, n + m)
    shift = min(reach, n)  # column of a move: j - i + shift
    moves = np.zeros((rows, n, width), np.uint8)
    before = np.full((rows, n + 1), np.inf)  # sums of the antidiagonal before last, at i + 1
    last = np.full((rows, n + 1), np.inf)
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s) + 1)
        i = i[np.abs(s - 2 * i) <= reach]
        now = np.full((rows, n + 1), np.inf)
        if len(i):
            j = s - i
            ways = np.stack([before[:, i], last[:, i], last[:, i + 1]])  # (i-1, j-1), (i-1, j), (i, j-1)
            if s == 0:
                ways[0] = 0
            move = np.argmin(ways, 0)
            moves[:, i, j - i + shift] = move
            now[:, i + 1] = np.take_along_axis(ways, move[None], 0)[0] + (a[:, i] - b[:, j]) ** 2
        before, last = last, now
    out = np.full((rows, m), -1)
    r, i, j = np.arange(rows), np.full(rows, n - 1), np.full(rows, m - 1)
    while len(r):
        fresh = out[r, j] < 0
        out[r[fresh], j[fresh]] = i[fresh]
        go = (i > 0) | (j > 0)
        r, i, j = r[go], i[go], j[go]
        move = moves[r, i, j - i + shift]
        i, j = i - (move < 2), j - (move != 1)
    return out


def warp_velocity(depth: np.ndarray, time: np.ndarray, scale: float = 2000.0, band: int | None = None) -> np.ndarray:
    """Depth sample over time sample along the warping path, times scale; undefined at the first sample."""
    n = time.shape[1]
    with np.errstate(all="ignore"):
        return np.where(np.arange(n) > 0, warped(depth, time, band) / np.arange(n) * scale, np.nan)


# --- peaks by wavelets of many widths ----------------------------------------------------------------------------------


def mexican_hat(points: int, width: float) -> np.ndarray:
    t = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)


def wavelet_transform(x: np.ndarray, widths: list[int]) -> np.ndarray:
    """[trace, width, z]: traces convolved with wavelets of at most ten widths' length, as long as the trace."""
    n = x.shape[1]
    out = np.empty((len(x), len(widths), n))
    for k, w in enumerate(widths):
        h = mexican_hat(min(10 * w, n), w)
        size = n + len(h) - 1
        full = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(h, size), size, axis=1)
        out[:, k] = full[:, (len(h) - 1) // 2 :][:, :n]
    return out


def _ridges(top: np.ndarray, widths: list[int]) -> list[tuple[list[int], list[int]]]:
    """Chains of maxima (widths, places) from the widest row to the narrowest: a maximum joins the nearest chain within a quarter of its width; one that has no maximum for more rows than the first width ends."""
    gap = math.ceil(widths[0])
    rows = np.flatnonzero(top.any(1))
    if not len(rows):
        return []
    going, ended = [], []
    for row in range(rows[-1], -1, -1):
        ends = np.array([chain[1][-1] for chain in going])
        for chain in going:
            chain[2] += 1
        for place in np.flatnonzero(top[row]).tolist():
            near = int(np.argmin(np.abs(ends - place))) if len(ends) else -1
            if near >= 0 and abs(int(ends[near]) - place) <= widths[row] / 4:
                chain = going[near]
                chain[0].append(row)
                chain[1].append(place)
                chain[2] = 0
            else:
                going.append([[row], [place], 0])
        ended += [c for c in going[::-1] if c[2] > gap]
        going = [c for c in going if c[2] <= gap]
    return [(c[0], c[1]) for c in ended + going]


def wavelet_peaks(x: np.ndarray, widths: list[int], least_ratio: float = 1.0, noise_percent: float = 10.0) -> np.ndarray:
    """Traces with zeros everywhere but at their peaks: narrow ends of chains of maxima over a quarter of the widths or more, that stand out of the noise.

    The noise at a place is a low percentile of the narrowest transform in a window of a twentieth of the trace.
    """
    n = x.shape[1]
    out = np.zeros(x.shape)
    if n < 3:
        return out
    window = math.ceil(n / 20)
    every = wavelet_transform(x, widths)
    for r, w in enumerate(every):
        top = np.zeros(w.shape, bool)
        top[:, 1:-1] = (w[:, 1:-1] > w[:, :-2]) & (w[:, 1:-1] > w[:, 2:])
        for rows, places in _ridges(top, widths):
            if len(rows) < math.ceil(len(widths) / 4):
                continue
            row, place = rows[-1], places[-1]
            around = w[0, max(place - window // 2, 0) : min(place + window // 2 + window % 2, n)]
            noise = np.percentile(around, noise_percent)
            if noise == 0 or abs(w[row, place] / noise) >= least_ratio:
                out[r, place] = x[r, place]
    return out


# --- adaptive histogram equalisation -----------------------------------------------------------------------------------

BINS = 256


def clipped(histogram: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Histograms [.., bin] cut at a limit [..]; what is cut off is spread evenly over the bins below it, until nothing is left or all are at the limit."""
    h = histogram.astype(float)
    limit = limit[..., None].astype(float)
    left = np.maximum(h - limit, 0).sum(-1, keepdims=True)
    h = np.minimum(h, limit)
    for _ in range(BINS):
        room = h < limit
        share = np.where(room.any(-1, keepdims=True), left / np.maximum(room.sum(-1, keepdims=True), 1), 0)
        if not (share > 0).any():
            break
        grown = np.where(room, h + share, h)
        left = np.maximum(grown - limit, 0).sum(-1, keepdims=True)
        h = np.minimum(grown, limit)
    return h


def equalised(block: np.ndarray, centre: np.ndarray, window: int, clip: float) -> np.ndarray:
    """[trace, z] of values from 0 to 1: each value's rank among those around it.

    block [trace, z, member]: the traces around each centre. The trace is cut into windows; a window's histogram of all members is clipped at `clip` times its size and summed up; a value takes the
    sum at its bin, blended linearly between the windows whose middles are next to it.
    """
    rows, n, _ = block.shape
    tiles = max(1, -(-n // window))
    of = np.minimum(np.arange(n) // window, tiles - 1)
    bin_of = lambda v: np.minimum((v * BINS).astype(np.int64), BINS - 1)
    key = (np.arange(rows)[:, None, None] * tiles + of[None, :, None]) * BINS + bin_of(block)
    h = np.bincount(key.ravel(), minlength=rows * tiles * BINS).reshape(rows, tiles, BINS)
    size = h.sum(-1)
    rank = np.cumsum(clipped(h, np.maximum(clip * size, 1.0)), -1)
    rank = rank / rank[..., -1:]
    middle = np.array([(np.flatnonzero(of == t)[0] + np.flatnonzero(of == t)[-1]) / 2 for t in range(tiles)])
    place = np.interp(np.arange(n), middle, np.arange(tiles))
    low = np.minimum(place.astype(int), tiles - 1)
    high, part = np.minimum(low + 1, tiles - 1), place - low
    r, b = np.arange(rows)[:, None], bin_of(centre)
    return (1 - part) * rank[r, low[None], b] + part * rank[r, high[None], b]


def adaptive_equalisation(tile: Tile, dt: float, stepout: int = 5, window: int = 151, clip: float = 0.5, cut: float = 2.0) -> np.ndarray:
    """[x, y, z]: positive and negative amplitudes equalised apart, each within the block around a trace and scaled by the block's extreme, then freed of frequencies below `cut`. Undefined samples count as zero."""
    block = np.nan_to_num(tile.block(stepout))
    nx, ny, side, _, n = block.shape
    block = np.moveaxis(block.reshape(nx * ny, side * side, n), 1, 2)
    centre = np.nan_to_num(tile.centre()).reshape(nx * ny, n)
    out = np.zeros(centre.shape)
    for sign in (1.0, -1.0):
        part, own = np.maximum(sign * block, 0), np.maximum(sign * centre, 0)
        top = part.max((1, 2))
        there = np.flatnonzero(top > 0)
        if len(there):
            t = top[there, None]
            out[there] += sign * t * equalised(part[there] / t[..., None], own[there] / t, window, clip)
    num, den = butterworth_highpass(cut * 2 * dt)
    return forward_backward(out, num, den).reshape(nx, ny, n)
