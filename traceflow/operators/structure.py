"""Structure attributes of a tile: dips, tensors, curvature, structure-preserving filters. Each function takes a Tile."""

from __future__ import annotations

import numpy as np

from traceflow.functions import kernels3d as K

from .dips import tensor_measures
from .stencil import Tile, along_z, separable

# Normals of the thirteen planar elements, in their order (the first of equal variances counts, and the element's number is a result).
NORMALS = [(0, 0, 1), (0, 1, -1), (0, 1, 1), (1, 0, -1), (1, 0, 1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1), (0, 1, 0), (1, 0, 0), (1, -1, 0), (-1, -1, 0)]


def block_sum(tile: Tile, weights: np.ndarray) -> np.ndarray:
    """Sum of a block of weights [di, dj, dz] times the surroundings; undefined samples and those beyond the ends count as zero."""
    h, g = weights.shape[0] // 2, weights.shape[1] // 2
    return sum(along_z(np.nan_to_num(tile.neighbour(i - h, j - g)), weights[i, j].tolist()) for i in range(weights.shape[0]) for j in range(weights.shape[1]))


def block_convolution(tile: Tile, weights: np.ndarray) -> np.ndarray:
    """Convolution with a block of weights [di, dj, dz], which are turned around; the first and last samples that a whole block doesn't reach are zero."""
    out = block_sum(tile, weights[::-1, ::-1, ::-1])
    h = weights.shape[2] // 2
    if h:
        out[..., :h] = 0
        out[..., max(out.shape[-1] - h, 0) :] = 0
    return out


def circular(kind: str, size: int, cut: float):
    """A circularly symmetric filter of each z slice: "low", "high", "band" or "reject"."""
    w = K.circular(kind, size, cut)
    return lambda tile: {"value": block_sum(tile, w[:, :, None])}


def least_variance(tile: Tile, size: int, deviations: float) -> dict[str, np.ndarray]:
    """Mean, median, trimmed mean and number of the planar element with the smallest variance; the first of equals.

    Samples beyond a trace's ends and undefined ones are left out; elements of fewer than two samples don't count.
    """
    h = size // 2
    block = tile.block(h)
    nz = block.shape[-1]
    padded = np.pad(block, [(0, 0)] * 4 + [(h, h)], constant_values=np.nan)
    r = range(-h, h + 1)
    best = {k: np.full(tile.centre().shape, np.nan) for k in ("mean", "median", "trimmed", "element")}
    least = np.full(tile.centre().shape, np.inf)
    with np.errstate(all="ignore"):
        for e, n in enumerate(NORMALS):
            v = np.stack([padded[:, :, i + h, j + h, k + h : k + h + nz] for i in r for j in r for k in r if n[0] * i + n[1] * j + n[2] * k == 0], -1)
            count = np.isfinite(v).sum(-1)
            mean = np.nansum(v, -1) / count
            var = np.round(np.nansum((v - mean[..., None]) ** 2, -1) / (count - 1), 12)
            near = np.where(np.abs(v - mean[..., None]) <= deviations * np.sqrt(var)[..., None], v, np.nan)
            # a plain sort instead of nanmedian: undefined samples go last
            s = np.sort(v, -1)
            at = lambda i: np.take_along_axis(s, i[..., None], -1)[..., 0]  # noqa: B023, E731
            median = (at(np.maximum(count - 1, 0) // 2) + at(np.minimum(count // 2, v.shape[-1] - 1))) / 2
            better = (count >= 2) & (var < least)
            least = np.where(better, var, least)
            kept = np.isfinite(near).sum(-1)
            for k, x in (("mean", mean), ("median", median), ("trimmed", np.where(kept > 0, np.nansum(near, -1) / kept, mean)), ("element", np.full(mean.shape, float(e)))):
                best[k] = np.where(better, x, best[k])
    return best


def _gradients(tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = [-0.5, 0.0, 0.5]
    return separable(tile, d, [1.0], [1.0]), separable(tile, [1.0], d, [1.0]), separable(tile, [1.0], [1.0], d)


def smooth_gradients(tile: Tile, d: list[float] = K.KROON3_D, s: list[float] = K.KROON3_S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives along inlines, crosslines and the trace, smoothed across."""
    return separable(tile, d, s, s), separable(tile, s, d, s), separable(tile, s, s, d)


def gradient_mean(tile: Tile) -> dict[str, np.ndarray]:
    return {"value": sum(smooth_gradients(tile)) / 3}


def _dips(x, y, z) -> dict[str, np.ndarray]:
    with np.errstate(all="ignore"):
        return {"crl_dip": -y / z, "inl_dip": -x / z}


def gradient_dips(tile: Tile) -> dict[str, np.ndarray]:
    return _dips(*_gradients(tile))


def _inner(tile: Tile, fields: list[np.ndarray]) -> list[Tile]:
    """Fields that are known one trace around the tile's centres, as tiles of halo one."""
    there = tile.there[tile.h - 1 : tile.h + tile.nx + 1, tile.h - 1 : tile.h + tile.ny + 1]
    return [Tile(f, there, 1) for f in fields]


def _wider(tile: Tile) -> Tile:
    """The tile with centres one trace further out, from a halo one smaller."""
    return Tile(tile.samples, tile.there, tile.h - 1)


def _smoothed(tile: Tile, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, ...]:
    x, y, z = vectors
    s = K.gaussian(3)
    return tuple(separable(t, s, s, s) for t in _inner(tile, [weight * a * b for a, b in ((x, x), (y, y), (z, z), (x, y), (x, z), (y, z))]))


def _shapes(tensor: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    w, v = K.eigen3(*tensor)
    return {**_dips(v[..., 0, 0], v[..., 1, 0], v[..., 2, 0]), **tensor_measures(w[..., 0], w[..., 1], w[..., 2])}


def tensor_attributes(tile: Tile) -> dict[str, np.ndarray]:
    """Dips and shape measures of the smoothed gradient structure tensor."""
    return _shapes(_smoothed(tile, smooth_gradients(_wider(tile))))


def median_dips(kind: str, half: int = 2):
    """Dips of unit normals filtered along the trace: their mean, or the member with the least summed distance to the others."""

    def run(tile: Tile) -> dict[str, np.ndarray]:
        g = np.stack(smooth_gradients(tile), -1)
        with np.errstate(all="ignore"):
            n = np.nan_to_num(g / np.sqrt((g * g).sum(-1, keepdims=True))) * np.where(g[..., 2:] < 0, -1.0, 1.0)
        nz = n.shape[2]
        win = np.stack([n[:, :, np.clip(np.arange(nz) + k, 0, nz - 1)] for k in range(-half, half + 1)], 3)
        if kind == "mean":
            m = win.mean(3)
        else:
            d = win[:, :, :, :, None] - win[:, :, :, None, :]
            dist = {"l1": lambda: np.abs(d).sum(-1), "l2": lambda: (d * d).sum(-1), "x3": lambda: np.abs(d).max(-1) + np.abs(d).sum(-1)}[kind]().sum(4)
            m = np.take_along_axis(win, np.argmin(np.round(dist, 12), 3)[..., None, None], 3)[:, :, :, 0]
        return _dips(m[..., 0], m[..., 1], m[..., 2])

    return run


def dip_curvature(inline: Tile, crossline: Tile, inl_factor: float = 1.0, crl_factor: float = 1.0) -> dict[str, np.ndarray]:
    """Curvatures of the surfaces whose inline and crossline dips are given, by the shape operator of the normals along (u, v, 1).

    A dip divided by its factor (sample step / trace distance * dip factor) is a slope in samples per trace. Derivatives are the 3-point operator's.
    """
    tu, tv = Tile(-inline.samples / inl_factor, inline.there, inline.h), Tile(-crossline.samples / crl_factor, crossline.there, crossline.h)
    d, s = K.KROON3_D, K.KROON3_S
    slopes = {f"{n}{a}": separable(t, *k) for n, t in (("u", tu), ("v", tv)) for a, k in (("x", (d, s, s)), ("y", (s, d, s)), ("z", (s, s, d)))}
    with np.errstate(all="ignore"):
        return K.shape_curvatures(tu.centre(), tv.centre(), **slopes)


def polynomial_tensor(tile: Tile) -> dict[str, np.ndarray]:
    """Eigenvalues and dips of A A' + g b b' of a local second-order polynomial: A its second, b its first derivatives."""
    w = K.polynomial_weights(3)
    c = [block_sum(tile, w[i]) for i in range(10)]
    a = np.stack([np.stack([2 * c[4], c[7], c[8]], -1), np.stack([c[7], 2 * c[5], c[9]], -1), np.stack([c[8], c[9], 2 * c[6]], -1)], -2)
    b = np.stack([c[1], c[2], c[3]], -1)
    t = a @ np.swapaxes(a, -1, -2) + b[..., :, None] * b[..., None, :] / 32
    got = _shapes((t[..., 0, 0], t[..., 1, 1], t[..., 2, 2], t[..., 0, 1], t[..., 0, 2], t[..., 1, 2]))
    return {k: got[k] for k in ("e1", "e2", "e3", "crl_dip", "inl_dip")}
