"""Local second-order polynomials of a volume: coefficients, tensors of their derivatives, dips. Each function takes a Tile.

A block of samples is fitted by Gaussian-weighted least squares, with a deviation of `sigma` times the block's size less one along each axis. Coefficients are
1, x, y, z, xx, yy, zz, xy, xz, yz; they come from convolutions, whose first and last samples are zero where the block doesn't reach.
"""

from __future__ import annotations

import numpy as np

from traceflow.functions import kernels3d as K

from . import dips
from .decomposition import butterworth_lowpass, forward_backward
from .stencil import Tile
from .structure import block_convolution

NORMS = ("standard", "first", "second", "minmax", "dynamic")
#: Samples of the moving window of the dynamic norm.
WINDOW = 51


def weights(sizes: tuple[int, int, int] = (3, 3, 3), sigma: float = 0.2) -> np.ndarray:
    """[coefficient, di, dj, dz]: what a sample counts for in each coefficient of the block's fit."""
    x, y, z = np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in sizes], indexing="ij")
    spread = [sigma * (n - 1) for n in sizes]
    root = np.exp(-sum(a * a / (4 * s * s) for a, s in zip((x, y, z), spread))).ravel()
    basis = np.stack([np.ones_like(x), x, y, z, x * x, y * y, z * z, x * y, x * z, y * z], -1).reshape(-1, 10)
    return (np.linalg.pinv(root[:, None] * basis) * root).reshape(10, *sizes)


def coefficients(tile: Tile, sizes: tuple[int, int, int] = (3, 3, 3), sigma: float = 0.2) -> list[np.ndarray]:
    """The ten coefficients; those of odd powers have the sign of a convolution."""
    return [block_convolution(tile, w) for w in weights(sizes, sigma)]


def _tensor(second: list[np.ndarray], first: list[np.ndarray], of_second: np.ndarray | float, of_first: np.ndarray | float) -> tuple[np.ndarray, ...]:
    """xx, yy, zz, xy, xz, yz of of_second * A A' + of_first * b b', A the symmetric matrix of second (in that order) and b of first."""
    xx, yy, zz, xy, xz, yz = second
    a = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    square = a @ np.swapaxes(a, -1, -2)
    return tuple(of_second * square[..., i, j] + of_first * first[i] * first[j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))


def shapes(tile: Tile, sizes: tuple[int, int, int] = (3, 3, 3), sigma: float = 0.2, **factors) -> dict[str, np.ndarray]:
    """Eigenvalues, measures and dips of A A' + g b b', with half the second derivatives in A and g = 1 / (8 ((smallest size - 1) sigma)^2)."""
    c = coefficients(tile, sizes, sigma)
    second = [c[4], c[5], c[6], c[7] / 2, c[8] / 2, c[9] / 2]
    return dips.of_tensor(*_tensor(second, c[1:4], 1.0, 1 / (8 * ((min(sizes) - 1) * sigma) ** 2)), **factors)


def tensor_dips(tile: Tile, norm: str = "standard", sizes: tuple[int, int, int] = (3, 3, 3), sigma: float = 0.2, **factors) -> dict[str, np.ndarray]:
    """Dips of tensors of the whole second derivatives and the first ones: added with g = 1 / (4 ((smallest size - 1) sigma)^2) ("standard"), the first or second alone, or
    blended by the squared gradient, scaled to 0 to 1 over the trace ("minmax") or in a moving window ("dynamic"); weight is that share."""
    if norm not in NORMS:
        raise ValueError(f"norm is one of {NORMS}")
    c = coefficients(tile, sizes, sigma)
    second, first = [2 * c[4], 2 * c[5], 2 * c[6], c[7], c[8], c[9]], c[1:4]
    share = np.zeros(c[0].shape)
    if norm in ("minmax", "dynamic"):
        g = sum(b * b for b in first)
        low, high = g.min(-1, keepdims=True), g.max(-1, keepdims=True)
        n = g.shape[-1]
        if norm == "dynamic" and n >= WINDOW:
            around = np.lib.stride_tricks.sliding_window_view(g, WINDOW, axis=-1)
            pad = [(0, 0)] * (g.ndim - 1) + [(WINDOW // 2, WINDOW // 2)]
            low, high = (np.pad(f(around, -1), pad, mode="edge") for f in (np.min, np.max))
        with np.errstate(all="ignore"):
            share = np.nan_to_num((g - low) / (high - low))
    parts = {"standard": (1.0, 1 / (4 * ((min(sizes) - 1) * sigma) ** 2)), "first": (0.0, 1.0), "second": (1.0, 0.0)}
    got = dips.of_tensor(*_tensor(second, first, *parts.get(norm, (1 - share, share))), **factors)
    return {**{k: got[k] for k in ("crl_dip", "inl_dip", "true_dip", "azimuth")}, "weight": share}


def smooth_dips(tile: Tile, most: float, sizes: tuple[int, int, int] = (3, 3, 3), sigma: float = 0.2, cut: float = 0.3, **factors) -> dict[str, np.ndarray]:
    """The dips of `shapes`, those beyond `most` (and undefined ones) as 0, smoothed along the trace by a fourth-order low-pass run forward and back."""
    got = shapes(tile, sizes, sigma, **factors)
    num, den = butterworth_lowpass(cut, 4)
    out = {}
    for name in ("crl_dip", "inl_dip"):
        d = np.nan_to_num(got[name], posinf=np.inf, neginf=-np.inf)
        d = np.where(np.abs(d) > most, 0.0, d)
        out[name] = forward_backward(d.reshape(-1, d.shape[-1]), num, den, 15).reshape(d.shape)
    return out
