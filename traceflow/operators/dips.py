"""Dips of reflectors from gradients, complex-trace phase and structure tensors, and filters of dips. Each function takes a Tile (or several).

Dips are slopes times a factor (sample step / trace distance * dip factor) for each direction; true dip is their length, azimuth the angle of the inline dip against the
crossline dip in degrees. Along traces everything reflects at the ends (the end sample is repeated); missing neighbour traces are the centre.
"""

from __future__ import annotations

import numpy as np

from traceflow.functions import kernels3d as K

from .stencil import Tile, along_z, separable


def dips(x: np.ndarray, y: np.ndarray, z: np.ndarray, inl_factor: float = 1.0, crl_factor: float = 1.0) -> dict[str, np.ndarray]:
    """Dips of planes across the vectors (x, y, z); undefined where z is 0."""
    with np.errstate(all="ignore"):
        crl, inl = -y / z * crl_factor, -x / z * inl_factor
    return {"crl_dip": crl, "inl_dip": inl, "true_dip": np.hypot(crl, inl), "azimuth": np.degrees(np.arctan2(inl, crl))}


def gradient(tile: Tile, d: list[float], s: list[float], dz: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives (weights d) along inlines, crosslines and the trace, smoothed (s) across."""
    return separable(tile, d, s, s, "reflect"), separable(tile, s, d, s, "reflect"), separable(tile, s, s, dz or d, "reflect")


def inner(tile: Tile, by: int) -> Tile:
    """The tile with its centres `by` traces further out, from a halo that much smaller."""
    return Tile(tile.samples, tile.there, tile.h - by)


def around(tile: Tile, fields: list[np.ndarray], by: int) -> list[Tile]:
    """Fields known `by` traces around the tile's centres, as tiles."""
    a = tile.h - by
    there = tile.there[a : a + tile.nx + 2 * by, a : a + tile.ny + 2 * by]
    return [Tile(f, there, by) for f in fields]


def smoothed_tensor(tile: Tile, vectors: tuple[np.ndarray, ...], size: int = 3, size_z: int = 3) -> tuple[np.ndarray, ...]:
    """xx, yy, zz, xy, xz, yz of vectors known size // 2 traces around, smoothed by a Gaussian."""
    x, y, z = vectors
    s, sz = K.gaussian(size), K.gaussian(size_z)
    products = [x * x, y * y, z * z, x * y, x * z, y * z]
    return tuple(separable(t, s, s, sz, "reflect") for t in around(tile, products, size // 2))


def tensor_measures(e1: np.ndarray, e2: np.ndarray, e3: np.ndarray) -> dict[str, np.ndarray]:
    """Shape measures of eigenvalues, largest first; planarity is relative to e1 alone."""
    with np.errstate(all="ignore"):
        line, plane = (e2 - e3) / (e2 + e3), (e1 - e2) / (e1 + e2)
        return {
            "e1": e1, "e2": e2, "e3": e3, "cline": line, "cplane": plane, "planarity": (e1 - e2) / e1, "coherency": plane**2, "cfault": line * (1 - plane),
            "cchaos": 4 * e1 * e3 * (e1 + e2 + e3) / (e1 + e3) ** 2, "ctype": ((e1 - e2) ** 2 + (e2 - e3) ** 2 + (e1 - e3) ** 2) / (e1**2 + e2**2 + e3**2),
        }


def of_tensor(xx, yy, zz, xy, xz, yz, inl_factor: float = 1.0, crl_factor: float = 1.0) -> dict[str, np.ndarray]:
    """Dips of the planes across the first eigenvector of symmetric tensors, and measures of their eigenvalues."""
    w, v = K.eigen3(xx, yy, zz, xy, xz, yz)
    return {**dips(v[..., 0, 0], v[..., 1, 0], v[..., 2, 0], inl_factor, crl_factor), **tensor_measures(w[..., 0], w[..., 1], w[..., 2])}


def gradient_tensor(tile: Tile, points: int = 3, size: int = 3, size_z: int = 3, **factors) -> dict[str, np.ndarray]:
    """Structure tensor of 3-point or 5-point gradients; a halo of points // 2 + size // 2."""
    d, s = (K.KROON3_D, K.KROON3_S) if points == 3 else (K.FARID5_D, K.FARID5_S)
    return of_tensor(*smoothed_tensor(tile, gradient(inner(tile, size // 2), d, s), size, size_z), **factors)


def of_gradients(x: Tile, y: Tile, z: Tile, size: int = 3, size_z: int = 3, **factors) -> dict[str, np.ndarray]:
    """The same of gradients that are given; a halo of size // 2."""
    fields = tuple(np.nan_to_num(inner(t, size // 2).centre()) for t in (x, y, z))
    return of_tensor(*smoothed_tensor(x, fields, size, size_z), **factors)


def analytic_taps(half: int, band: float) -> np.ndarray:
    """A complex kernel of 2 * half + 1 taps whose convolution gives the band-limited trace and its Hilbert transform: a low-pass of half the band, moved to the middle of the positive frequencies."""
    return 2 * np.array(K.lowpass(half, band / 2)) * np.exp(0.5j * np.pi * np.arange(-half, half + 1))


def analytic_tile(tile: Tile, half: int, band: float) -> tuple[Tile, Tile]:
    """The real and imaginary part of all its traces; samples beyond the ends count as zero."""
    taps = analytic_taps(half, band)[::-1]  # a correlation's taps run the other way
    x = np.nan_to_num(tile.samples)
    return tuple(Tile(np.where(tile.there[..., None], along_z(x, part.tolist()), np.nan), tile.there, tile.h) for part in (taps.real, taps.imag))


def phase_gradient(tile: Tile, half: int = 15, band: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the phase times the squared envelope, by 3-point gradients of the analytic trace; a halo of 1."""
    real, imaginary = analytic_tile(tile, half, band)
    s, h = np.nan_to_num(real.centre()), np.nan_to_num(imaginary.centre())
    return tuple(s * b - h * a for a, b in zip(gradient(real, K.KROON3_D, K.KROON3_S), gradient(imaginary, K.KROON3_D, K.KROON3_S)))


def phase(tile: Tile, half: int = 15, band: float = 0.9, **factors) -> dict[str, np.ndarray]:
    return dips(*phase_gradient(tile, half, band), **factors)


def phase_tensor(tile: Tile, half: int = 15, band: float = 0.9, size: int = 3, size_z: int = 3, weighted: bool = True, **factors) -> dict[str, np.ndarray]:
    """The structure tensor of phase gradients, weighted by their squared envelopes or not; a halo of 1 + size // 2."""
    wide = inner(tile, size // 2)
    p = phase_gradient(wide, half, band)
    if not weighted:
        power = sum(np.nan_to_num(t.centre()) ** 2 for t in analytic_tile(wide, half, band))
        with np.errstate(all="ignore"):
            p = tuple(np.where(power > 0, c / power, 0.0) for c in p)
    return of_tensor(*smoothed_tensor(tile, p, size, size_z), **factors)


def rank_one(x: np.ndarray, y: np.ndarray, z: np.ndarray, **factors) -> dict[str, np.ndarray]:
    """Dips by the tensor of each gradient alone, without smoothing."""
    return of_tensor(x * x, y * y, z * z, x * y, x * z, y * z, **factors)


def vector_filter(tile: Tile, vectors: tuple[np.ndarray, ...], kind: str, by: int, half_z: int) -> tuple[np.ndarray, ...]:
    """The mean ("mean") of the vectors in a block of traces and samples, or the member with the least sum of distances to the others ("l1": absolute, "l2": squared, "x3": absolute plus largest); the first of equals.

    vectors are known `by` traces around. The first and last half_z samples take the value of the nearest whole block; a trace without a whole block is undefined.
    """
    tiles = around(tile, list(vectors), by)
    n = vectors[0].shape[-1]
    r = range(-by, by + 1)
    if n < 2 * half_z + 1:
        return tuple(np.full(tiles[0].centre().shape, np.nan) for _ in vectors)
    whole = slice(half_z, n - half_z)
    members = [tuple(t.neighbour(i, j)[..., half_z + k : n - half_z + k] for t in tiles) for i in r for j in r for k in range(-half_z, half_z + 1)]
    if kind == "mean":
        got = tuple(sum(m[c] for m in members) / len(members) for c in range(3))
    else:
        distance = {"l1": lambda d: sum(np.abs(c) for c in d), "l2": lambda d: sum(c * c for c in d), "x3": lambda d: sum(np.abs(c) for c in d) + np.maximum.reduce([np.abs(c) for c in d])}[kind]
        sums = [np.zeros(members[0][0].shape) for _ in members]
        for a in range(len(members)):
            for b in range(a):
                d = distance([p - q for p, q in zip(members[a], members[b])])
                sums[a] += d
                sums[b] += d
        best = np.argmin(np.round(np.stack(sums), 12), 0)
        got = tuple(np.take_along_axis(np.stack([m[c] for m in members]), best[None], 0)[0] for c in range(3))
    out = []
    for g in got:
        full = np.empty(g.shape[:-1] + (n,))
        full[..., whole], full[..., :half_z], full[..., n - half_z :] = g, g[..., :1], g[..., -1:]
        out.append(full)
    return tuple(out)


def _upward(vectors: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Unit vectors with z positive; zero where z or the vector is."""
    with np.errstate(all="ignore"):
        scale = np.sign(vectors[2]) / np.sqrt(sum(v * v for v in vectors))
        return tuple(np.nan_to_num(v * scale, posinf=0.0, neginf=0.0) for v in vectors)


def filtered_gradient(tile: Tile, kind: str, by: int = 1, half_z: int = 2, **factors) -> dict[str, np.ndarray]:
    """Dips of vector-filtered 3-point gradients; a halo of 1 + by."""
    return dips(*vector_filter(tile, _upward(gradient(inner(tile, by), K.KROON3_D, K.KROON3_S)), kind, by, half_z), **factors)


def filtered_phase(tile: Tile, kind: str, by: int = 1, half_z: int = 2, half: int = 15, band: float = 0.9, **factors) -> dict[str, np.ndarray]:
    """Dips of vector-filtered phase gradients; a halo of 1 + by."""
    return dips(*vector_filter(tile, _upward(phase_gradient(inner(tile, by), half, band)), kind, by, half_z), **factors)


def filtered_dips(inline: Tile, crossline: Tile, kind: str, by: int = 1, half_z: int = 2, inl_factor: float = 1.0, crl_factor: float = 1.0) -> dict[str, np.ndarray]:
    """Vector-filtered dips: of the normals of given inline and crossline dips; a halo of `by`."""
    x, y = (-inner(t, by).centre() / f for t, f in ((inline, inl_factor), (crossline, crl_factor)))
    return dips(*vector_filter(inline, _upward((x, y, np.ones_like(x))), kind, by, half_z), inl_factor, crl_factor)
