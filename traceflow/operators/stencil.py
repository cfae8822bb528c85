"""Neighbourhood operators over a lattice of traces.

Traces are dealt to square tiles; a trace near an edge also goes to the tiles that need it as a halo, so one shuffle of
little more than the data serves any stepout, and a tile's memory is bounded by its side. In a tile a missing neighbour
is replaced by the centre trace, and a missing centre gives no output.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import arrays, matrix


class Tile:
    """samples[x, y, z] with a halo of h on each side, and which traces are there."""

    def __init__(self, samples: np.ndarray, there: np.ndarray, h: int):
        self.samples, self.there, self.h = samples, there, h
        self.nx, self.ny = samples.shape[0] - 2 * h, samples.shape[1] - 2 * h

    def centre(self) -> np.ndarray:
        return self.samples[self.h : self.h + self.nx, self.h : self.h + self.ny]

    def neighbour(self, di: int, dj: int) -> np.ndarray:
        """The traces at an offset from each centre; the centre itself where there is none."""
        a, b = slice(self.h + di, self.h + di + self.nx), slice(self.h + dj, self.h + dj + self.ny)
        return np.where(self.there[a, b][..., None], self.samples[a, b], self.centre())

    def block(self, size: int) -> np.ndarray:
        """[x, y, di, dj, z]: the traces at most `size` away."""
        r = range(-size, size + 1)
        return np.stack([np.stack([self.neighbour(i, j) for j in r], 2) for i in r], 2)


def along_z(block: np.ndarray, kernel: list[float], ends: str = "zero") -> np.ndarray:
    """Correlation along the last axis with an odd kernel; samples beyond the ends count as zero, or ("reflect") repeat the trace backwards from its end sample."""
    h = len(kernel) // 2
    pad = [(0, 0)] * (block.ndim - 1) + [(h, h)]
    padded = np.pad(block, pad) if ends == "zero" else np.pad(block, pad, mode="symmetric")
    return sum(k * padded[..., i : i + block.shape[-1]] for i, k in enumerate(kernel) if k)


def separable(tile: Tile, kx: list[float], ky: list[float], kz: list[float], ends: str = "zero") -> np.ndarray:
    """Correlation of each centre's surroundings with the outer product of three odd kernels; undefined samples count as zero."""
    hx, hy = len(kx) // 2, len(ky) // 2
    total = np.zeros_like(tile.centre())
    for i, a in enumerate(kx):
        for j, b in enumerate(ky):
            if a * b:
                total = total + a * b * np.nan_to_num(tile.neighbour(i - hx, j - hy))
    return along_z(total, kz, ends)


def map_tiles(traces: DataFrame, fn: Callable[[Tile], dict[str, np.ndarray]], outputs: list[str], halo: int, side: int = 32, samples: str = "samples") -> DataFrame:
    """vec_id, inl, crl and an array column per output; fn(tile) gives each output as [x, y, z].

    traces(vec_id, inl, crl, samples): one trace a position, of one length. Nulls among samples are undefined (NaN to fn); what fn leaves
    NaN or infinite becomes null.
    """
    lo = lambda c: F.floor((F.col(c) - halo) / side).cast("long")
    hi = lambda c: F.floor((F.col(c) + halo) / side).cast("long")
    dealt = traces.select("vec_id", "inl", "crl", samples).withColumn("tx", F.explode(F.sequence(lo("inl"), hi("inl")))).withColumn("ty", F.explode(F.sequence(lo("crl"), hi("crl"))))

    def run(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        x = table.column("inl").to_numpy() - tx * side + halo
        y = table.column("crl").to_numpy() - ty * side + halo
        ids = table.column("vec_id").to_numpy()
        values = matrix(table.column(samples))
        inside = (x >= halo) & (x < halo + side) & (y >= halo) & (y < halo + side)
        if not inside.any():
            return pa.table({"vec_id": pa.array([], pa.int64()), "inl": pa.array([], pa.int64()), "crl": pa.array([], pa.int64()), **{o: pa.array([], pa.list_(pa.float64())) for o in outputs}})
        cube = np.full((side + 2 * halo, side + 2 * halo, values.shape[1]), np.nan)
        there = np.zeros(cube.shape[:2], bool)
        cube[x, y], there[x, y] = values, True
        got = fn(Tile(cube, there, halo))
        cx, cy = x[inside] - halo, y[inside] - halo
        cols = {"vec_id": ids[inside], "inl": table.column("inl").to_numpy()[inside], "crl": table.column("crl").to_numpy()[inside]}
        for o in outputs:
            v = got[o][cx, cy]
            cols[o] = arrays(v)
        return pa.table(cols)

    schema = "vec_id long, inl long, crl long, " + ", ".join(f"{o} array<double>" for o in outputs)
    return dealt.groupBy("tx", "ty").applyInArrow(run, schema)
