"""AVO polarization: angle, quality and strength of the intercept-gradient cloud in a window along the trace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.functions import arrays as A

from .stencil import Tile, along_z, map_tiles


def _energy(a2: Column, b2: Column, ab: Column) -> Column:
    return F.sqrt(4 * ab * ab + (a2 - b2) * (a2 - b2))


def angle_of(a2: Column, b2: Column, ab: Column) -> Column:
    """Degrees of the main axis from sums of A*A, B*B and A*B; null where it isn't defined."""
    return F.degrees(F.atan(2 * ab / F.nullif(a2 - b2 + _energy(a2, b2, ab), F.lit(0.0))))


def quality_of(a2: Column, b2: Column, ab: Column) -> Column:
    return _energy(a2, b2, ab) / F.nullif(a2 + b2, F.lit(0.0))


def products(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds the product traces aa, bb, ab."""
    mul = lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0)))
    return df.withColumns({"aa": mul(a, a), "bb": mul(b, b), "ab": mul(a, b)})


def event_sums(df: DataFrame, half: int) -> DataFrame:
    """Adds a2, b2, ab2: window sums of the products along each trace."""
    return products(df).withColumns({"a2": A.window_sum(F.col("aa"), half), "b2": A.window_sum(F.col("bb"), half), "ab2": A.window_sum(F.col("ab"), half)})


def background_sums(df: DataFrame, stepout: int, half: int) -> DataFrame:
    """vec_id, inl, crl, z, a2, b2, ab2 over the traces within stepout of each trace (a missing neighbour counts as the centre) and the window.

    Traces go to tiles with a halo: one shuffle of little more than the data. Products of a trace are made once, summed over neighbours, then over the window.
    """
    names = ["a2", "b2", "ab2"]

    def run(tile: Tile) -> dict[str, np.ndarray]:
        n = tile.samples.shape[-1] // 2
        a, b = np.nan_to_num(tile.samples[..., :n]), np.nan_to_num(tile.samples[..., n:])
        r = range(-stepout, stepout + 1)
        out = {}
        for name, p in zip(names, (a * a, b * b, a * b)):
            own = Tile(p, tile.there, tile.h)
            out[name] = along_z(sum(own.neighbour(i, j) for i in r for j in r), [1.0] * (2 * half + 1))
        return out

    both = map_tiles(df.withColumn("__ab", F.concat("a", "b")), run, names, stepout, samples="__ab")
    return both.select("vec_id", "inl", "crl", F.posexplode(F.arrays_zip(*names)).alias("z", "s")).select("vec_id", "inl", "crl", F.col("z").cast("long").alias("z"), *[F.col(f"s.{c}").alias(c) for c in names])


def strength(half: int, a: str = "a", b: str = "b") -> Column:
    """Length of (A, B) at the window's smallest A plus that at its largest A; the first of equals."""
    low, high = A.window_arg(F.col(a), half, False), A.window_arg(F.col(a), half, True)
    at = lambda k: F.sqrt(F.get(F.col(a), k) * F.get(F.col(a), k) + F.get(F.col(b), k) * F.get(F.col(b), k))
    return F.zip_with(low, high, lambda p, q: at(p) + at(q))
