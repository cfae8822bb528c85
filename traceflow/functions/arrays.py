"""Column functions over sample arrays: padding, tapering, windows, filters along a trace. None of them shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pivot(a: Column) -> Column:
    return F.ceil(F.size(a) / 2).cast("int")


def mirror_pad(a: Column) -> Column:
    """The reversed first part, the trace, the reversed last part; edges are repeated."""
    p, n = _pivot(a), F.size(a)
    return F.concat(F.reverse(F.slice(a, F.lit(1), n - p)), a, F.reverse(F.slice(a, n - p + 1, p)))


def symmetric_pad(a: Column) -> Column:
    """As mirror_pad, but the edge samples aren't repeated."""
    p, n = _pivot(a), F.size(a)
    return F.concat(F.reverse(F.slice(a, F.lit(2), n - p)), a, F.reverse(F.slice(a, n - p, p)))


def fft_shift(a: Column) -> Column:
    p, n = _pivot(a), F.size(a)
    return F.concat(F.slice(a, p + 1, n - p), F.slice(a, F.lit(1), p))


def cos_taper(a: Column, width: int) -> Column:
    """Both ends times a half cosine over `width` samples; shorter traces are left alone."""
    w = [(math.cos(-math.pi + math.pi * i / (width - 1)) + 1) / 2 for i in range(width)] if width > 1 else [1.0]
    weights, n = F.array(*map(F.lit, w)), F.size(a)
    tapered = F.transform(a, lambda x, i: x * F.when(i < width, F.get(weights, i)).when(i >= n - width, F.get(weights, n - 1 - i)).otherwise(F.lit(1.0)))
    return F.when(n < 2 * width, a).otherwise(tapered)


def deramp(a: Column) -> Column:
    """Minus the straight line from the first to the last sample."""
    first, last, n = F.get(a, F.lit(0)), F.element_at(a, -1), F.size(a)
    return F.transform(a, lambda x, i: x - (first + (last - first) * i / F.greatest(n - 1, F.lit(1))))


def windowed(a: Column, half: int, fold, start, end=lambda acc: acc) -> Column:
    """For each sample a fold over the samples at most `half` away, clipped at the ends."""
    n = F.size(a)
    return F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1), start, fold, end))


def window_sum(a: Column, half: int) -> Column:
    return windowed(a, half, lambda s, x: s + F.coalesce(x, F.lit(0.0)), F.lit(0.0))


def window_mean(a: Column, half: int) -> Column:
    n = F.size(a)
    return F.transform(F.arrays_zip(window_sum(a, half).alias("s")), lambda t, i: t["s"] / (F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1))


def window_norm(a: Column, half: int) -> Column:
    """Root of the sum of squares."""
    return windowed(a, half, lambda s, x: s + x * x, F.lit(0.0), F.sqrt)


def window_min(a: Column, half: int) -> Column:
    n = F.size(a)
    return F.transform(a, lambda _, i: F.array_min(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def window_max(a: Column, half: int) -> Column:
    n = F.size(a)
    return F.transform(a, lambda _, i: F.array_max(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def window_arg(a: Column, half: int, largest: bool) -> Column:
    """Place of the extreme sample in each window; the first of equals."""
    best = window_max(a, half) if largest else window_min(a, half)
    return F.transform(F.arrays_zip(best.alias("m")), lambda t, i: F.greatest(i - half, F.lit(0)) + F.array_position(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.lit(2 * half + 1)), t["m"]).cast("int") - 1)


def fir(a: Column, kernel: list[float]) -> Column:
    """Correlation with an odd kernel; samples beyond the ends count as zero."""
    h = len(kernel) // 2
    terms = lambda i: [F.lit(k) * F.coalesce(F.when(i + (j - h) >= 0, F.get(a, i + (j - h))), F.lit(0.0)) for j, k in enumerate(kernel) if k]
    return F.transform(a, lambda _, i: sum(terms(i)[1:], terms(i)[0]))


def tkeo(a: Column) -> Column:
    """Teager-Kaiser energy x[i]^2 - x[i-1] x[i+1]; x^2 at the ends."""
    return F.transform(a, lambda x, i: F.when((i == 0) | (i == F.size(a) - 1), x * x).otherwise(x * x - F.get(a, F.greatest(i - 1, F.lit(0))) * F.get(a, i + 1)))


def desa(a: Column, dt: float) -> dict[str, Column]:
    """Instantaneous frequency and amplitude by energy separation of the array and its two differences; null where they have none."""
    # differences to the neighbour before (the first sample itself at the start) and after (the last sample itself at the end)
    back = F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(a, F.greatest(i - 1, F.lit(0)))))
    ahead = F.transform(a, lambda x, i: F.when(i == F.size(a) - 1, x).otherwise(F.get(a, i + 1) - x))
    both = F.arrays_zip(tkeo(a).alias("t"), tkeo(back).alias("b"), tkeo(ahead).alias("f"))
    cos = lambda e: 1 - (e["b"] + e["f"]) / (4 * F.nullif(e["t"], F.lit(0.0)))
    power = lambda e: e["t"] / F.nullif(1 - cos(e) * cos(e), F.lit(0.0))
    return {"frequency": F.transform(both, lambda e: F.when(F.abs(cos(e)) <= 1, F.acos(cos(e)) / (2 * math.pi * dt))), "amplitude": F.transform(both, lambda e: F.when(power(e) >= 0, F.sqrt(power(e))))}


def zero_crossing_block(a: Column) -> Column:
    """Each lobe between sign changes replaced by its extreme sample (gaps and islands along the array): where lobes begin, then one slice a lobe."""
    negative = lambda i: F.coalesce(F.get(a, i) < 0, F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (negative(i) != negative(F.greatest(i - 1, F.lit(0)))))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(a)))
    lobe = lambda p: F.slice(a, p["s"] + 1, p["e"] - p["s"])
    filled = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: F.array_repeat(F.when(negative(p["s"]), F.array_min(lobe(p))).otherwise(F.array_max(lobe(p))), p["e"] - p["s"]))
    return F.when(F.size(a) > 0, F.flatten(filled)).otherwise(a)
