"""Amplitude-versus-offset attributes of intercept I and gradient G: per-sample column expressions, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def crossplot_angle_of(slope: float) -> float:
    """The background trend's angle."""
    return math.pi / 2 + math.atan(slope) if slope < 0 else math.pi / 2 - math.atan(slope)


def fluid_factor(i: Column, g: Column, slope: float = 1.0) -> Column:
    t = crossplot_angle_of(slope)
    return i * math.cos(t) + g * math.sin(t)


def lithology_factor(i: Column, g: Column, slope: float = 1.0) -> Column:
    t = crossplot_angle_of(slope)
    return g * math.cos(t) - i * math.sin(t)


def porosity_factor(i: Column, g: Column, slope: float = 1.0, eps: float = 1e-10) -> Column:
    t = crossplot_angle_of(slope)
    litho = g * math.cos(t) - i * math.sin(t)
    return F.when(F.abs(g - i * slope) <= eps, F.lit(0.0)).when(g > i * slope, -litho).otherwise(litho)


def crossplot_angle(i: Column, g: Column, slope: float = 1.0) -> Column:
    """Degrees; null where either is zero."""
    length = F.sqrt(i * i + g * g)
    angle = F.degrees(F.acos(F.least(F.greatest(lithology_factor(i, g, slope) / F.nullif(length, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))
    return F.when((i != 0) & (g != 0), angle - F.when(g > i * slope, 180.0).otherwise(0.0))


def crossplot_deviation(i: Column, g: Column, sd_i: float, sd_g: float, correlation: float = 0.0) -> Column:
    """Distance from the background trend in standard deviations; they must be positive."""
    if sd_i <= 0 or sd_g <= 0:
        raise ValueError("standard deviations must be positive")
    return F.sqrt(i * i / sd_i**2 + g * g / sd_g**2 - 2 * correlation * i * g / (sd_i * sd_g))


def avo_class(i: Column, g: Column, slope: float = 1.0, class2width: float = 0.0) -> Column:
    """Class 1 to 4 of the base, negative for the top; null where none applies. The first rule that fits counts."""
    below, above = g <= i * slope, g > i * slope
    rules = [
        (F.abs(i) <= class2width, F.when(above, -2).otherwise(2)),
        (below & (g >= 0) & (i <= 0), F.lit(4)),
        (above & (g <= 0) & (i >= 0), F.lit(-4)),
        (below & (g < 0) & (i <= 0), F.lit(3)),
        (above & (g >= 0) & (i >= 0), F.lit(-3)),
        (below & (g < 0) & (i >= 0), F.lit(1)),
        (above & (g > 0) & (i <= 0), F.lit(-1)),
    ]
    out = F.lit(None).cast("int")
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


def fit_angles(values: list[Column], degrees: list[float]) -> dict[str, Column]:
    """Least squares R = I + G sin^2(angle) over angle stacks; quality is R^2 of the sample's own fit."""
    x = [math.sin(math.radians(d)) ** 2 for d in degrees]
    n, mx = len(x), sum(x) / len(x)
    sxx = sum((v - mx) ** 2 for v in x)
    my = sum(values[1:], values[0]) / n
    gradient = sum([(xi - mx) / sxx * v for xi, v in zip(x[1:], values[1:])], (x[0] - mx) / sxx * values[0])
    intercept = my - gradient * mx
    sse = sum([(v - intercept - gradient * xi) * (v - intercept - gradient * xi) for xi, v in zip(x[1:], values[1:])], (values[0] - intercept - gradient * x[0]) * (values[0] - intercept - gradient * x[0]))
    sst = sum([(v - my) * (v - my) for v in values[1:]], (values[0] - my) * (values[0] - my))
    return {"intercept": intercept, "gradient": gradient, "sse": sse, "quality": 1 - sse / F.nullif(sst, F.lit(0.0))}


def fatti_weights(degrees: list[float], vp_vs: float = 1.5) -> list[list[float]]:
    """Rows of the pseudo-inverse of the three-term basis: weights of the stacks for Rp, Rs and Rd."""
    import numpy as np

    a = np.radians(degrees)
    s2, t2 = np.sin(a) ** 2, np.tan(a) ** 2
    basis = np.stack([1 + t2, -8 * s2 / vp_vs**2, -(t2 - 4 * s2 / vp_vs**2)], 1)
    return np.linalg.pinv(basis).tolist()


def weighted(values: list[Column], weights: list[float]) -> Column:
    terms = [F.lit(w) * v for w, v in zip(weights, values)]
    return sum(terms[1:], terms[0])


def variation(stacks: list[Column]) -> Column:
    """The sum of squared departures of all samples of several arrays from their common mean."""
    every = F.concat(*stacks)
    mean = F.aggregate(every, F.lit(0.0), lambda t, x: t + x) / F.size(every)
    return F.aggregate(every, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))


def fit_fatti(values: list[Column], degrees: list[float], total: Column, vp_vs: float = 1.5) -> dict[str, Column]:
    """The three terms of a sample's angle stacks, and quality: one minus what they leave of it over `total`, the variation of its trace's stacks."""
    rp, rs, rd = (weighted(values, w) for w in fatti_weights(degrees, vp_vs))
    left = F.lit(0.0)
    for v, d in zip(values, degrees):
        s2, t2 = math.sin(math.radians(d)) ** 2, math.tan(math.radians(d)) ** 2
        e = v - (rp * (1 + t2) - rs * (8 * s2 / vp_vs**2) - rd * (t2 - 4 * s2 / vp_vs**2))
        left = left + e * e
    return {"rp": rp, "rs": rs, "rd": rd, "quality": 1 - left / F.nullif(total, F.lit(0.0))}


def shuey(vp: Column, vs: Column, rho: Column, vp1: Column, vs1: Column, rho1: Column) -> tuple[Column, Column]:
    """Intercept and gradient of an interface from velocities and densities above (vp, ...) and below (vp1, ...)."""
    rel = lambda a, b: 2 * (b - a) / F.nullif(a + b, F.lit(0.0))
    ratio = (vs + vs1) / F.nullif(vp + vp1, F.lit(0.0))
    i = 0.5 * (rel(vp, vp1) + rel(rho, rho1))
    return i, 0.5 * rel(vp, vp1) - 2 * ratio * ratio * (rel(rho, rho1) + 2 * rel(vs, vs1))
