"""Attributes as declarations: inputs, outputs, stepout, margin and typed parameters, checked before a plan is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import Tile, map_tiles
from .volumes import steps_agree


@dataclass(frozen=True)
class Param:
    """A typed parameter: number, text, flag or one of options."""

    kind: type
    default: object
    low: float | None = None
    high: float | None = None
    options: tuple = ()

    def checked(self, name: str, value: object) -> object:
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind):
            raise TypeError(f"{name} must be of type {self.kind.__name__}")
        if self.options and value not in self.options:
            raise ValueError(f"{name} must be one of {self.options}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} must lie within {self.low} and {self.high}")
        return value


@dataclass(frozen=True)
class Attribute:
    """fn(tiles, params) gives an array [x, y, z] for each output; tiles has a Tile for each input, with a halo of stepout."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    fn: Callable[[dict[str, Tile], dict], dict[str, np.ndarray]]
    stepout: int = 0
    margin: int = 0
    params: dict[str, Param] = field(default_factory=dict)

    def settings(self, given: dict) -> dict:
        """All parameters, checked; unknown ones are an error."""
        if unknown := set(given) - set(self.params):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return {n: p.checked(n, given.get(n, p.default)) for n, p in self.params.items()}


REGISTRY: dict[str, Attribute] = {}


def register(name: str, attribute: Attribute) -> Attribute:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = attribute
    return attribute


def compute(attribute: Attribute | str, volumes: dict[str, DataFrame], check_steps: bool = False, **params) -> DataFrame:
    """vec_id, inl, crl and an array per output. volumes: for each input traces(vec_id, inl, crl, samples) of one length.

    Inputs meet by an equi-join on the position; traces that an input lacks have no output. check_steps compares their steps first (an action).
    """
    attribute = REGISTRY[attribute] if isinstance(attribute, str) else attribute
    if missing := set(attribute.inputs) - set(volumes):
        raise ValueError(f"missing inputs: {sorted(missing)}")
    settings = attribute.settings(params)
    first, *others = (volumes[n] for n in attribute.inputs)
    if check_steps and not all(steps_agree(first, o) for o in others):
        raise ValueError("inputs must have the same steps")
    joined = first.select("vec_id", "inl", "crl", F.col("samples").alias("s0"))
    for i, o in enumerate(others, 1):
        joined = joined.join(o.select("inl", "crl", F.col("samples").alias(f"s{i}")), ["inl", "crl"])
    n, m = len(attribute.inputs), attribute.margin
    one = joined.select("vec_id", "inl", "crl", F.concat(*[f"s{i}" for i in range(n)]).alias("samples"))

    def run(tile: Tile) -> dict[str, np.ndarray]:
        parts = np.split(tile.samples, n, axis=-1)
        if m:
            parts = [np.pad(p, [(0, 0), (0, 0), (m, m)], mode="edge") for p in parts]
        got = attribute.fn({k: Tile(p, tile.there, tile.h) for k, p in zip(attribute.inputs, parts)}, settings)
        return {k: v[..., m : v.shape[-1] - m] if m else v for k, v in got.items()}

    return map_tiles(one, run, list(attribute.outputs), attribute.stepout)


def off_centre_sum(tile: Tile) -> np.ndarray:
    """Sum over the traces that lie on neither the inline nor the crossline of the centre."""
    r = [i for i in range(-tile.h, tile.h + 1) if i]
    return sum(tile.neighbour(i, j) for i in r for j in r)


def _mean_without_centre(tiles: dict[str, Tile], _: dict) -> dict[str, np.ndarray]:
    (t,) = tiles.values()
    return {"value": off_centre_sum(t) / ((2 * t.h + 1) ** 2 - 1)}


register("identity", Attribute(("input",), ("value",), lambda t, p: {"value": t["input"].centre()}))
register("multiples", Attribute(("input",), ("once", "twice", "thrice"), lambda t, p: {n: k * t["input"].centre() for k, n in enumerate(("once", "twice", "thrice"), 1)}))
register("mean_of_inputs", Attribute(("first", "second"), ("value",), lambda t, p: {"value": (t["first"].centre() + t["second"].centre()) / 2}))
register("pass_through", Attribute(("first", "second"), ("first_out", "second_out"), lambda t, p: {f"{k}_out": v.centre() for k, v in t.items()}))
register("block_mean", Attribute(("input",), ("value",), _mean_without_centre, 1))
register("block_mean_and_centre", Attribute(("input",), ("value", "centre"), lambda t, p: {**_mean_without_centre(t, p), "centre": t["input"].centre()}, 1))
register("block_difference", Attribute(("first", "second"), ("value",), lambda t, p: {"value": off_centre_sum(t["first"]) - off_centre_sum(t["second"])}, 1))
register("block_sums", Attribute(("first", "second"), ("first_sum", "second_sum"), lambda t, p: {f"{k}_sum": off_centre_sum(v) for k, v in t.items()}, 1))
register(
    "scaled_block_sums",
    Attribute(
        ("first", "second"), ("first_sum", "second_sum"),
        lambda t, p: {f"{k}_sum": (p["scale"] if p["which"] in (k, "both") else 1.0) * off_centre_sum(v) for k, v in t.items()}, 1,
        params={"scale": Param(float, 1.0, -100.0, 100.0), "which": Param(str, "both", options=("first", "second", "both")), "label": Param(str, "")},
    ),
)
