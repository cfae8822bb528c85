"""Points in polygons of any number of vertices, masks of lattices, and the scopes of grids.

Polygons are tables of vertices (polygon, seq, x, y) and become tables of edges. A point meets the polygons whose box reaches its cell, then those edges of them that
reach its band of y; crossings to its right are counted, an odd number is inside. So a point costs the edges beside it, not all edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry, gridding, surfaces

#: A point this close to an edge's line is on it.
NEAR = 1e-9
METHODS, SCOPES = ("ltps", "mba", "idw", "nrn"), ("range", "box", "hull", "horizon")


def ring_edges(vertices: DataFrame, key: str = "polygon") -> DataFrame:
    """polygon, x1, y1, x2, y2: each vertex with the next, the last with the first. Polygons of fewer than three vertices have no edges."""
    by = Window.partitionBy(key).orderBy("seq")
    whole = Window.partitionBy(key)
    v = vertices.select(F.col(key).alias("polygon"), *[F.col(c).cast("double").alias(c) for c in "xy"], F.lead(F.struct("x", "y")).over(by).alias("n"), F.first(F.struct("x", "y")).over(by).alias("f"), F.count("*").over(whole).alias("c"))
    to = F.coalesce("n", "f")
    return v.where("c > 2").select("polygon", F.col("x").alias("x1"), F.col("y").alias("y1"), to.x.cast("double").alias("x2"), to.y.cast("double").alias("y2"))


def containing(points: DataFrame, edges: DataFrame, keys: list[str], x: str = "x", y: str = "y", cell: float = 16.0) -> DataFrame:
    """keys, polygon, border: the polygons that hold a point, by the even-odd rule; border: the point is on an edge (of a polygon that needn't hold it otherwise).

    keys tell points apart. cell: side of the cells and height of the bands; results don't depend on it.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    box = edges.groupBy("polygon").agg(*[f(g(f"{c}1", f"{c}2")).alias(f"b{c}{i}") for c in "xy" for f, g, i in ((F.min, F.least, 0), (F.max, F.greatest, 1))])
    box = box.withColumn("cx", F.explode(span("bx0", "bx1"))).withColumn("band", F.explode(span("by0", "by1")))
    own = points.select(*keys, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px is not null and py is not null")
    own = own.withColumn("cx", at("px")).withColumn("band", at("py")).join(box, ["cx", "band"]).where("px between bx0 and bx1 and py between by0 and by1")
    walls = edges.withColumn("band", F.explode(span("y1", "y2")))
    met = own.select(*keys, "polygon", "band", "px", "py").join(walls, ["polygon", "band"])
    cross = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1"))
    within = lambda p, a, b: F.col(p).between(F.least(a, b) - NEAR, F.greatest(a, b) + NEAR)
    on = (F.abs(cross) <= NEAR * F.greatest(F.lit(1.0), F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))) & within("px", "x1", "x2") & within("py", "y1", "y2")
    beside = (F.col("py") >= F.least("y1", "y2")) & (F.col("py") < F.greatest("y1", "y2"))
    right = F.when(F.col("y2") > F.col("y1"), cross > 0).otherwise(cross < 0)
    tally = met.groupBy(*keys, "polygon").agg(F.sum((beside & right).cast("long")).alias("n"), F.max(on).alias("border"))
    return tally.where("border or n % 2 = 1").select(*keys, "polygon", "border")


def masked(cells: DataFrame, crop: DataFrame | None = None, hull: DataFrame | None = None, faults: DataFrame | None = None, cell: float = 16.0) -> DataFrame:
    """The nodes (ix, iy) inside or on the crop polygon and the hull, if given, and not within a closed fault polygon (on its edge is outside).

    crop(polygon, seq, x, y), hull(seq, x, y), faults(fault, seq, x, y, closed).
    """
    wanted = []
    if crop is not None:
        wanted.append(ring_edges(crop.select(F.col("polygon").cast("string").alias("polygon"), "seq", "x", "y")).withColumn("kind", F.lit("crop")))
    if hull is not None:
        wanted.append(ring_edges(hull.select(F.lit("").alias("polygon"), "seq", "x", "y")).withColumn("kind", F.lit("hull")))
    if faults is not None:
        closed = faults.where("closed").select(F.col("fault").cast("string").alias("polygon"), "seq", "x", "y")
        wanted.append(ring_edges(closed).withColumn("kind", F.lit("fault")))
    if not wanted:
        return cells
    edges = wanted[0]
    for w in wanted[1:]:
        edges = edges.unionByName(w)
    edges = edges.select(F.concat_ws(":", "kind", "polygon").alias("polygon"), "x1", "y1", "x2", "y2")
    found = containing(cells.select("ix", "iy"), edges, ["ix", "iy"], "ix", "iy", cell)
    is_ = lambda kind: F.col("polygon").startswith(f"{kind}:")
    flags = found.groupBy("ix", "iy").agg(F.max(is_("crop")).alias("__crop"), F.max(is_("hull")).alias("__hull"), F.max(is_("fault") & ~F.col("border")).alias("__fault"))
    out = cells.join(flags, ["ix", "iy"], "left")
    keep = ~F.coalesce("__fault", F.lit(False))
    if crop is not None:
        keep = keep & F.coalesce("__crop", F.lit(False))
    if hull is not None:
        keep = keep & F.coalesce("__hull", F.lit(False))
    return out.where(keep).drop("__crop", "__hull", "__fault")


def scope_lattice(points: DataFrame, scope: str, step: int = 1, ranges: tuple[int, int, int, int] | None = None, horizon: DataFrame | None = None) -> DataFrame:
    """ix, iy of a scope: the given ranges (first and last ix, first and last iy), the points' box (also for their hull), or the ranges of a horizon(ix, iy)."""
    if scope in ("box", "hull"):
        return gridding.lattice(points, step)
    if scope == "range":
        if ranges is None:
            raise ValueError("scope range needs ranges")
        box = points.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(c) for v, c in zip(ranges, ("x0", "x1", "y0", "y1"))])
    elif scope == "horizon":
        if horizon is None:
            raise ValueError("scope horizon needs a horizon")
        box = horizon.agg(*[f(c).cast("long").alias(n) for c, n0 in (("ix", "x"), ("iy", "y")) for f, n in ((F.min, f"{n0}0"), (F.max, f"{n0}1"))]).where("x0 is not null")
    else:
        raise ValueError(f"scope is one of {SCOPES}")
    s = F.lit(step).cast("long")
    rows = box.select(F.explode(F.sequence("x0", "x1", s)).alias("ix"), "y0", "y1").repartition("ix")
    return rows.select("ix", F.explode(F.sequence("y0", "y1", s)).alias("iy"))


@dataclass(frozen=True)
class GridConfig:
    """How a grid is made, as it is stored: `from_params` reads a flat map of names and texts, `params` gives it back. Tables (crop, faults, horizon) stand under their names."""

    method: str = "idw"
    scope: str = "box"
    step: int = 1
    radius: float = 8000.0
    most: int | None = 50
    levels: int = 10
    ranges: tuple[int, int, int, int] | None = None
    horizon: str | None = None
    crop: str | None = None
    faults: tuple[str, ...] = ()

    #: The names of the stored form.
    NAMES: ClassVar[dict[str, str]] = {"method": "Grid.Method", "scope": "Grid.Scope", "step": "Grid.Step", "radius": "Grid.Radius", "most": "Grid.Points", "levels": "Grid.Levels", "ranges": "Grid.Ranges", "horizon": "Grid.Horizon", "crop": "Grid.Crop"}

    @classmethod
    def from_params(cls, params: dict[str, str]) -> GridConfig:
        """Missing names keep their defaults; an unknown method or scope is an error."""
        kinds = {"step": int, "radius": float, "levels": int, "most": lambda v: int(v) or None, "ranges": lambda v: tuple(int(x) for x in v.split("`"))}
        got = {f: kinds.get(f, str)(params[n]) for f, n in cls.NAMES.items() if params.get(n, "") != ""}
        got["faults"] = tuple(params[f"Grid.Fault.{i}"] for i in range(int(params.get("Grid.Faults", 0))))
        made = cls(**got)
        if made.method not in METHODS or made.scope not in SCOPES:
            raise ValueError(f"method is one of {METHODS}, scope one of {SCOPES}")
        return made

    def params(self) -> dict[str, str]:
        text = lambda v: "`".join(map(str, v)) if isinstance(v, tuple) else str(v)
        out = {n: text(getattr(self, f)) for f, n in self.NAMES.items() if getattr(self, f) is not None}
        if self.most is None:
            out[self.NAMES["most"]] = "0"
        return {**out, "Grid.Faults": str(len(self.faults)), **{f"Grid.Fault.{i}": f for i, f in enumerate(self.faults)}}

    def run(self, points: DataFrame, tables: dict[str, DataFrame], edges: DataFrame | list = ()) -> DataFrame:
        """The grid of points, with the tables that the names stand for."""
        faults = None
        for name in self.faults:
            faults = tables[name] if faults is None else faults.unionByName(tables[name])
        of = lambda name: tables[name] if name else None
        return grid(points, self.method, self.scope, edges, of(self.crop), faults, self.step, self.ranges, of(self.horizon), self.radius, self.most, self.levels)


def grid(points: DataFrame, method: str, scope: str = "box", edges: DataFrame | list = (), crop: DataFrame | None = None, faults: DataFrame | None = None, step: int = 1, ranges=None, horizon=None, radius: float = 8000.0, most: int | None = 50, levels: int = 10, cell: float = 16.0) -> DataFrame:
    """ix, iy, v: points(id, x, y, v) gridded by one of METHODS over one of SCOPES, within crop and hull and outside closed faults.

    edges: fault edges that block the sight between points and nodes, as a table or a short list. Nodes that a method leaves undefined have a null v.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    cells = scope_lattice(points, scope, step, ranges, horizon)
    cells = masked(cells, crop, geometry.convex_hull(points) if scope == "hull" else None, faults, cell)
    if method == "nrn":
        got = gridding.splat(points, edges)
    elif method == "idw":
        got = gridding.idw(cells, points, edges, radius, most)
    elif method == "ltps":
        got = surfaces.thin_plate(cells, points, edges, radius, linear=True, tol=1e-8)
    else:
        own = gridding.splat(points, edges).withColumnRenamed("v", "__own")
        surface, _ = surfaces.multilevel(cells, points, levels, linear=True, tol=1e-8)
        got = surface.join(own, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("__own", "v").alias("v"))
    return cells.join(got, ["ix", "iy"], "left").select("ix", "iy", "v")
