"""Geometry of lines and horizons: ends, extents, clipping, intersections, export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_ends(horizon: DataFrame) -> DataFrame:
    """line, first and last defined trace with their z: the seeds of a hull. Lines without a defined node have no row."""
    h = horizon.where("z is not null")
    return h.groupBy("line").agg(F.min("trcnr").alias("first_trc"), F.min_by("z", "trcnr").alias("first_z"), F.max("trcnr").alias("last_trc"), F.max_by("z", "trcnr").alias("last_z"))


def convex_hull(points: DataFrame) -> DataFrame:
    """seq, x, y: the corners, anticlockwise from the lowest left.

    Each partition sends only the corners of its own hull; the corners of all partitions, few and growing
    with the logarithm of the points, meet in rounds of merges by pairs of groups.
    """
    import pandas as pd

    def corners(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
        pts = sorted(set(pts))
        if len(pts) < 3:
            return pts

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return chain(pts) + chain(pts[::-1])

    def part(frames):
        kept: list = []
        for f in frames:
            kept = corners(kept + list(zip(f.x.tolist(), f.y.tolist())))
        if kept:
            yield pd.DataFrame(kept, columns=["x", "y"])

    def merge(f):
        return pd.DataFrame([(i, *p) for i, p in enumerate(corners(list(zip(f.x.tolist(), f.y.tolist()))))], columns=["seq", "x", "y"])

    small = points.where("x is not null and y is not null").select("x", "y").mapInPandas(part, "x double, y double")
    for groups in (64, 8):
        small = small.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(groups)).alias("g")).applyInPandas(lambda f: merge(f)[["x", "y"]], "x double, y double")
    return small.groupBy(F.lit(0).alias("g")).applyInPandas(merge, "seq int, x double, y double")


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """Struct (x1, y1, x2, y2) of the part of a segment within a rectangle (xmin, ymin, xmax, ymax), by Liang and Barsky; null if none."""
    dx, dy = x2 - x1, y2 - y1
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x1 - box[0]), (dx, box[2] - x1), (-dy, y1 - box[1]), (dy, box[3] - y1)):
        r = F.try_divide(q, p)
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
        out = out | ((p == 0) & (q < 0))
    ok = ~out & (low <= high)
    return F.when(ok, F.struct((x1 + low * dx).alias("x1"), (y1 + low * dy).alias("y1"), (x1 + high * dx).alias("x2"), (y1 + high * dy).alias("y2")))


def snapped_range(start: Column, stop: Column, step: int) -> tuple[Column, Column]:
    """The range widened outward to multiples of the step."""
    return (F.floor(start / step) * step).cast("long"), (F.ceil(stop / step) * step).cast("long")


def polyline_wkt(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """key, wkt: one LINESTRING per key, its vertices in order; keys with fewer than two vertices have no row."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")))).alias("p"))
    return g.where("size(p) > 1").select(key, F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", F.transform("p", lambda v: F.concat_ws(" ", v["x"], v["y"]))), F.lit(")")).alias("wkt"))


def geotransform(x0: Column, y0: Column, inl_dx: Column, inl_dy: Column, crl_dx: Column, crl_dy: Column) -> Column:
    """The six affine numbers of a raster whose columns run along crosslines and whose rows along inlines."""
    return F.array(crl_dx, inl_dx, x0 - (inl_dx + crl_dx) / 2, crl_dy, inl_dy, y0 - (inl_dy + crl_dy) / 2)


def markers_on_tracks(markers: DataFrame, tracks: DataFrame) -> DataFrame:
    """well, marker, md, x, y: the place of each marker on its well's track, between the stations around it; null outside the track. Tracks with a column tvdss give that, too.

    tracks(well, md, x, y) become segments (lead along a well), and a marker joins its segment by well and range.
    """
    from pyspark.sql import Window

    names = ["x", "y"] + ["tvdss"] * ("tvdss" in tracks.columns)
    w = Window.partitionBy("well").orderBy("md")
    seg = tracks.select("well", F.col("md").alias("md0"), F.lead("md").over(w).alias("md1"), *names, *[F.lead(c).over(w).alias(f"{c}1") for c in names]).where("md1 > md0")
    j = markers.join(seg, (markers.well == seg.well) & (markers.md >= seg.md0) & ((markers.md < seg.md1)), "left")
    t = (F.col("md") - F.col("md0")) / (F.col("md1") - F.col("md0"))
    return j.select(markers.well, "marker", "md", *[(F.col(c) + t * (F.col(f"{c}1") - F.col(c))).alias(c) for c in names])


def to_map(inl: Column, crl: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a position; affine is (x0, y0, dx and dy of an inline, dx and dy of a crossline)."""
    x0, y0, ix, iy, cx, cy = affine
    return x0 + ix * inl + cx * crl, y0 + iy * inl + cy * crl


def from_map(x: Column, y: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """The fractional position of map coordinates: to_map backwards."""
    x0, y0, ix, iy, cx, cy = affine
    det = ix * cy - iy * cx
    if det == 0:
        raise ValueError("inlines and crosslines run along each other")
    return (cy * (x - x0) - cx * (y - y0)) / det, (ix * (y - y0) - iy * (x - x0)) / det


def scattered(lines: DataFrame, surface: DataFrame, contours: DataFrame, affine: tuple) -> DataFrame:
    """source, key, n, x, y, v: the points that a grid is made of, in fractional positions of the lattice.

    lines(line, trcnr, x, y, z) and contours(polygon, seq, x, y, z) are in map coordinates, surface(ix, iy, z) in positions. Undefined z are left out.
    """
    moved = lambda df: df.withColumns(dict(zip(("px", "py"), from_map(F.col("x"), F.col("y"), affine))))
    two = moved(lines).select(F.lit("lines").alias("source"), F.col("line").cast("string").alias("key"), F.col("trcnr").cast("long").alias("n"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("z").alias("v"))
    three = surface.select(F.lit("surface"), F.col("ix").cast("string"), F.col("iy").cast("long"), F.col("ix").cast("double"), F.col("iy").cast("double"), "z")
    drawn = moved(contours).select(F.lit("contours"), F.col("polygon").cast("string"), F.col("seq").cast("long"), "px", "py", "z")
    return two.union(three).union(drawn).where("v is not null and x is not null and y is not null")


def hull_points(points: DataFrame) -> DataFrame:
    """source, key, x, y, v of the first and the last point of each line, inline and contour: all that can be corners of the hull of straight lines."""
    ends = F.array(F.min_by(F.struct("x", "y", "v"), "n"), F.max_by(F.struct("x", "y", "v"), "n"))
    return points.groupBy("source", "key").agg(ends.alias("e")).select("source", "key", F.explode("e").alias("e")).select("source", "key", "e.x", "e.y", "e.v").distinct()


def extent(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """x0, x1, y0, y1: the whole numbers around all parts, each a table with the names of its two columns; no row without a point."""
    every = None
    for df, x, y in parts:
        one = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
        every = one if every is None else every.unionByName(one)
    box = every.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).where("x0 is not null")
    return box.select(*[f(c).cast("long").alias(c) for c, f in (("x0", F.floor), ("x1", F.ceil), ("y0", F.floor), ("y1", F.ceil))])


def in_feet(df: DataFrame) -> DataFrame:
    """Depth columns under their names in feet; values stay."""
    return df.withColumnsRenamed({c: f"{c}(ft)" for c in ("md", "tvdss") if c in df.columns})


def layer_value(z: Column, attribute: str, in_time: bool) -> Column:
    """What a horizon layer shows: z in milliseconds where z itself is asked for in a time survey."""
    return z * 1000 if attribute == "zvals" and in_time else z


def well_layer(wells: DataFrame, kinds: list[str]) -> DataFrame:
    """name, uwid, status (the number of the well's kind, null if unknown), wkt of wells(name, uwid, kind, x, y)."""
    status = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    point = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    return wells.select("name", "uwid", F.when(status >= 0, status).alias("status"), point.alias("wkt"))


def shapes_wkt(vertices: DataFrame) -> DataFrame:
    """name, wkt, closed of vertices(name, seq, x, y, closed): a polygon, its ring closed by the first vertex, or a line; too short ones have no row."""
    g = vertices.groupBy("name").agg(F.max("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("seq", F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y")))).alias("p"))
    body = lambda p: F.concat_ws(", ", F.transform(p, lambda v: F.concat_ws(" ", v["x"], v["y"])))
    ring = F.concat(F.lit("POLYGON (("), body(F.concat("p", F.slice("p", F.lit(1), F.lit(1)))), F.lit("))"))
    line = F.concat(F.lit("LINESTRING ("), body(F.col("p")), F.lit(")"))
    return g.where(F.size("p") > F.when(F.col("closed"), 2).otherwise(1)).select("name", F.when(F.col("closed"), ring).otherwise(line).alias("wkt"), "closed")


def survey_ring(traces: DataFrame, affine: tuple) -> DataFrame:
    """seq, x, y: the survey's corners in map coordinates, back to the first."""
    box = traces.agg(F.min("inl").alias("i0"), F.max("inl").alias("i1"), F.min("crl").alias("c0"), F.max("crl").alias("c1")).where("i0 is not null")
    corners = F.array(*[F.struct(F.col(i).alias("i"), F.col(c).alias("c")) for i, c in (("i0", "c0"), ("i0", "c1"), ("i1", "c1"), ("i1", "c0"), ("i0", "c0"))])
    x, y = to_map(F.col("p.i"), F.col("p.c"), affine)
    return box.select(F.posexplode(corners).alias("seq", "p")).select("seq", x.alias("x"), y.alias("y"))


def raster_bands(horizon: DataFrame, row: str, col: str, bands: dict[str, tuple[Column, int]]) -> DataFrame:
    """Every cell of the horizon's bounding lattice with its bands (rounded), null where the horizon is undefined."""
    box = horizon.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate((row, col)) for n, f in (("lo", F.min), ("hi", F.max))]).where("lo_0 is not null")
    cells = box.select(F.explode(F.sequence("lo_0", "hi_0")).alias(row), "lo_1", "hi_1").repartition(row).select(row, F.explode(F.sequence("lo_1", "hi_1")).alias(col))
    values = horizon.select(row, col, *[F.round(v, d).alias(n) for n, (v, d) in bands.items()])
    return cells.join(values, [row, col], "left")


def closed_at(vertices: DataFrame, z: float) -> DataFrame:
    """vertices(name, seq, x, y) numbered from 0 and closed by the first one again, all at one z."""
    g = vertices.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    e = g.select("name", F.posexplode(F.concat("p", F.slice("p", F.lit(1), F.lit(1)))).alias("seq", "v"))
    return e.select("name", F.col("seq").cast("long").alias("seq"), "v.x", "v.y", F.lit(z).alias("z"))


def simplified(vertices: DataFrame, key: str, order: str, tolerances: tuple[float, float, float]) -> DataFrame:
    """The vertices (key, order, x, y, z) of each line that stay when others are within the tolerances of the chords between them, axis by axis.

    A chord is split at the vertex that is farthest off in units of the tolerances. A line is one group: its vertices must fit a task.
    """
    import numpy as np

    def keep(f):
        f = f.sort_values(order)
        p = f[["x", "y", "z"]].to_numpy(float) / np.array(tolerances)
        stays = np.zeros(len(p), bool)
        if len(p):
            stays[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            a, z = todo.pop()
            if z - a < 2:
                continue
            chord = p[z] - p[a]
            t = np.clip((p[a + 1 : z] - p[a]) @ chord / max(float(chord @ chord), 1e-300), 0, 1)
            off = np.abs(p[a + 1 : z] - p[a] - t[:, None] * chord).max(1)
            k = int(off.argmax())
            if off[k] > 1:
                stays[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, z)]
        return f[stays]

    return vertices.groupBy(key).applyInPandas(keep, vertices.schema)
