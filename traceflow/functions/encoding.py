"""Column functions of exchange formats: well-known binary of geometries, and percent coding. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(x: Column) -> Column:
    """The 64 bits of a double, as 16 hexadecimal digits."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(x.cast("double"), F.lit(0.0))).cast("long")
    return F.when(x.isNotNull(), F.lpad(F.hex(bits), 16, "0"))


def _count(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def _pairs(x: Column, y: Column) -> Column:
    """The coordinates of arrays of equal length, one after another."""
    return F.array_join(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.concat(_bits(p["x"]), _bits(p["y"]))), "")


def wkb_point(x: Column, y: Column) -> Column:
    """A point, in big-endian bytes; null if a coordinate is."""
    return F.unhex(F.concat(F.lit("0000000001"), _bits(x), _bits(y)))


def wkb_linestring(x: Column, y: Column) -> Column:
    """A line through arrays of coordinates."""
    return F.unhex(F.concat(F.lit("0000000002"), _count(F.size(x)), _pairs(x, y)))


def wkb_polygon(x: Column, y: Column) -> Column:
    """A polygon of one ring, which is closed here if its last vertex isn't its first."""
    closed = (F.element_at(x, 1) == F.element_at(x, -1)) & (F.element_at(y, 1) == F.element_at(y, -1))
    shut = lambda c: F.when(closed, c).otherwise(F.concat(c, F.slice(c, 1, 1)))
    return F.when(F.size(x) > 0, F.unhex(F.concat(F.lit("000000000300000001"), _count(F.size(shut(x))), _pairs(shut(x), shut(y)))))


def percent_encode(s: Column) -> Column:
    """ASCII letters and digits as they are, every other byte of UTF-8 as % and two digits; a backslash comes out as two."""
    digits = F.hex(F.encode(s, "UTF-8"))
    pairs = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    plain = lambda p: p.rlike("^(3[0-9]|[46][1-9A-F]|[57][0-9A])$")
    one = lambda p: F.when(plain(p), F.chr(F.conv(p, 16, 10).cast("int"))).when(p == "5C", "%5C%5C").otherwise(F.concat(F.lit("%"), p))
    return F.when(s.isNotNull(), F.array_join(F.transform(pairs, one), ""))


def percent_decode(s: Column) -> Column:
    """% and two digits as the byte they stand for (what isn't a digit counts as 0, a backslash as two), all else as it is."""
    parts = F.regexp_extract_all(s, F.lit("(?s)%..|."), F.lit(0))
    code = lambda p: F.regexp_replace(F.upper(F.substring(p, 2, 2)), "[^0-9A-F]", "0")
    one = lambda p: F.when(F.length(p) == 3, F.when(code(p) == "5C", "5C5C").otherwise(code(p))).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.when(s.isNotNull(), F.decode(F.unhex(F.array_join(F.transform(parts, one), "")), "UTF-8"))
