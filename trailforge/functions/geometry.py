"""Column functions on planar geometry: a line is ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angles in degrees up to which a turn is straight or slight, and from which it is a u-turn.
STRAIGHT_MOST, SLIGHT_MOST, U_TURN_LEAST = 25.0, 55.0, 150.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def orient(line: Column, x: Column, y: Column) -> Column:
    """The line from the end nearer to a point; as it is on a tie."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    far = lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)
    return F.when(far(a) <= far(b), line).otherwise(F.reverse(line))


def edge_bearings(line: Column) -> tuple[Column, Column]:
    """Bearings of a line's first and last segments."""
    at = lambda k: F.element_at(line, k)
    return bearing(at(2)["x"] - at(1)["x"], at(2)["y"] - at(1)["y"]), bearing(at(-1)["x"] - at(-2)["x"], at(-1)["y"] - at(-2)["y"])


def turn_angle(into: Column, out: Column) -> Column:
    """Signed turn from one bearing to the next, -180 (inclusive) to 180."""
    return F.pmod(out - into + 180.0, F.lit(360.0)) - 180.0


def turn_kind(angle: Column, straight: float = STRAIGHT_MOST, slight: float = SLIGHT_MOST, u_turn: float = U_TURN_LEAST) -> Column:
    return F.when(F.abs(angle) <= straight, "straight").when(F.abs(angle) <= slight, "slight").when(F.abs(angle) >= u_turn, "u_turn").when(angle > 0, "right").otherwise("left")


def _segments(line: Column) -> Column:
    """Lengths of a line's segments."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])))


def polyline_length(line: Column | str) -> Column:
    return F.aggregate(_segments(_c(line)), F.lit(0.0), lambda t, x: t + x)


def interpolate(line: Column | str, share: float = 0.5) -> Column:
    """The point at a share of the line's length."""
    line = _c(line)
    steps = _segments(line)
    goal = F.aggregate(steps, F.lit(0.0), lambda t, x: t + x) * share
    state = F.struct(F.lit(0.0).alias("done"), F.lit(1).alias("k"), F.lit(0.0).alias("t"), F.lit(False).alias("hit"))

    def step(s, x):
        here = ~s["hit"] & (s["done"] + x >= goal)
        t = F.when(here, F.when(x > 0, (goal - s["done"]) / F.when(x > 0, x)).otherwise(0.0)).otherwise(s["t"])
        return F.struct((s["done"] + x).alias("done"), F.when(s["hit"] | here, s["k"]).otherwise(s["k"] + 1).alias("k"), t.alias("t"), (s["hit"] | here).alias("hit"))

    found = F.aggregate(steps, state, step)
    a, b = F.element_at(line, F.least(found["k"], F.size(line))), F.element_at(line, F.least(found["k"] + 1, F.size(line)))
    return point(a["x"] + found["t"] * (b["x"] - a["x"]), a["y"] + found["t"] * (b["y"] - a["y"]))


def point_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    return distance(px, py, x0 + t * dx, y0 + t * dy)


def bbox(line: Column | str) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax of a line."""
    line = _c(line)
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def boxes_meet(a: dict[str, Column], xmin, ymin, xmax, ymax) -> Column:
    """Whether a box meets a window, borders included."""
    return (a["xmin"] <= xmax) & (a["xmax"] >= xmin) & (a["ymin"] <= ymax) & (a["ymax"] >= ymin)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


#: WGS84.
_A, _F = 6378137.0, 1 / 298.257223563


def utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing by Krüger's series (to the third order; well under a millimetre inside a zone)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    centre = F.radians((zone if zone is not None else utm_zone(lon)) * 6 - 183.0)
    away = F.radians(lon) - centre
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi = F.atan2(t, F.cos(away))
    eta = atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = eta
    north = xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996 * radius
    return 500000 + k * east, k * north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def rounded(line: Column | str, digits: int = 5) -> Column:
    """A line's coordinates rounded half to even."""
    return F.transform(_c(line), lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))
