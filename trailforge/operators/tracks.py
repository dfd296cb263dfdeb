"""Recorded tracks: cleaning, and how much of a route lies along them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Bounds (lon and lat), the fastest speed, the gap above which speed is not judged, the longest step, the shortest."""

    bounds: tuple[float, float, float, float] = (29.40, 59.55, 30.90, 60.35)
    max_speed_kmh: float = 80.0
    max_gap_seconds: float = 600.0
    max_jump_m: float = 150.0
    min_step_m: float = 1.0


def vincenty(lon0: float, lat0: float, lon1: float, lat1: float) -> float:
    """Metres between two points on the WGS84 ellipsoid; the great circle where the series does not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    if lon0 == lon1 and lat0 == lat1:
        return 0.0
    u0, u1 = math.atan((1 - f) * math.tan(math.radians(lat0))), math.atan((1 - f) * math.tan(math.radians(lat1)))
    s0, c0, s1, c1 = math.sin(u0), math.cos(u0), math.sin(u1), math.cos(u1)
    away = math.radians(lon1 - lon0)
    lam = away
    for _ in range(100):
        sl, cl = math.sin(lam), math.cos(lam)
        sin = math.hypot(c1 * sl, c0 * s1 - s0 * c1 * cl)
        if sin == 0:
            return 0.0
        cos = s0 * s1 + c0 * c1 * cl
        sigma = math.atan2(sin, cos)
        alpha = c0 * c1 * sl / sin
        square = 1 - alpha * alpha
        mid = cos - 2 * s0 * s1 / square if square else 0.0
        c = f / 16 * square * (4 + f * (4 - 3 * square))
        new = away + (1 - c) * f * alpha * (sigma + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        if abs(new - lam) < 1e-12:
            break
        lam = new
    else:
        h = math.sin(math.radians(lat1 - lat0) / 2) ** 2 + math.cos(math.radians(lat0)) * math.cos(math.radians(lat1)) * math.sin(away / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))
    u = square * (a * a - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
    small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    delta = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
    return b * big * (sigma - delta)


def planar(x0: float, y0: float, x1: float, y1: float) -> float:
    return math.hypot(x1 - x0, y1 - y0)


class Cleaner:
    """Decides on one point after another; keeps what it needs of the last kept point."""

    def __init__(self, rules: Rules, measure=vincenty):
        self.rules, self.measure = rules, measure
        self.last: tuple[float, float, float | None] | None = None
        self.part = 0

    def take(self, x: float, y: float, t: float | None) -> int | None:
        """The part that the point goes to, or None if it is dropped; t: seconds."""
        r = self.rules
        if not (r.bounds[0] <= x <= r.bounds[2] and r.bounds[1] <= y <= r.bounds[3]):
            return None
        if self.last is not None:
            d = self.measure(self.last[0], self.last[1], x, y)
            if d < r.min_step_m:
                return None
            if t is not None and self.last[2] is not None:
                seconds = t - self.last[2]
                if seconds <= 0 or (seconds <= r.max_gap_seconds and 3.6 * d / seconds > r.max_speed_kmh):
                    return None
            if d > r.max_jump_m:
                self.part += 1
        self.last = (x, y, t)
        return self.part


def clean(points: DataFrame, keys: list[str], rules: Rules | None = None, measure=vincenty, seq: str = "seq", x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """The kept points with part (0, 1, ... within a track), of parts with two points or more.

    points: keys (one track), seq (order), x, y, t (seconds or null). A track is
    one recording; it is folded by one task, tracks side by side.
    """
    rules = rules or Rules()
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(seq)
        cleaner = Cleaner(rules, measure)
        parts = [cleaner.take(a, b, None if pd.isna(c) else c) for a, b, c in zip(frame[x], frame[y], frame[t])]
        frame = frame.assign(part=parts)
        frame = frame[frame.part.notna()]
        sizes = frame.groupby("part")[seq].transform("size")
        return frame[sizes >= 2][[*keys, "part", seq, x, y, t]].astype({"part": "int32"})

    own = points.select(*keys, F.col(seq).cast("long").alias(seq), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), F.col(t).cast("double").alias(t))
    return own.groupBy(*keys).applyInPandas(fold, f"{kinds}, part int, {seq} long, {x} double, {y} double, {t} double")


def lines(kept: DataFrame, keys: list[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """A row a part: keys, part, geometry."""
    rows = kept.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"))
    return rows.select(*keys, "part", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geometry"))


def track_segments(kept: DataFrame, track: str, order: list[str], x: str = "x", y: str = "y", part: str | None = "part") -> DataFrame:
    """A row a segment between neighbouring points of a part: track, cx, cy, dx, dy."""
    keys = [track, part] if part else [track]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = kept.withColumns({"dx": F.lead(x).over(w), "dy": F.lead(y).over(w)}).filter("dx is not null")
    return rows.select(F.col(track).alias("track"), F.col(x).alias("cx"), F.col(y).alias("cy"), "dx", "dy")


def with_capsule(rows: DataFrame, r: float) -> DataFrame:
    """Add t0 and t1: the share of A to B (0 to 1) that lies at most r from the segment C to D; null for none.

    rows: ax, ay, bx, by, cx, cy, dx, dy. The set is convex, so it is one
    interval: the union of those inside the two discs and the strip between
    them. Each step is a column of its own, which keeps the generated code small.
    """
    c = F.col
    rows = rows.withColumns({"ux": c("bx") - c("ax"), "uy": c("by") - c("ay"), "vx": c("dx") - c("cx"), "vy": c("dy") - c("cy")})
    rows = rows.withColumns({"uu": c("ux") * c("ux") + c("uy") * c("uy"), "vv": c("vx") * c("vx") + c("vy") * c("vy")})

    def disc(rows: DataFrame, px: str, py: str, to: str) -> DataFrame:
        rows = rows.withColumns({"wx": c("ax") - c(px), "wy": c("ay") - c(py)})
        rows = rows.withColumns({"half": c("wx") * c("ux") + c("wy") * c("uy"), "out": c("wx") * c("wx") + c("wy") * c("wy") - r * r})
        rows = rows.withColumn("root", c("half") * c("half") - c("uu") * c("out"))
        rows = rows.withColumn("root", F.when(c("root") >= 0, F.sqrt(F.greatest(c("root"), F.lit(0.0)))))
        base = F.when(c("uu") > 0, c("uu"))
        # A to B that is no longer than a point is inside or not.
        lone = F.when((c("uu") == 0) & (c("out") <= 0), 1.0)
        return rows.withColumns({f"{to}0": F.coalesce((-c("half") - c("root")) / base, lone - 1), f"{to}1": F.coalesce((-c("half") + c("root")) / base, lone)})

    rows = disc(disc(rows, "cx", "cy", "p"), "dx", "dy", "q")
    long_ = F.when(c("vv") > 0, c("vv"))
    along = lambda x, y: ((c(x) - c("cx")) * c("vx") + (c(y) - c("cy")) * c("vy")) / long_
    aside = lambda x, y: ((c(x) - c("cx")) * c("vy") - (c(y) - c("cy")) * c("vx")) / F.sqrt(long_)
    rows = rows.withColumns({"l0": along("ax", "ay"), "l1": along("bx", "by"), "s0": aside("ax", "ay"), "s1": aside("bx", "by")})

    def between(rows: DataFrame, p0: str, p1: str, low: float, high: float, to: str) -> DataFrame:
        """Shares t with low <= p0 + t (p1 - p0) <= high."""
        rows = rows.withColumn("step", c(p1) - c(p0))
        step = F.when(c("step") != 0, c("step"))
        rows = rows.withColumns({"one": (low - c(p0)) / step, "two": (high - c(p0)) / step, "flat": F.when((c("step") == 0) & c(p0).between(low, high), 1e18)})
        return rows.withColumns({f"{to}0": F.coalesce(F.least(c("one"), c("two")), -c("flat")), f"{to}1": F.coalesce(F.greatest(c("one"), c("two")), c("flat"))})

    rows = between(between(rows, "l0", "l1", 0.0, 1.0, "g"), "s0", "s1", -r, r, "h")
    strip = c("g0").isNotNull() & c("h0").isNotNull()
    rows = rows.withColumns({"k0": F.when(strip, F.greatest("g0", "h0")), "k1": F.when(strip, F.least("g1", "h1"))})
    # Of each part only what lies within A to B.
    held = {f"{x}{i}": F.when((c(f"{x}1") >= 0) & (c(f"{x}0") <= 1) & (c(f"{x}0") <= c(f"{x}1")), F.greatest(c(f"{x}0"), F.lit(0.0)) if i == 0 else F.least(c(f"{x}1"), F.lit(1.0))) for x in "pqk" for i in (0, 1)}
    rows = rows.withColumns(held).withColumns({"t0": F.least("p0", "q0", "k0"), "t1": F.greatest("p1", "q1", "k1")})
    return rows.drop("ux", "uy", "vx", "vy", "uu", "vv", "wx", "wy", "half", "out", "root", "step", "one", "two", "flat", *[f"{x}{i}" for x in "pqklsgh" for i in (0, 1)])


def _union_length(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the length of the union of the intervals t0..t1 on segments (seg, seg_m) : covered."""
    w = Window.partitionBy(*keys, "seg").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.max("t1").over(w), F.lit(0.0))
    new = rows.withColumn("add", F.coalesce(F.greatest(F.lit(0.0), F.col("t1") - F.greatest(F.col("t0"), ahead)), F.lit(0.0)) * F.col("seg_m"))
    new = new.withColumn("add", F.when(F.col("t1").isNotNull(), F.col("add")).otherwise(0.0))
    return new.groupBy(*keys).agg(F.sum("add").alias("covered"))


def overlap(route_segments: DataFrame, segments: DataFrame, radius: float = 30.0) -> DataFrame:
    """Per route how much of it lies at most radius from the tracks.

    route_segments: algorithm, od_id, seg (id within the route), ax, ay, bx, by,
    each street once. segments: track, cx, cy, dx, dy. Returns algorithm, od_id,
    nearest_pct, ride (the track with the largest share, the smallest name of
    several), any_pct. Segments meet by grid cells; intervals are joined by a
    running maximum.
    """
    from trailforge.operators.spatial import _gridded

    size = max(2 * radius, 1.0)
    a = route_segments.withColumn("seg_m", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
    totals = a.groupBy("algorithm", "od_id").agg(F.sum("seg_m").alias("total"))
    left = _gridded(a.withColumns({"sx": F.col("ax"), "sy": F.col("ay"), "ex": F.col("bx"), "ey": F.col("by")}), radius, size).drop("sx", "sy", "ex", "ey").withColumnsRenamed({"cx": "gx", "cy": "gy"})
    named = segments.select("track", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    right = _gridded(named, 0.0, size).withColumnsRenamed({"cx": "gx", "cy": "gy", "sx": "cx", "sy": "cy", "ex": "dx", "ey": "dy"})
    met = left.join(right, ["gx", "gy"]).drop("gx", "gy").distinct()
    # No filter on what with_capsule() adds: the optimizer would push it through all its steps. Rows without an interval add nothing.
    met = with_capsule(met, radius).select("algorithm", "od_id", "seg", "seg_m", "track", "t0", "t1")
    by_track = _union_length(met, ["algorithm", "od_id", "track"])
    any_ = _union_length(met, ["algorithm", "od_id"]).withColumnRenamed("covered", "any_m")
    tracks = segments.select("track").distinct()
    first = tracks.agg(F.min("track").alias("first"))
    best = by_track.groupBy("algorithm", "od_id").agg(F.max(F.struct("covered")).alias("m"))
    ride = by_track.join(best, ["algorithm", "od_id"]).filter(F.col("covered") == F.col("m.covered")).groupBy("algorithm", "od_id").agg(F.min("track").alias("ride"), F.max("covered").alias("covered"))
    out = totals.join(ride, ["algorithm", "od_id"], "left").join(any_, ["algorithm", "od_id"], "left").crossJoin(F.broadcast(first))
    share = lambda c: 100 * F.coalesce(F.col(c), F.lit(0.0)) / F.when(F.col("total") > 0, F.col("total"))
    return out.select("algorithm", "od_id", share("covered").alias("nearest_pct"), F.when(F.coalesce("covered", F.lit(0.0)) > 0, F.col("ride")).otherwise(F.col("first")).alias("ride"), share("any_m").alias("any_pct"))


def overlap_table(rows: DataFrame) -> DataFrame:
    """Per algorithm the mean shares, whole percents, best first."""
    return rows.groupBy("algorithm").agg(F.bround(F.avg("nearest_pct"), 0).alias("nearest_pct"), F.bround(F.avg("any_pct"), 0).alias("any_pct")).orderBy(F.col("nearest_pct").desc(), "algorithm")
