"""Spatial joins by a grid: rows meet in cells, then by their exact distance.

A segment goes to the cells that its box, grown by the radius, touches; long
segments are cut first, so no row has many cells. Each point goes to one cell.
The join is an equi-join on the cell, so it is shuffled like any other and never
compares all with all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.functions import geometry as G
from trailforge.operators.network import endpoints

#: Cells along a piece of a segment at most.
MOST_CELLS = 50


def segments(edges: DataFrame, id_col: str = "edge_id") -> DataFrame:
    """A row a segment: id, sx, sy, ex, ey."""
    if "geometry" not in edges.columns:
        return edges.select(id_col, F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.col("x1").alias("ex"), F.col("y1").alias("ey"))
    n = F.size("geometry")
    pairs = F.arrays_zip(F.slice("geometry", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("geometry", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    rows = edges.filter(F.size("geometry") > 1).select(id_col, F.explode(pairs).alias("p"))
    return rows.select(id_col, F.col("p.a.x").alias("sx"), F.col("p.a.y").alias("sy"), F.col("p.b.x").alias("ex"), F.col("p.b.y").alias("ey"))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _gridded(pieces: DataFrame, radius: float, size: float) -> DataFrame:
    """Segments (sx, sy, ex, ey) by the cells that they may reach: cx, cy; px0.. are a cut piece's ends for the box only."""
    long_ = F.greatest(F.abs(F.col("ex") - F.col("sx")), F.abs(F.col("ey") - F.col("sy")))
    n = F.greatest(F.ceil(long_ / (size * MOST_CELLS)), F.lit(1)).cast("int")
    cut = pieces.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("__n")
    x0, x1 = at("sx", "ex", F.col("__k") - 1), at("sx", "ex", F.col("__k"))
    y0, y1 = at("sy", "ey", F.col("__k") - 1), at("sy", "ey", F.col("__k"))
    cells = lambda a, b: F.sequence(_cell(F.least(a, b) - radius, size), _cell(F.greatest(a, b) + radius, size))
    return cut.withColumn("cx", F.explode(cells(x0, x1))).withColumn("cy", F.explode(cells(y0, y1))).drop("__n", "__k")


def near_pairs(edges: DataFrame, points: DataFrame, radius: float, edge_id: str = "edge_id", point_id: str = "point_id") -> DataFrame:
    """(edge, point, distance) of all edges and points at most radius apart, each pair once."""
    if not math.isfinite(radius) or radius < 0:
        raise ValueError("a radius is finite and 0 or more")
    size = max(radius, 1.0)
    left = _gridded(segments(edges, edge_id), radius, size)
    right = points.select(point_id, F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": _cell(F.col("px"), size), "cy": _cell(F.col("py"), size)})
    d = G.point_segment(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    met = left.join(right, ["cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= radius)
    return met.groupBy(edge_id, point_id).agg(F.min("distance").alias("distance"))


def within_radius(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(edge_id, near): whether any point lies at most radius from the edge."""
    near = near_pairs(edges, points, radius).select("edge_id").distinct().withColumn("__near", F.lit(True))
    return edges.select("edge_id").join(near, "edge_id", "left").select("edge_id", F.coalesce("__near", F.lit(False)).alias("near"))


def points_near_roads(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The points with an edge at most radius away, with the nearest edge (smallest id of several) and its distance."""
    best = near_pairs(edges, points, radius).groupBy("point_id").agg(F.min(F.struct("distance", "edge_id")).alias("b"))
    return points.join(best.select("point_id", F.col("b.edge_id").alias("edge_id"), F.col("b.distance").alias("distance")), "point_id")


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """(point_id, neighbours): how many points lie at most radius away, itself included."""
    size = max(radius, 1.0)
    around = points.withColumns({"gx": _cell(F.col("x"), size), "gy": _cell(F.col("y"), size)})
    span = F.sequence(F.lit(-1), F.lit(1))
    left = around.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select("point_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    right = around.select(F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy")
    met = left.join(right, ["gx", "gy"]).filter(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius)
    return met.groupBy("point_id").agg(F.count(F.lit(1)).alias("neighbours"))


def focus_point(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The point for a close-up: among those with an edge within radius the one with the fewest points within two radii; the smallest id of several."""
    if radius <= 0:
        raise ValueError("a close-up needs a radius over 0")
    close = points_near_roads(edges, points, radius).select("point_id", "distance")
    counted = close.join(neighbours(points, 2 * radius), "point_id")
    return counted.orderBy("neighbours", "point_id").limit(1)


def nearby(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The close-up's edges: edge_id and distance of those at most radius from the focus point, with its point_id."""
    chosen = points.join(focus_point(edges, points, radius).select("point_id"), "point_id", "left_semi")
    return near_pairs(edges, chosen, radius).select("point_id", "edge_id", "distance")


def snap(points: DataFrame, edges: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """Each point's nearest node that an edge has (smallest id of several), at most so far away: point_id, node, distance.

    Nodes lie in cells of that side; points look into their own and the eight
    around it.
    """
    size = max(most, 1.0)
    used = nodes.join(endpoints(edges), "node", "left_semi").select("node", "x", "y", _cell(F.col("x"), size).alias("gx"), _cell(F.col("y"), size).alias("gy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    asked = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    asked = asked.select("point_id", "px", "py", (_cell(F.col("px"), size) + F.col("dx")).alias("gx"), (_cell(F.col("py"), size) + F.col("dy")).alias("gy"))
    near = used.join(asked, ["gx", "gy"])
    near = near.withColumn("distance", G.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).filter(F.col("distance") <= most)
    best = near.groupBy("point_id").agg(F.min(F.struct("distance", "node")).alias("b"))
    return best.select("point_id", F.col("b.node").alias("node"), F.col("b.distance").alias("distance"))


def snap_pair(points: DataFrame, edges: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """snap() for two points; ValueError if one has no node or both have the same."""
    rows = snap(points, edges, nodes, most).collect()
    if len(rows) < points.count():
        raise ValueError("a point lies outside the network")
    if len({r["node"] for r in rows}) < len(rows):
        raise ValueError("both points have the same node")
    return points.sparkSession.createDataFrame(rows)


def network_bbox(edges: DataFrame, margin: float = 0.0) -> DataFrame:
    """xmin, ymin, xmax, ymax of all edges, widened by a margin."""
    s = segments(edges)
    return s.agg(
        (F.min(F.least("sx", "ex")) - margin).alias("xmin"),
        (F.min(F.least("sy", "ey")) - margin).alias("ymin"),
        (F.max(F.greatest("sx", "ex")) + margin).alias("xmax"),
        (F.max(F.greatest("sy", "ey")) + margin).alias("ymax"),
    )


def bbox_slice(edges: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Edges whose box meets a window."""
    if "geometry" in edges.columns:
        return edges.filter(G.boxes_meet(G.bbox("geometry"), xmin, ymin, xmax, ymax))
    box = {"xmin": F.least("x0", "x1"), "ymin": F.least("y0", "y1"), "xmax": F.greatest("x0", "x1"), "ymax": F.greatest("y0", "y1")}
    return edges.filter(G.boxes_meet(box, xmin, ymin, xmax, ymax))


def corridor(lon0: Column, lat0: Column, lon1: Column, lat1: Column, margin: float) -> dict[str, Column]:
    """The box of two projected points and a margin."""
    return {"xmin": F.least(lon0, lon1) - margin, "ymin": F.least(lat0, lat1) - margin, "xmax": F.greatest(lon0, lon1) + margin, "ymax": F.greatest(lat0, lat1) + margin}
