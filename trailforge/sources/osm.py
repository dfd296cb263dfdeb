"""Places from map data in JSON: queries, downloads through several servers, classification."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions import geometry as G

ELEMENTS = "elements ARRAY<STRUCT<type: STRING, id: LONG, lat: DOUBLE, lon: DOUBLE, center: STRUCT<lat: DOUBLE, lon: DOUBLE>, tags: MAP<STRING, STRING>>>"
#: Categories of places by the tags that make them.
CATEGORIES: dict[str, dict[str, list[str]]] = {
    "gates": {"barrier": ["gate", "lift_gate", "swing_gate", "chain"]},
    "bollards": {"barrier": ["cycle_barrier", "bollard", "stile", "kissing_gate", "turnstile"]},
    "signals": {"highway": ["traffic_signals"]},
    "crossings": {"highway": ["crossing"]},
    "level_crossings": {"railway": ["level_crossing", "crossing"]},
    "stops": {"highway": ["bus_stop"], "public_transport": ["platform"]},
    "drinking_water": {"amenity": ["drinking_water"]},
    "repair": {"amenity": ["bicycle_repair_station"], "service:bicycle:pump": ["yes"]},
    "bicycle_parking": {"amenity": ["bicycle_parking"]},
}
#: Fixed value: seconds that a query may take.
QUERY_SECONDS = 180
#: The box (west, south, east, north) outside which servers of one region are not asked.
REGION = (-25.0, 35.0, 45.0, 72.0)


def query(bounds: tuple[float, float, float, float], categories: Mapping = CATEGORIES) -> str:
    """A query for all places of the categories in a box (west, south, east, north)."""
    west, south, east, north = bounds
    wanted = {f"nwr[{json.dumps(k)}={json.dumps(v)}]({south},{west},{north},{east});" for tags in categories.values() for k, values in tags.items() for v in values}
    return f"[out:json][timeout:{QUERY_SECONDS}];({''.join(sorted(wanted))});out center;"


def servers_for(servers: Sequence[tuple[str, bool]], bounds: tuple[float, float, float, float] | None) -> list[str]:
    """The servers (address, regional) that know a box; regional ones only inside REGION."""
    inside = bounds is not None and REGION[0] <= bounds[0] <= bounds[2] <= REGION[2] and REGION[1] <= bounds[1] <= bounds[3] <= REGION[3]
    return [address for address, regional in servers if inside or not regional]


def flaw(answer: Mapping, regional: bool) -> str | None:
    """What makes an answer unfit, or None: a remark, no elements at all, or none from a regional server."""
    found = answer.get("elements")
    faults = {
        str(answer.get("remark")): "remark" in answer,
        "the answer has no elements": found is None,
        "a regional server had nothing": regional and found == [],
    }
    return next((text for text, is_so in faults.items() if is_so), None)


def download(servers: Sequence[tuple[str, bool]], bounds, get: Callable[[str, str], Mapping], categories: Mapping = CATEGORIES) -> tuple[Mapping, str]:
    """The first fit answer and its server; get(address, query) returns parsed JSON or raises OSError or ValueError."""
    text, regional, said = query(bounds, categories), dict(servers), {}
    for address in servers_for(servers, bounds):
        try:
            answer = get(address, text)
        except (OSError, ValueError) as error:
            said[address] = str(error)
            continue
        fault = flaw(answer, regional[address])
        if fault is None:
            return answer, address
        said[address] = fault
    raise ConnectionError("no server answered; " + "; ".join(f"{a}: {x}" for a, x in said.items()))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The elements of answers in files."""
    return spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def classify(elements: DataFrame, categories: Mapping = CATEGORIES) -> DataFrame:
    """A row a place and category: point_id, type, name, tags, lon, lat.

    A place can have several categories, each once. ValueError if a place that
    has one lacks coordinates.
    """
    spark = elements.sparkSession
    table = spark.createDataFrame([(name, k, v) for name, tags in categories.items() for k, values in tags.items() for v in values], "category string, tag string, value string")
    own = elements.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("point_id"), F.coalesce(F.when(F.col("type") == "node", F.struct("lat", "lon")), F.struct(F.col("center.lat").alias("lat"), F.col("center.lon").alias("lon"))).alias("at"), "tags")
    flat = own.select("point_id", F.explode("tags").alias("tag", "value")).join(F.broadcast(table), ["tag", "value"]).select("point_id", "category").distinct()
    # Of elements with one id the first by its coordinates stays.
    firsts = own.groupBy("point_id").agg(F.min(F.struct(F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), F.to_json("tags").alias("json"))).alias("m"))
    out = flat.join(firsts, "point_id").withColumn("tags", F.from_json("m.json", "map<string,string>"))
    out = out.select("point_id", F.col("category").alias("type"), F.try_element_at("tags", F.lit("name")).alias("name"), "tags", F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"))
    return out


def checked(places: DataFrame) -> DataFrame:
    """classify()'s rows; ValueError if one lacks coordinates."""
    if not places.filter("lon IS NULL OR lat IS NULL").isEmpty():
        raise ValueError("a place has no coordinates")
    return places


#: Tags of a way that an edge keeps.
WAY_TAGS = ("highway", "surface", "smoothness", "cycleway", "bicycle", "lit", "service", "access", "maxspeed", "lanes", "width")
ROADS = "elements ARRAY<STRUCT<type: STRING, id: LONG, lat: DOUBLE, lon: DOUBLE, nodes: ARRAY<LONG>, tags: MAP<STRING, STRING>>>"


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """The nodes and ways of answers in files, each once."""
    return spark.read.schema(ROADS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])


def road_graph(elements: DataFrame, simplify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges for network.complete_edges, nodes) of read_roads()'s ways that have a highway tag.

    Nodes are projected by the zone of their mean longitude. A way is cut
    where ways meet, end or cross themselves (simplify) or at every node. Ways
    that are not oneway give both directions; "-1" turns a way round. Parallel
    edges are numbered by key, in the order of way and place. Ways' nodes
    without coordinates are left out.
    """
    own = elements.filter((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    mean = own.agg(F.avg("lon")).first()[0]
    x, y = G.utm(F.col("lon"), F.col("lat"), F.lit(int(((mean or 0.0) + 180) // 6) + 1))
    places = own.select(F.col("id").alias("node"), x.alias("x"), y.alias("y"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    ways = elements.filter((F.col("type") == "way") & tag("highway").isNotNull())
    back, single = tag("oneway") == "-1", tag("oneway").isin("yes", "true", "1", "-1") | (tag("junction") == "roundabout")
    ways = ways.select(F.col("id").alias("way"), F.when(F.coalesce(back, F.lit(False)), F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"), F.coalesce(single, F.lit(False)).alias("oneway"), F.struct(*[tag(k).alias(k) for k in WAY_TAGS]).alias("t"))
    steps = ways.select("way", F.posexplode("nodes").alias("pos", "node")).join(places, "node")
    uses = steps.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("met"))
    w = Window.partitionBy("way").orderBy("pos")  # a way has 2,000 nodes at most
    steps = steps.join(uses, "node").withColumn("end", F.col("met") | F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull() | F.lit(not simplify))
    steps = steps.withColumn("part", F.sum(F.col("end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    point = F.struct("pos", "node", "x", "y")
    # An end belongs to the piece before it and to the one after it.
    both = steps.withColumn("part", F.coalesce("part", F.lit(0))).select("way", point.alias("p"), F.explode(F.when(F.col("end"), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))).alias("part"))
    pieces = both.groupBy("way", "part").agg(F.array_sort(F.collect_list("p")).alias("p")).filter(F.size("p") > 1).join(ways.select("way", "oneway", "t"), "way")
    line = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    there = pieces.select("way", "part", F.lit(0).alias("back"), F.element_at("p", 1)["node"].alias("u"), F.element_at("p", -1)["node"].alias("v"), line.alias("geometry"), "oneway", "t.*")
    again = there.filter(~F.col("oneway")).withColumns({"back": F.lit(1), "u": F.col("v"), "v": F.col("u"), "geometry": F.reverse("geometry")})
    edges = there.unionByName(again).withColumn("key", F.row_number().over(Window.partitionBy("u", "v").orderBy("way", "part", "back")).cast("long") - 1)
    number = lambda k: F.regexp_extract(k, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double").alias(k)
    edges = edges.select("u", "v", "key", *WAY_TAGS[:8], *[number(k) for k in WAY_TAGS[8:]], "oneway", "geometry")
    used = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return edges, places.join(used, "node", "left_semi")
