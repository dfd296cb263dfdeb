"""Tables that describe a network, and payloads for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.functions import geometry as G
from trailforge.functions.tags import has_any
from trailforge.operators.costs import filled

#: What the display codes go by.
BIG_ROADS = ("primary", "secondary", "trunk", "primary_link", "secondary_link")
HOME_ROADS = ("residential", "living_street")
WALKS = ("footway", "pedestrian", "steps", "path")
YARDS = ("service", "track")
HARD = ("asphalt", "concrete", "concrete:plates")
SOFT = ("gravel", "fine_gravel", "ground", "dirt", "unpaved", "compacted", "sand", "grass", "earth", "mud", "pebblestone")
NO_LANE = ("", "no", "none", "separate")


def network_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), (F.sum("length_m") / 1000).alias("km"))


def token_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each token of a tag occurs."""
    return df.select(F.explode(F.split(column, ";")).alias("token")).groupBy("token").count().withColumnRenamed("count", "n")


def data_dictionary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: column, kind (number, boolean or category), least, most, tokens (commonest first), has_null."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    out = None
    for c in columns:
        number, boolean = kinds[c] in ("double", "float", "int", "bigint", "smallint"), kinds[c] == "boolean"
        null = F.coalesce(F.max(F.col(c).isNull()), F.lit(False))
        if number:
            row = df.agg(F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.lit(None).cast("string").alias("tokens"), null.alias("has_null"))
        elif boolean:
            row = df.agg(F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.lit("true / false").alias("tokens"), null.alias("has_null"))
        else:
            order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "token")))
            tokens = token_counts(df, c).agg(F.array_join(F.transform(order, lambda x: x["token"]), ", ").alias("tokens"))
            row = tokens.crossJoin(df.agg(null.alias("has_null"))).select(F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), "tokens", "has_null")
        row = row.select(F.lit(c).alias("column"), F.lit("number" if number else "boolean" if boolean else "category").alias("kind"), "least", "most", "tokens", "has_null")
        out = row if out is None else out.unionByName(row)
    return out


def category_counts(points: DataFrame, categories: DataFrame) -> DataFrame:
    """Points of each category (category, description), those without any included: category, description, n."""
    counts = points.groupBy(F.col("type").alias("category")).count()
    return F.broadcast(categories).join(counts, "category", "left").select("category", "description", F.coalesce("count", F.lit(0)).alias("n"))


def example_rows(df: DataFrame, columns: list[str], id_col: str = "edge_id") -> DataFrame:
    """Rows that together show every column that any row fills: nth, id.

    Each next row fills the most columns not shown yet, of several the one with
    the most filled in all, then the smallest id. Rows are told apart by which
    columns they fill alone, 2 to the number of columns kinds at most.
    """
    mask = sum((F.col(c).isNotNull().cast("long") * (1 << k) for k, c in enumerate(columns)), F.lit(0).cast("long"))
    kinds = [(r["mask"], r["id"]) for r in df.groupBy(mask.alias("mask")).agg(F.min(id_col).alias("id")).collect()]
    left, chosen = 0, []
    for m, _ in kinds:
        left |= m
    while left:
        _, i, m = min((-(100 * (m & left).bit_count() + m.bit_count()), i, m) for m, i in kinds)
        chosen.append(i)
        left &= ~m
    return df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(chosen)], f"nth long, {id_col} long")


def has_lane(cycleway: str) -> Column:
    """Whether a cycleway tag names anything but the absence of one."""
    return F.coalesce(F.size(F.array_except(F.split(cycleway, ";"), F.array(*[F.lit(x) for x in NO_LANE]))) > 0, F.lit(False))


def map_codes(edges: DataFrame) -> DataFrame:
    """edge_id and the display codes: popularity (-1: unknown), bike, road, surface, lit, speed; edges with popularity."""
    bike = has_any("highway", "cycleway") | has_lane("cycleway")
    road = F.when(bike, 0).when(has_any("highway", BIG_ROADS), 1).when(has_any("highway", HOME_ROADS), 2).when(has_any("highway", WALKS), 3).when(has_any("highway", YARDS), 4).otherwise(5)
    surface = F.when(F.col("surface").isNull(), 3).when(has_any("surface", HARD), 0).when(has_any("surface", SOFT), 2).otherwise(1)
    lit = F.when(F.col("lit").isNull(), 2).when(has_any("lit", "no"), 0).otherwise(1)
    speed = F.when(F.col("maxspeed").isNull(), 3).when(F.col("maxspeed") <= 30, 0).when(F.col("maxspeed") <= 50, 1).otherwise(2)
    return edges.select("edge_id", F.coalesce(F.bround("popularity").cast("int"), F.lit(-1)).alias("popularity"), bike.cast("int").alias("bike"), road.alias("road"), surface.alias("surface"), lit.alias("lit"), speed.alias("speed"))


def feature_domains(df: DataFrame, numbers: list[str], categories: list[str], id_col: str = "edge_id") -> DataFrame:
    """What a map's legend needs: feature, value (null for numbers), code (in the order of first appearance), least, most."""
    out = None
    for c in numbers:
        row = df.agg(F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")).select(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("code"), "least", "most")
        out = row if out is None else out.unionByName(row)
    for c in categories:
        firsts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.min(id_col).alias("i"))
        row = firsts.select(F.lit(c).alias("feature"), "value", (F.row_number().over(Window.orderBy("i")) - 1).cast("long").alias("code"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"))
        out = row if out is None else out.unionByName(row)
    return out


def dedupe_streets(edges: DataFrame) -> DataFrame:
    """Of the edges between the same two nodes, either way, that with the smallest id."""
    first = edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("edge_id").alias("edge_id"))
    return edges.join(first.select("edge_id"), "edge_id", "left_semi")


def layer(edges: DataFrame, mask: Column) -> DataFrame:
    """The edges of a mask; null counts as false."""
    return edges.filter(F.coalesce(mask, F.lit(False)))


def payload(edges: DataFrame, digits: int = 5) -> DataFrame:
    """A row an edge: edge_id and json, its line with rounded coordinates and its codes; "<" is escaped."""
    line = F.col("geometry") if "geometry" in edges.columns else F.array(G.point("x0", "y0"), G.point("x1", "y1"))
    codes = map_codes(edges)
    both = edges.select("edge_id", G.rounded(line, digits).alias("line")).join(codes, "edge_id")
    values = F.array(*[F.col(c) for c in ("popularity", "bike", "road", "surface", "lit", "speed")])
    text = F.to_json(F.struct(F.transform("line", lambda p: F.array(p["y"], p["x"])).alias("line"), values.alias("codes")))
    return both.select("edge_id", F.replace(text, F.lit("<"), F.lit("\\u003c")).alias("json"))


def simplify(tolerance: float = 6.0):
    """A pandas UDF: lines (arrays of x, y) by Douglas and Peucker's method."""
    import pandas as pd

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(lines: pd.Series) -> pd.Series:
        from trailforge.functions.lines import simplified

        return lines.map(lambda p: None if p is None else [{"x": a, "y": b} for a, b in simplified([(q["x"], q["y"]) for q in p], tolerance)])

    return run


def completed(edges: DataFrame, own: DataFrame, base: list[str], id_col: str = "edge_id") -> DataFrame:
    """A caller's features (id and columns) with the base columns of the edges that it lacks; its own columns go first where both have one."""
    more = [c for c in own.columns if c != id_col]
    left = edges.select(id_col, *[c for c in base if c not in more and c != id_col])
    return left.join(own, id_col, "left").select(id_col, *[c for c in base if c not in more and c != id_col], *more)


def layers(edges: DataFrame, masks: dict[str, tuple[Column, str]], radius: float = 3.0) -> DataFrame:
    """A row a layer: layer, colour, radius, count and json, its edges' ids ascending; masks: name to (mask, colour)."""
    rows = F.explode(F.filter(F.array(*[F.when(F.coalesce(mask, F.lit(False)), F.struct(F.lit(name).alias("layer"), F.lit(colour).alias("colour"))) for name, (mask, colour) in masks.items()]), lambda x: x.isNotNull()))
    met = edges.select("edge_id", rows.alias("l")).groupBy("l.layer").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list("edge_id"))).alias("json"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.lit(colour).alias("colour")) for name, (_, colour) in masks.items()]))
    every = edges.sparkSession.range(1).select(named.alias("l")).select("l.*")
    return every.join(met, "layer", "left").select("layer", "colour", F.lit(float(radius)).alias("radius"), F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("json", F.lit("[]")).alias("json"))


def explorer(edges: DataFrame, routes: DataFrame, masks: dict[str, tuple[Column, str]], numbers: list[str], categories: list[str]) -> DataFrame:
    """All that a map shows, a row a part: section (edges, routes, layers, domains), name and json.

    ValueError if a route passes an edge that the network lacks.
    """
    steps = routes.select("algorithm", "od_id", F.posexplode("edge_route").alias("pos", "s")).select("algorithm", "od_id", "pos", "s.edge_id")
    if not steps.join(edges.select("edge_id"), "edge_id", "left_anti").isEmpty():
        raise ValueError("a route leaves the network")
    escaped = lambda c: F.replace(c, F.lit("<"), F.lit("\\u003c"))
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), escaped(value).alias("json"))
    lines = routes.withColumn("edges", F.transform("edge_route", lambda e: e["edge_id"]))
    out = part(payload(edges), "edges", F.col("edge_id"), F.col("json"))
    out = out.unionByName(part(lines, "routes", F.concat_ws(":", "algorithm", "od_id"), F.to_json(F.struct("algorithm", "od_id", "edges", "route_length_m"))))
    shown = layers(edges, masks)
    out = out.unionByName(part(shown, "layers", F.col("layer"), F.to_json(F.struct("layer", "colour", "radius", "count", F.from_json("json", "array<long>").alias("edges")))))
    domains = feature_domains(edges, numbers, categories).groupBy("feature").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("code", "value")))), lambda x: x["value"]).alias("values"))
    return out.unionByName(part(domains, "domains", F.col("feature"), F.to_json(F.struct("feature", "least", "most", "values"))))


def pair_labels(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where to write a pair's label: od_id, label (its last two signs), x and y of the middle of its route."""
    steps = routes.select("od_id", F.posexplode("edge_route").alias("pos", "s")).select("od_id", "pos", "s.edge_id")
    line = F.col("geometry") if "geometry" in edges.columns else F.array(G.point("x0", "y0"), G.point("x1", "y1"))
    own = steps.join(edges.select("edge_id", line.alias("line")), "edge_id").withColumn("m", G.polyline_length("line"))
    w = Window.partitionBy("od_id")
    own = own.withColumns({"done": F.coalesce(F.sum("m").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "half": F.sum("m").over(w) / 2})
    at = own.filter(F.col("done") + F.col("m") >= F.col("half")).groupBy("od_id").agg(F.min(F.struct("pos", "line", "m", "done", "half")).alias("b"))
    share = F.when(F.col("b.m") > 0, (F.col("b.half") - F.col("b.done")) / F.col("b.m")).otherwise(0.0)
    return at.withColumn("p", G.interpolate(F.col("b.line"), share)).select("od_id", F.right("od_id", F.lit(2)).alias("label"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
