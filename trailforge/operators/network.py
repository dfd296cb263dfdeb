"""Road networks as relations: nodes (node, x, y) and directed edges with the key (u, v, key) and the id edge_id."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.functions import geometry as G
from trailforge.functions import tags
from trailforge.operators.blocks import LEAST, Packed, blocks
from trailforge.operators.lineage import settled

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: The columns of an edge table, in order.
TEXTS = ("highway", "surface", "smoothness", "cycleway", "bicycle", "lit", "service", "access")
NUMBERS = ("maxspeed", "lanes", "width")
EDGES = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("u", "v", "key")],
        T.StructField("length_m", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in TEXTS],
        *[T.StructField(c, T.DoubleType()) for c in NUMBERS],
        T.StructField("oneway", T.BooleanType()),
        T.StructField("geometry", LINE),
    ]
)
NODES = T.StructType([T.StructField("node", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: Columns that an open network must not have.
TARGETS = frozenset({"trips", "has_observation", "popularity"})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point columns with NaN as null; a scan's first step."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def flag(values: Column) -> Column:
    """Whether any of an array of booleans is true; null and empty: false."""
    return F.coalesce(F.exists(values, lambda x: x), F.lit(False))


def make_nodes(spark: SparkSession, points: Mapping[int, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in points.items()], NODES)


def complete_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with defaults: key 0, a straight line from the nodes, its length, canonical tags, oneway false.

    raw needs u and v; a missing column counts as null throughout.
    """
    have = set(raw.columns)
    get = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    a = nodes.select(F.col("node").alias("__a"), F.col("x").alias("__ax"), F.col("y").alias("__ay"))
    b = nodes.select(F.col("node").alias("__b"), F.col("x").alias("__bx"), F.col("y").alias("__by"))
    joined = raw.join(a, F.col("u") == F.col("__a"), "left").join(b, F.col("v") == F.col("__b"), "left")
    own = F.col("geometry") if "geometry" in have else F.lit(None).cast(LINE)
    line = F.coalesce(F.when(F.size(own) >= 2, own), F.array(G.point("__ax", "__ay"), G.point("__bx", "__by")))
    out = joined.withColumn("__line", line)
    number = lambda c: F.when(~F.isnan(get(c, "double")), get(c, "double"))
    return out.select(
        F.col("u").cast("long").alias("u"),
        F.col("v").cast("long").alias("v"),
        F.coalesce(get("key", "long"), F.lit(0)).alias("key"),
        F.coalesce(number("length_m"), G.polyline_length("__line")).alias("length_m"),
        *[tags.tag_canonical(get(c, "string")).alias(c) for c in TEXTS],
        *[number(c).alias(c) for c in NUMBERS],
        F.coalesce(get("oneway", "boolean"), F.lit(False)).alias("oneway"),
        F.col("__line").alias("geometry"),
    )


def make_edges(spark: SparkSession, records: Iterable[Mapping], nodes: DataFrame) -> DataFrame:
    """Edges from dictionaries; see complete_edges."""
    rows = []
    for r in records:
        rows.append(tuple([tuple(map(float, p)) for p in r["geometry"]] if c == "geometry" and r.get(c) else r.get(c) for c in EDGES.names))
    return complete_edges(spark.createDataFrame(rows, EDGES), nodes)


def validate_edges(edges: DataFrame, exact: bool = True) -> DataFrame:
    """The edges as they are; ValueError if the schema or a rule is broken."""
    if leaked := TARGETS & set(edges.columns):
        raise ValueError(f"an open network has no columns {sorted(leaked)}")
    if exact:
        wanted, got = [(f.name, f.dataType) for f in EDGES.fields], [(f.name, f.dataType) for f in edges.schema.fields if f.name != "edge_id"]
        if [n for n, _ in wanted] != [n for n, _ in got]:
            raise ValueError(f"edge columns are {[n for n, _ in got]}")
        if wrong := [n for (n, a), (_, b) in zip(wanted, got) if a.simpleString() != b.simpleString()]:
            raise ValueError(f"edge columns of another type: {wrong}")
    bad = edges.filter(F.col("u").isNull() | F.col("v").isNull() | F.col("key").isNull() | ~F.coalesce(F.col("length_m") > 0, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("edges need u, v, key and a length over 0")
    if not edges.groupBy("u", "v", "key").count().filter("count > 1").isEmpty():
        raise ValueError("edge keys (u, v, key) repeat")
    return edges


def with_edge_id(edges: DataFrame) -> DataFrame:
    """Dense ids 0..n-1 in the order of (u, v, key), without one task that orders all.

    Ranges of the order are numbered in their partitions; the ranges' offsets
    are a sum over as many counts as there are partitions.
    """
    ranged = edges.repartitionByRange("u", "v", "key").sortWithinPartitions("u", "v", "key").withColumn("__m", F.monotonically_increasing_id())
    # Settled, as rows of a lost range might be numbered anew otherwise.
    ranged = settled(ranged.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)}))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    out = ranged.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    return out.withColumn("edge_id", F.col("__o") + F.col("__i")).drop("__m", "__p", "__i", "__q", "__o")


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that no node row has: node."""
    return endpoints(edges).join(nodes.select("node"), "node", "left_anti")


def endpoints(edges: DataFrame) -> DataFrame:
    """The nodes at the ends of edges, each once."""
    return edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends (ux, uy, vx, vy); ValueError if a node is missing."""
    lost = missing_nodes(edges, nodes)
    if rows := lost.orderBy("node").take(1):
        raise ValueError(f"{lost.count()} nodes are missing, such as {rows[0][0]}")
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return edges.join(a, "u").join(b, "v")


def edge_cost(edges: DataFrame, cost: str | Column | Callable[[DataFrame], Column] = "length_m") -> DataFrame:
    """Edges with a column cost: a column's name, an expression, or a function of the table that gives one."""
    value = F.col(cost) if isinstance(cost, str) else cost(edges) if callable(cost) and not isinstance(cost, Column) else cost
    return edges.withColumn("cost", value.cast("double"))


def bad_costs(priced: DataFrame) -> DataFrame:
    """Edges whose cost is missing, not finite or not over 0."""
    c = F.col("cost")
    return priced.filter(c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf")))


def checked_cost(edges: DataFrame, cost="length_m") -> DataFrame:
    priced = edge_cost(edges, cost)
    if rows := bad_costs(priced).select("edge_id", "cost").take(1):
        raise ValueError(f"costs must be finite and over 0; edge {rows[0][0]} has {rows[0][1]}")
    return priced


def degree(edges: DataFrame) -> DataFrame:
    """Per node out_degree and in_degree, parallel edges counted."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def successors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("u") == node).select(F.col("v").alias("node")).distinct()


def predecessors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("v") == node).select(F.col("u").alias("node")).distinct()


#: Arcs that a label passes between two looks at whether any label still moves.
HOPS = 4


def _spread(labels: DataFrame, arcs: DataFrame, rounds: int) -> DataFrame:
    """The least label that reaches each node along arcs (a to b), HOPS arcs a round."""
    for _ in range(rounds):
        new = labels.withColumn("old", F.col("label"))
        for _ in range(HOPS):
            sent = arcs.join(new, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
            new = new.join(sent, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), "old")
        new = settled(new)
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"the labels have not settled in {rounds} rounds")


def weak_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node of the weakly connected component, by alternating stars of minima."""
    links = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct()
    links = settled(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        new = settled(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        done = new.count() == links.count() and new.exceptAll(links).isEmpty()
        links = new
        if done:
            break
    else:
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    top = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return endpoints(edges).join(top, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Arcs (12 bytes each, and some 60 a node) that one task may hold at most; larger graphs go on by joins, with the same result.
SMALL = 20_000_000


def _held(arcs: DataFrame) -> Packed:
    """The arcs (a, b) in blocks that a task reads."""
    return blocks(arcs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("key"), F.lit(0).alias("edge_id"), F.lit(1.0).alias("cost")), LEAST)


def _strong(net: Packed):
    """Rows (node, component) of a whole graph, by one depth-first walk with its own stack."""
    start, to, _ = net.whole()
    n = net.n_nodes
    numbers = [memoryview(np.zeros(n, np.int64)) for _ in range(5)]
    found, low, at, walk, open_ = numbers
    label = np.full(n, -1, np.int64)
    least = memoryview(label)
    count, waiting = 0, 0
    for root in range(n):
        if found[root]:
            continue
        deep, walk[0] = 1, root
        count += 1
        found[root] = low[root] = count
        at[root] = start[root]
        open_[waiting] = root
        waiting += 1
        while deep:
            s = walk[deep - 1]
            k = at[s]
            if k == start[s + 1]:
                deep -= 1
                if deep and low[s] < low[walk[deep - 1]]:
                    low[walk[deep - 1]] = low[s]
                if low[s] == found[s]:
                    first = waiting - 1
                    while open_[first] != s:
                        first -= 1
                    members = open_[first:waiting]
                    name = min(members)
                    for x in members:
                        least[x] = name
                    waiting = first
                continue
            at[s] = k + 1
            t = to[k]
            if not found[t]:
                count += 1
                found[t] = low[t] = count
                at[t] = start[t]
                open_[waiting] = walk[deep] = t
                waiting += 1
                deep += 1
            elif least[t] < 0 and found[t] < low[s]:
                low[s] = found[t]
    for k in range(0, n, 100_000):
        yield pd.DataFrame({"node": net.nodes[k : k + 100_000], "component": net.nodes[label[k : k + 100_000]]})


def strong_components(edges: DataFrame, rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """(node, component): the least node of the strongly connected component.

    A graph of ``small`` arcs or less is walked by one task. In a larger one
    every node's colour is the least node that reaches it; a colour's component
    is what of it reaches back to that node. What is left is coloured anew.
    """
    arcs = settled(edges.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")).distinct())
    n = arcs.count()
    if 0 < n <= small:
        net = _held(arcs)
        return edges.sparkSession.range(0, 1, 1, 1).mapInPandas(lambda frames: (out for frame in frames for _ in frame.id for out in _strong(net)), "node long, component long")
    arcs = arcs.filter("a <> b")
    rest = settled(endpoints(edges))
    found = None
    while not rest.isEmpty():
        colour = _spread(rest.withColumn("label", F.col("node")), arcs, rounds)
        same = arcs.join(colour.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b").filter("ca = cb")
        # Back from each root within its colour.
        back = settled(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mark = colour.withColumn("root", F.col("label")).withColumn("label", F.when(F.col("node") == F.col("label"), 0).otherwise(1)).select("node", "label")
        reached = _spread(mark, back, rounds).filter("label = 0").select("node")
        part = settled(reached.join(colour, "node").select("node", F.col("label").alias("component")))
        found = part if found is None else found.unionByName(part)
        rest = settled(rest.join(part.select("node"), "node", "left_anti"))
        arcs = settled(arcs.join(rest.select(F.col("node").alias("a")), "a").join(rest.select(F.col("node").alias("b")), "b").select("a", "b"))
    return found if found is not None else rest.withColumn("component", F.col("node"))


def _hops(frames, net: Packed):
    for frame in frames:
        for source in frame.source:
            o = net.at(source)
            if o is None:
                continue
            start, to, _ = net.whole()
            reached = np.full(net.n_nodes, -1, np.int32)
            hops, front, k = memoryview(reached), [o], 0
            hops[o] = 0
            while front:
                new, k = [], k + 1
                for s in front:
                    for t in to[start[s] : start[s + 1]]:
                        if hops[t] < 0:
                            hops[t] = k
                            new.append(t)
                front = new
            at = np.flatnonzero(reached >= 0)
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                yield pd.DataFrame({"source": np.int64(source), "node": net.nodes[some], "hops": reached[some]})


def bfs_hops(edges: DataFrame, sources: DataFrame, most: int = 10_000, small: int = SMALL) -> DataFrame:
    """(source, node, hops): least numbers of edges from each source (column source).

    A graph of ``small`` arcs or less is read by all executors, which share the
    sources; in a larger one the frontiers meet the arcs by joins.
    """
    arcs = settled(edges.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")).distinct())
    if 0 < arcs.count() <= small:
        spark, net = edges.sparkSession, _held(arcs)
        asked = sources.select(F.col("source").cast("long").alias("source")).distinct()
        n = max(1, min(asked.count(), 4 * spark.sparkContext.defaultParallelism))
        return asked.repartition(n).mapInPandas(lambda frames: _hops(frames, net), "source long, node long, hops int")
    arcs = arcs.filter("a <> b")
    seen = settled(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).join(endpoints(edges), "node", "left_semi").distinct())
    front = seen
    for k in range(1, most + 1):
        step = front.join(arcs, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        front = settled(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            return seen.select("source", "node", "hops")
        seen = seen.unionByName(front)
        if k % 20 == 0:
            seen = settled(seen)
    raise RuntimeError(f"a node lies over {most} edges away")
