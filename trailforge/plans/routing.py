"""Queries on graphs, turns and routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailforge.functions import geometry as G
from trailforge.operators import costs, network, scoring, search, turns
from trailforge.plans.catalog import query
from trailforge.plans.relations import WEIGHTS, _rounded, labelled, walks
from trailforge.plans.testnet import Net, with_net

ANGLE = "((((degrees(atan2(b.x1 - b.x0, b.y1 - b.y0)) - degrees(atan2(a.x1 - a.x0, a.y1 - a.y0)) + 180) % 360) + 360) % 360) - 180"
#: Angles as they are reckoned in Spark: bearings first, each from 0 to 360.
BEAR = """, eb AS (SELECT *, ((degrees(atan2(x1 - x0, y1 - y0)) % 360) + 360) % 360 AS bearing FROM net_edges),
tp AS (SELECT a.edge_id AS from_edge, b.edge_id AS to_edge, (((b.bearing - a.bearing + 180) % 360) + 360) % 360 - 180 AS angle, a.u AS fu, b.v AS tv, a.length_m AS fl, b.length_m AS tl FROM eb a JOIN eb b ON a.v = b.u),
tk AS (SELECT *, CASE WHEN abs(angle) <= 25 THEN 'straight' WHEN abs(angle) <= 55 THEN 'slight' WHEN abs(angle) >= 150 THEN 'u_turn' WHEN angle > 0 THEN 'right' ELSE 'left' END AS kind FROM tp)
"""
MODEL = turns.TurnModel(straight=0.0, slight=5.0, right=10.0, left=25.0, u_turn=200.0)
_PENALTY = "CAST(CASE kind WHEN 'straight' THEN 0 WHEN 'slight' THEN 5 WHEN 'right' THEN 10 WHEN 'left' THEN 25 ELSE 200 END AS DOUBLE)"


@query(with_net("SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT u AS node, 1 AS o, 0 AS i FROM net_edges UNION ALL SELECT v, 0, 1 FROM net_edges) x GROUP BY node"))
def q_degree(spark, sf_dir):
    return network.degree(Net(spark, sf_dir).edges)


@query(with_net("SELECT DISTINCT node FROM (SELECT u AS node FROM net_edges UNION ALL SELECT v FROM net_edges) x"))
def q_endpoint_nodes(spark, sf_dir):
    return network.endpoints(Net(spark, sf_dir).edges)


def _thin(net):
    """Every third street, so that there are several components."""
    return net.edges.filter("(u + v) % 3 <> 0")


_THIN = ", thin AS (SELECT * FROM net_edges WHERE (u + v) % 3 <> 0)"


@query(with_net(_THIN + """, link AS (SELECT u AS a, v AS b FROM thin UNION SELECT v, u FROM thin),
reach(node, component) USING KEY (node) AS (SELECT a, a FROM link GROUP BY a UNION SELECT x.b, min(x.c) FROM (SELECT l.b, r.component AS c FROM reach r JOIN link l ON l.a = r.node) x JOIN recurring.reach o ON o.node = x.b WHERE x.c < o.component GROUP BY x.b)
SELECT node, component FROM reach"""))
def q_weak_components(spark, sf_dir):
    return network.weak_components(_thin(Net(spark, sf_dir)))


@query(with_net(""", arc AS (SELECT DISTINCT u AS a, v AS b FROM net_edges),
reach AS (SELECT a AS s, a AS n FROM (SELECT a FROM arc UNION SELECT b FROM arc) x UNION SELECT r.s, arc.b FROM reach r JOIN arc ON arc.a = r.n)
SELECT x.s AS node, min(x.n) AS component FROM reach x JOIN reach y ON y.s = x.n AND y.n = x.s GROUP BY x.s"""))
def q_strong_components(spark, sf_dir):
    return network.strong_components(Net(spark, sf_dir).edges)


@query(with_net(""", src AS (SELECT DISTINCT origin AS s FROM net_pairs WHERE origin IN (SELECT u FROM net_edges UNION SELECT v FROM net_edges)), arc AS (SELECT DISTINCT u AS a, v AS b FROM net_edges),
hop(source, node, hops) USING KEY (source, node) AS (SELECT s, s, 0 FROM src UNION SELECT h.source, arc.b, min(h.hops + 1) FROM hop h JOIN arc ON arc.a = h.node LEFT JOIN recurring.hop o ON o.source = h.source AND o.node = arc.b WHERE o.node IS NULL OR h.hops + 1 < o.hops GROUP BY 1, 2)
SELECT source, node, hops FROM hop"""))
def q_bfs_hops(spark, sf_dir):
    net = Net(spark, sf_dir)
    return network.bfs_hops(net.edges, net.pairs.select(F.col("origin").alias("source")).distinct())


#: Least costs from all origins, by relaxation.
_SSSP = """, src AS (SELECT DISTINCT origin AS s FROM net_pairs WHERE origin IN (SELECT u FROM net_edges UNION SELECT v FROM net_edges)), arc AS (SELECT u AS a, v AS b, min(length_m) AS c FROM net_edges GROUP BY 1, 2),
sp(source, node, cost) USING KEY (source, node) AS (SELECT s, s, CAST(0 AS DOUBLE) FROM src UNION SELECT h.source, arc.b, min(h.cost + arc.c) FROM sp h JOIN arc ON arc.a = h.node LEFT JOIN recurring.sp o ON o.source = h.source AND o.node = arc.b WHERE o.node IS NULL OR h.cost + arc.c < o.cost - 1e-9 GROUP BY 1, 2)
"""


@query(with_net(_SSSP + "SELECT source, node, round(cost, 5) AS cost FROM sp"))
def q_sssp(spark, sf_dir):
    net = Net(spark, sf_dir)
    return _rounded(search.single_source(net.edges, net.pairs.select(F.col("origin").alias("source")).distinct()), "cost", digits=5)


@query(with_net(_SSSP + "SELECT p.od_id, round(sp.cost, 5) AS cost FROM net_pairs p JOIN sp ON sp.source = p.origin AND sp.node = p.destination WHERE p.origin <> p.destination"))
def q_shortest_cost(spark, sf_dir):
    net = Net(spark, sf_dir)
    return _rounded(search.find_routes(net.edges, net.pairs).select("od_id", "cost"), "cost", digits=5)


@query(with_net(_SSSP + "SELECT p.od_id, p.origin, p.destination, coalesce(sp.node IS NOT NULL, FALSE) AS reachable FROM net_pairs p LEFT JOIN sp ON sp.source = p.origin AND sp.node = p.destination"))
def q_has_path(spark, sf_dir):
    net = Net(spark, sf_dir)
    return search.has_path(net.edges, net.pairs)


@query(with_net(_SSSP + ", a(algorithm) AS (VALUES ('dijkstra'), ('astar'), ('bellman_ford'), ('bidirectional')) SELECT a.algorithm, p.od_id, round(sp.cost, 5) AS cost FROM a, net_pairs p JOIN sp ON sp.source = p.origin AND sp.node = p.destination WHERE p.origin <> p.destination"))
def q_search_algos(spark, sf_dir):
    net = Net(spark, sf_dir)
    out = None
    for name in ("dijkstra", "astar", "bellman_ford", "bidirectional"):
        found = search.find_routes(net.edges, net.pairs, search=name, algorithm=name).select("algorithm", "od_id", "cost")
        out = found if out is None else out.unionByName(found)
    return _rounded(out, "cost", digits=5)


@query(with_net(_SSSP + "SELECT p.od_id, round(sp.cost, 5) AS cost, TRUE AS joined FROM net_pairs p JOIN sp ON sp.source = p.origin AND sp.node = p.destination WHERE p.origin <> p.destination"))
def q_shortest_route(spark, sf_dir):
    """The steps of each route: what they sum up to, and whether they lead from the origin to the destination without a gap."""
    net = Net(spark, sf_dir)
    steps = search.steps(search.find_routes(net.edges, net.pairs)).select("od_id", "pos", "u", "v", "edge_id").join(net.edges.select("edge_id", "length_m"), "edge_id")
    steps = steps.withColumn("whole", F.coalesce(F.lag("v").over(Window.partitionBy("od_id").orderBy("pos")) == F.col("u"), F.col("pos") == 0))
    ends = steps.groupBy("od_id").agg(F.sum("length_m").alias("cost"), F.min("whole").alias("whole"), F.min_by("u", "pos").alias("a"), F.max_by("v", "pos").alias("b"))
    return _rounded(ends.join(net.pairs, "od_id").select("od_id", "cost", (F.col("whole") & (F.col("a") == F.col("origin")) & (F.col("b") == F.col("destination"))).alias("joined")), "cost", digits=5)


@query()
def q_simple_paths(spark, sf_dir):
    net = Net(spark, sf_dir)
    return search.simple_paths(net.edges, net.pairs, 3).select("od_id", "nth", F.array_join(F.col("nodes").cast("array<string>"), ";").alias("nodes"), F.round("cost", 5).alias("cost"))


@query()
def q_traversal_trees(spark, sf_dir):
    edges = Net(spark, sf_dir).edges
    return search.tree(edges, 21).withColumn("kind", F.lit("bfs")).unionByName(search.tree(edges, 21, True).withColumn("kind", F.lit("dfs")))


#: Least costs over edges as states, with penalties between them.
_TURN_COST = BEAR + f""", pen AS (SELECT from_edge, to_edge, {_PENALTY} AS p FROM tk), tsrc AS (SELECT DISTINCT origin AS s FROM net_pairs),
ts(source, edge, cost) USING KEY (source, edge) AS (SELECT tsrc.s, e.edge_id, e.length_m FROM tsrc JOIN net_edges e ON e.u = tsrc.s
 UNION SELECT h.source, pen.to_edge, min(h.cost + pen.p + e.length_m) FROM ts h JOIN pen ON pen.from_edge = h.edge JOIN net_edges e ON e.edge_id = pen.to_edge LEFT JOIN recurring.ts o ON o.source = h.source AND o.edge = pen.to_edge
 WHERE o.edge IS NULL OR h.cost + pen.p + e.length_m < o.cost - 1e-9 GROUP BY 1, 2)
"""


@query(with_net(_TURN_COST + "SELECT p.od_id, round(min(ts.cost), 5) AS cost FROM net_pairs p JOIN ts ON ts.source = p.origin JOIN net_edges e ON e.edge_id = ts.edge AND e.v = p.destination GROUP BY p.od_id"))
def q_turn_route_cost(spark, sf_dir):
    net = Net(spark, sf_dir)
    return _rounded(search.find_routes(net.edges, net.pairs, turns=MODEL).select("od_id", "cost"), "cost", digits=5)


@query(with_net(BEAR + "SELECT edge_id, round(bearing, 6) AS first, round(bearing, 6) AS last FROM eb"))
def q_edge_bearings(spark, sf_dir):
    return _rounded(turns.with_bearings(Net(spark, sf_dir).edges).select("edge_id", "first", "last"), "first", "last")


@query(with_net(BEAR + "SELECT kind, count(*) AS n FROM tk GROUP BY kind"))
def q_turn_kind(spark, sf_dir):
    return turns.turn_pairs(Net(spark, sf_dir).edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(with_net(BEAR + "SELECT from_edge, to_edge, CASE WHEN round(angle, 6) = -180 THEN 180 ELSE round(angle, 6) END AS angle, kind FROM tk"))
def q_turn_pairs(spark, sf_dir):
    pairs = _rounded(turns.turn_pairs(Net(spark, sf_dir).edges).select("from_edge", "to_edge", "angle", "kind"), "angle")
    # A turn straight back is 180 either way; the last bit decides on the sign.
    return pairs.withColumn("angle", F.when(F.col("angle") == -180, 180.0).otherwise(F.col("angle")))


@query(with_net(BEAR + f"SELECT from_edge, to_edge, {_PENALTY} AS penalty FROM tk"))
def q_turn_penalty(spark, sf_dir):
    return turns.turn_pairs(Net(spark, sf_dir).edges, MODEL).select("from_edge", "to_edge", "penalty")


_SHOWN = "highway IN ('residential', 'primary', 'cycleway')"


@query(with_net(BEAR + f""", poor AS (SELECT edge_id, CASE WHEN coalesce({_SHOWN}, FALSE) THEN 0 ELSE 1000 END + greatest(0, 45 - length_m) AS p FROM net_edges),
s AS (SELECT CASE WHEN abs(angle) <= 25 AND fu <> tv THEN 'straight' WHEN abs(angle) > 25 AND abs(angle) <= 55 THEN 'slight' WHEN abs(angle) >= 150 AND fu = tv THEN 'u_turn' END AS kind, k.from_edge, k.to_edge, angle, a.p AS fp, b.p AS tp FROM tp k JOIN poor a ON a.edge_id = k.from_edge JOIN poor b ON b.edge_id = k.to_edge),
o AS (SELECT *, fp + tp + CASE kind WHEN 'straight' THEN abs(angle) WHEN 'slight' THEN abs(abs(angle) - 40) ELSE abs(abs(angle) - 180) END AS score FROM s WHERE kind IS NOT NULL)
SELECT kind, round(min(score), 6) AS score FROM o GROUP BY kind"""))
def q_turn_examples(spark, sf_dir):
    edges = Net(spark, sf_dir).edges
    found = turns.turn_examples(edges, F.coalesce(F.col("highway").isin("residential", "primary", "cycleway"), F.lit(False))).filter("kind <> 'sides'")
    poor = edges.select("edge_id", (F.when(F.coalesce(F.col("highway").isin("residential", "primary", "cycleway"), F.lit(False)), 0).otherwise(1000) + F.greatest(F.lit(0.0), 45 - F.col("length_m"))).alias("p"))
    pairs = turns.turn_pairs(edges).select("from_edge", "to_edge", "angle")
    own = found.join(pairs, ["from_edge", "to_edge"]).join(poor.select(F.col("edge_id").alias("from_edge"), F.col("p").alias("fp")), "from_edge").join(poor.select(F.col("edge_id").alias("to_edge"), F.col("p").alias("tp")), "to_edge")
    goal = F.when(F.col("kind") == "straight", 0).when(F.col("kind") == "slight", 40).otherwise(180)
    return own.select("kind", F.round(F.col("fp") + F.col("tp") + F.abs(F.abs("angle") - goal), 6).alias("score"))


@query(with_net(BEAR + f""", w AS ({{walks}}), n AS (SELECT w.*, lead(edge_id) OVER (PARTITION BY algorithm, od_id ORDER BY pos, edge_id) AS nx FROM w)
SELECT n.algorithm, n.od_id, CAST(count(*) FILTER (WHERE CASE WHEN abs(d) <= 55 THEN FALSE ELSE d IS NOT NULL END) AS INT) AS turns FROM (
 SELECT n.*, (((b.bearing - a.bearing + 180) % 360) + 360) % 360 - 180 AS d FROM n JOIN eb a ON a.edge_id = n.edge_id LEFT JOIN eb b ON b.edge_id = n.nx) n GROUP BY 1, 2""").replace("{walks}", __import__("trailforge.plans.relations", fromlist=["WALKS"]).WALKS))
def q_count_turns(spark, sf_dir):
    net = Net(spark, sf_dir)
    steps = walks(spark, net)
    return turns.count_turns(steps.withColumn("pos", F.struct("pos", "edge_id")), net.edges, ["algorithm", "od_id"])


@query(with_net(_SSSP + "SELECT a.algorithm, count(*) AS routes FROM net_pairs p JOIN sp ON sp.source = p.origin AND sp.node = p.destination, (SELECT 'shortest' AS algorithm UNION ALL SELECT 'comfort') a WHERE p.origin <> p.destination GROUP BY 1"))
def q_union_routes(spark, sf_dir):
    net = Net(spark, sf_dir)
    found = scoring.build_routes(net.edges, net.pairs, {"comfort": costs.solution(costs.comfort_cost(WEIGHTS), turns="none")})
    return found.groupBy("algorithm").agg(F.count(F.lit(1)).alias("routes"))


@query(with_net(_SSSP + "SELECT p.od_id, round(sp.cost, 5) AS route_length_m, round(sp.cost, 5) AS drawn_m FROM net_pairs p JOIN sp ON sp.source = p.origin AND sp.node = p.destination WHERE p.origin <> p.destination"))
def q_route_geometry(spark, sf_dir):
    """A cheapest route passes no street twice, so its lines are as long as it is."""
    net = Net(spark, sf_dir)
    found = search.with_geometry(search.find_routes(net.edges, net.pairs), net.edges)
    drawn = F.aggregate(F.transform("geometry", lambda line: G.polyline_length(line)), F.lit(0.0), lambda t, x: t + x)
    return _rounded(found.select("od_id", "route_length_m", drawn.alias("drawn_m")), "route_length_m", "drawn_m", digits=5)


@query()
def q_score_end_to_end(spark, sf_dir):
    net = Net(spark, sf_dir)
    rows = scoring.score(labelled(net), net.pairs, {"comfort": costs.solution(costs.comfort_cost(WEIGHTS), turns=MODEL)})
    return rows.drop("search_ms")


@query()
def q_score_summary(spark, sf_dir):
    net = Net(spark, sf_dir)
    rows = scoring.score(labelled(net), net.pairs, {"comfort": costs.solution(costs.comfort_cost(WEIGHTS), turns=MODEL)})
    return scoring.summary(rows).drop("search_ms")
