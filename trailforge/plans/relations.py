"""Queries on joins, aggregates, windows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailforge.functions.tags import has_any
from trailforge.operators import costs, learning, network, popularity, report, scoring
from trailforge.plans.catalog import query
from trailforge.plans.testnet import Net, table, with_net

#: Popularity of the network's edges, as further expressions.
POP = """,
pop_rows AS (SELECT e.*, t.trips FROM net_edges e LEFT JOIN net_trips t ON e.edge_id = t.edge_id),
pop_mass AS (SELECT trips AS value, sum(length_m) AS length FROM pop_rows WHERE trips IS NOT NULL GROUP BY trips),
pop_scale AS (SELECT value, length / sum(length) OVER () AS mass, coalesce(sum(length) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(length) OVER () AS before FROM pop_mass),
pop AS (SELECT r.*, 50 * (2 * s.before + s.mass) AS popularity FROM pop_rows r LEFT JOIN pop_scale s ON r.trips = s.value)
"""
#: Walks along rows of the grid as routes of two algorithms.
WALKS = """
SELECT CASE WHEN key = 0 AND v = u + 1 THEN 'shortest' ELSE 'other' END AS algorithm, CONCAT('R', CAST(CAST(FLOOR(u / 20) AS INT) AS VARCHAR(9))) AS od_id, u AS pos, edge_id
FROM net_edges WHERE (v = u + 1 OR v = u - 1) AND FLOOR(u / 20) = FLOOR(v / 20) AND u % 7 <> 3"""


def labelled(net: Net):
    return popularity.align_labels(net.edges, net.trips)


def walks(spark, net):
    return spark.sql(WALKS)


@query(with_net("SELECT e.edge_id, e.length_m, t.trips FROM net_edges e LEFT JOIN net_trips t ON e.edge_id = t.edge_id"))
def q_label_align(spark, sf_dir):
    return labelled(Net(spark, sf_dir)).select("edge_id", "length_m", "trips")


@query(with_net("SELECT DISTINCT n AS node FROM (SELECT u AS n FROM net_edges UNION ALL SELECT v FROM net_edges) x WHERE n NOT IN (SELECT node FROM net_nodes WHERE sz % 9 <> 0)"))
def q_missing_nodes(spark, sf_dir):
    net = Net(spark, sf_dir)
    return network.missing_nodes(net.edges, net.nodes.filter("sz % 9 <> 0"))


@query(with_net("SELECT e.edge_id, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM net_edges e JOIN net_nodes a ON e.u = a.node JOIN net_nodes b ON e.v = b.node"))
def q_edge_endpoints(spark, sf_dir):
    net = Net(spark, sf_dir)
    return network.with_ends(net.edges, net.nodes).select("edge_id", "ux", "uy", "vx", "vy")


@query(with_net(POP.replace("\npop_rows", "\npop_rows", 1) + "SELECT value, round(mass, 9) AS mass, round(before, 9) AS before FROM pop_scale"))
def q_pop_scale(spark, sf_dir):
    return popularity.fit_scale(labelled(Net(spark, sf_dir))).select("value", F.round("mass", 9).alias("mass"), F.round("before", 9).alias("before"))


@query(with_net(POP + "SELECT edge_id, round(popularity, 6) AS popularity FROM pop"))
def q_popularity(spark, sf_dir):
    return popularity.popularity(labelled(Net(spark, sf_dir))).select("edge_id", F.round("popularity", 6).alias("popularity"))


@query("""WITH fit AS (SELECT l_quantity AS q, sum(l_extendedprice) AS w FROM lineitem WHERE l_linenumber = 1 AND l_quantity BETWEEN 10 AND 40 AND CAST(l_quantity AS INT) % 3 <> 0 GROUP BY 1),
ask AS (SELECT DISTINCT l_quantity AS q FROM lineitem), total AS (SELECT sum(w) AS w FROM fit)
SELECT a.q, round(50 * (coalesce((SELECT sum(w) FROM fit WHERE fit.q < a.q), 0) + coalesce((SELECT sum(w) FROM fit WHERE fit.q <= a.q), 0)) / total.w, 6) AS popularity FROM ask a, total""")
def q_popularity_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    fit = rows.filter("l_linenumber = 1 AND l_quantity BETWEEN 10 AND 40 AND CAST(l_quantity AS INT) % 3 <> 0")
    scale = popularity.fit_scale(fit, "l_quantity", "l_extendedprice")
    return popularity.apply_scale(rows.select("l_quantity").distinct(), scale, "l_quantity").select(F.col("l_quantity").alias("q"), F.round("popularity", 6).alias("popularity"))


@query(with_net(POP + "SELECT CASE WHEN edge_id % 11 = 0 THEN 'hidden' WHEN popularity IS NULL THEN 'unknown' ELSE 'known' END AS layer, count(*) AS n, round(avg(popularity), 6) AS popularity FROM pop GROUP BY 1"))
def q_popularity_layers(spark, sf_dir):
    rows = popularity.popularity(labelled(Net(spark, sf_dir))).withColumn("out", F.col("edge_id") % 11 == 0)
    return popularity.layers(rows, "out").groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("popularity"), 6).alias("popularity"))


_MIXED = """, w AS (SELECT r.*, e.length_m, e.popularity FROM (%s) r JOIN pop e ON r.edge_id = e.edge_id),
m AS (SELECT algorithm, od_id, sum(length_m) AS length_m, CAST(count(*) %% 4 AS DOUBLE) AS turns, CAST(count(*) AS DOUBLE) AS search_ms,
  100 * sum(CASE WHEN popularity IS NOT NULL THEN length_m ELSE 0 END) / sum(length_m) AS coverage_pct, sum(coalesce(popularity, 50) * length_m) / sum(length_m) AS popularity
  FROM w WHERE NOT (algorithm = 'other' AND od_id IN ('R1', 'R4')) GROUP BY 1, 2),
p AS (SELECT DISTINCT od_id FROM w), g AS (SELECT a.algorithm, p.od_id FROM p, (SELECT 'shortest' AS algorithm UNION ALL SELECT 'other') a),
per AS (SELECT g.algorithm, g.od_id, m.length_m, m.turns, m.search_ms, m.coverage_pct, m.popularity, b.length_m AS shortest_length_m, b.popularity AS shortest_popularity,
  100 * (m.length_m / b.length_m - 1) AS detour_pct, CASE WHEN m.length_m IS NOT NULL THEN m.popularity ELSE 0 END AS counted, CASE WHEN m.length_m IS NULL THEN 'no route' ELSE '' END AS note
  FROM g LEFT JOIN m ON g.algorithm = m.algorithm AND g.od_id = m.od_id LEFT JOIN m b ON b.od_id = g.od_id AND b.algorithm = 'shortest')
""" % WALKS


def per_od_rows(spark, sf_dir):
    net = Net(spark, sf_dir)
    known = popularity.popularity(labelled(net))
    steps = walks(spark, net)
    kept = steps.filter("NOT (algorithm = 'other' AND od_id IN ('R1', 'R4'))")
    sizes = kept.join(net.edges.select("edge_id", "length_m"), "edge_id").groupBy("algorithm", "od_id").agg(F.sum("length_m").alias("length_m"), (F.count(F.lit(1)) % 4).cast("double").alias("turns"), F.count(F.lit(1)).cast("double").alias("search_ms"))
    metrics = sizes.join(scoring.route_popularity(kept, known), ["algorithm", "od_id"])
    return scoring.per_od(metrics, steps.select("od_id").distinct(), ["shortest", "other"])


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(with_net(POP + _MIXED + "SELECT algorithm, od_id, round(coverage_pct, 6) AS coverage_pct, round(popularity, 6) AS popularity FROM m"))
def q_route_popularity(spark, sf_dir):
    return _rounded(per_od_rows(spark, sf_dir).filter("length_m IS NOT NULL").select("algorithm", "od_id", "coverage_pct", "popularity"), "coverage_pct", "popularity")


@query(with_net(POP + _MIXED + "SELECT algorithm, od_id, round(length_m, 6) AS length_m, turns, search_ms, round(counted, 6) AS counted, note FROM per"))
def q_per_od_grid(spark, sf_dir):
    return _rounded(per_od_rows(spark, sf_dir).select("algorithm", "od_id", "length_m", "turns", "search_ms", "counted", "note"), "length_m", "counted")


@query(with_net(POP + _MIXED + "SELECT algorithm, od_id, round(shortest_length_m, 6) AS shortest_length_m, round(shortest_popularity, 6) AS shortest_popularity, round(detour_pct, 6) AS detour_pct FROM per"))
def q_detour(spark, sf_dir):
    return _rounded(per_od_rows(spark, sf_dir).select("algorithm", "od_id", "shortest_length_m", "shortest_popularity", "detour_pct"), "shortest_length_m", "shortest_popularity", "detour_pct")


@query(with_net(POP + _MIXED + """SELECT algorithm, round_even(avg(counted), 1) AS popularity, round_even(CASE WHEN count(length_m) = count(*) THEN avg(length_m) / 1000 END, 3) AS length_km,
  CAST(count(length_m) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) AS routes, round_even(median(search_ms), 2) AS search_ms FROM per GROUP BY algorithm"""))
def q_summary(spark, sf_dir):
    return scoring.summary(per_od_rows(spark, sf_dir))


@query(with_net(POP + _MIXED + "SELECT rank() OVER (ORDER BY popularity DESC) AS place, algorithm, round(popularity, 6) AS popularity FROM (SELECT algorithm, sum(counted) / (SELECT count(DISTINCT od_id) FROM per) AS popularity FROM per GROUP BY 1) x"))
def q_ranking(spark, sf_dir):
    return _rounded(scoring.ranking(per_od_rows(spark, sf_dir)), "popularity")


@query(with_net(POP + _MIXED + "SELECT algorithm, round(40 * popularity / max(popularity) OVER (), 6) AS points FROM (SELECT algorithm, sum(counted) / (SELECT count(DISTINCT od_id) FROM per) AS popularity FROM per GROUP BY 1) x"))
def q_points(spark, sf_dir):
    return _rounded(scoring.points(scoring.ranking(per_od_rows(spark, sf_dir))).select("algorithm", "points"), "points")


@query(with_net(POP + _MIXED + "SELECT note, count(*) AS n, round(avg(detour_pct), 6) AS detour, round(max(length_m), 6) AS longest FROM per GROUP BY note"))
def q_route_groupby(spark, sf_dir):
    return _rounded(per_od_rows(spark, sf_dir).groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.avg("detour_pct").alias("detour"), F.max("length_m").alias("longest")), "detour", "longest")


@query(with_net(f", w AS ({WALKS}) SELECT DISTINCT edge_id FROM w"))
def q_used_edges(spark, sf_dir):
    return walks(spark, Net(spark, sf_dir)).select("edge_id").distinct()


@query(with_net(f", w AS ({WALKS}), b AS (SELECT DISTINCT od_id, edge_id FROM w WHERE algorithm = 'shortest') SELECT w.algorithm, w.od_id, CAST(count(DISTINCT b.edge_id) AS INT) AS common, CAST(count(DISTINCT w.edge_id) - count(DISTINCT b.edge_id) AS INT) AS added FROM w LEFT JOIN b ON b.od_id = w.od_id AND b.edge_id = w.edge_id WHERE w.algorithm <> 'shortest' GROUP BY 1, 2"))
def q_route_diff(spark, sf_dir):
    return scoring.route_diff(walks(spark, Net(spark, sf_dir)))


@query(with_net(f", w AS ({WALKS}) SELECT DISTINCT w.algorithm, e.edge_id, round_even(e.length_m * (1 + coalesce(e.maxspeed, 20) / 100) / e.length_m, 4) AS per_m FROM w JOIN net_edges e ON w.edge_id = e.edge_id"))
def q_cost_per_metre(spark, sf_dir):
    net = Net(spark, sf_dir)
    priced = network.edge_cost(net.edges, F.col("length_m") * (1 + F.coalesce("maxspeed", F.lit(20.0)) / 100))
    return scoring.cost_per_metre(walks(spark, net), priced)


@query(with_net("SELECT count(*) AS edges, round(sum(length_m) / 1000, 6) AS km FROM net_edges"))
def q_network_summary(spark, sf_dir):
    return _rounded(report.network_summary(Net(spark, sf_dir).edges), "km")


@query(with_net("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(surface, ';')) AS token FROM net_edges WHERE surface IS NOT NULL) x GROUP BY token"))
def q_token_counts(spark, sf_dir):
    return report.token_counts(Net(spark, sf_dir).edges, "surface")


def _dictionary_sql() -> str:
    parts = []
    for c in ("highway", "lit"):
        parts.append(f"SELECT '{c}' AS column, 'category' AS kind, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, (SELECT string_agg(token, ', ' ORDER BY n DESC, token) FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split({c}, ';')) AS token FROM net_edges WHERE {c} IS NOT NULL) x GROUP BY token) y) AS tokens, (SELECT bool_or({c} IS NULL) FROM net_edges) AS has_null")
    parts.append("SELECT 'oneway', 'boolean', NULL, NULL, 'true / false', bool_or(oneway IS NULL) FROM net_edges")
    parts.append("SELECT 'maxspeed', 'number', min(maxspeed), max(maxspeed), NULL, bool_or(maxspeed IS NULL) FROM net_edges")
    return " UNION ALL ".join(parts)


@query(with_net(_dictionary_sql()))
def q_data_dictionary(spark, sf_dir):
    return report.data_dictionary(Net(spark, sf_dir).edges, ["highway", "lit", "oneway", "maxspeed"])


_CATEGORIES = (("signals", "traffic lights"), ("parking", "bicycle parking"), ("water", "drinking water"), ("repair", "repair station"))


@query(with_net(f", c(category, description) AS (VALUES {', '.join(map(str, _CATEGORIES))}) SELECT c.category, c.description, count(p.point_id) AS n FROM c LEFT JOIN net_points p ON p.type = c.category GROUP BY 1, 2"))
def q_poi_counts(spark, sf_dir):
    return report.category_counts(Net(spark, sf_dir).points, spark.createDataFrame(_CATEGORIES, "category string, description string"))


@query(with_net("""SELECT 'maxspeed' AS feature, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS code, min(maxspeed) AS least, max(maxspeed) AS most FROM net_edges
UNION ALL SELECT 'highway', highway, row_number() OVER (ORDER BY min(edge_id)) - 1, NULL, NULL FROM net_edges WHERE highway IS NOT NULL GROUP BY highway"""))
def q_feature_domains(spark, sf_dir):
    return report.feature_domains(Net(spark, sf_dir).edges, ["maxspeed"], ["highway"])


@query("""WITH g AS (SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS w FROM lineitem WHERE l_tax > 0), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM g)
SELECT round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 9) AS corr FROM g, m""")
def q_weighted_corr(spark, sf_dir):
    return _rounded(learning.weighted_corr(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_tax"), "corr", digits=9)


@query("SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0) / count(*) OVER (), 9) AS rank_pct FROM lineitem")
def q_rank_pct(spark, sf_dir):
    return _rounded(learning.rank_pct(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").select("l_orderkey", "l_linenumber", "rank_pct"), "rank_pct", digits=9)


_FILLED = "(CASE WHEN highway IS NULL THEN 0 ELSE 1 END + CASE WHEN surface IS NULL THEN 0 ELSE 1 END + CASE WHEN lit IS NULL THEN 0 ELSE 1 END + CASE WHEN cycleway IS NULL THEN 0 ELSE 1 END + CASE WHEN maxspeed IS NULL THEN 0 ELSE 1 END)"
_COLUMNS = ["highway", "surface", "lit", "cycleway", "maxspeed"]


@query(with_net(f""", t AS (SELECT highway, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, highway) AS place FROM net_edges WHERE highway IS NOT NULL GROUP BY highway),
r AS (SELECT highway, edge_id, row_number() OVER (PARTITION BY highway ORDER BY {_FILLED} DESC, edge_id) AS k FROM net_edges)
SELECT t.highway, r.edge_id, CAST(t.place AS INT) AS place FROM t JOIN r ON r.highway = t.highway AND r.k = 1 WHERE t.place <= 3"""))
def q_typical_rows(spark, sf_dir):
    return costs.typical_rows(Net(spark, sf_dir).edges, 3, columns=_COLUMNS)


@query()
def q_example_rows(spark, sf_dir):
    return report.example_rows(Net(spark, sf_dir).edges, _COLUMNS)


@query(with_net("SELECT edge_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY edge_id) AS k FROM net_edges) x WHERE k = 1"))
def q_dedupe_streets(spark, sf_dir):
    return report.dedupe_streets(Net(spark, sf_dir).edges).select("edge_id", "u", "v")


_ANY = lambda c, vs: f"coalesce(list_has_any(string_split({c}, ';'), {list(vs)}), FALSE)"
_BIKE = f"({_ANY('highway', ['cycleway'])} OR coalesce(len(list_filter(string_split(cycleway, ';'), lambda x: x NOT IN ('', 'no', 'none', 'separate'))) > 0, FALSE))"
_CODES = f"""coalesce(CAST(round_even(popularity, 0) AS INT), -1) AS popularity, CAST({_BIKE} AS INT) AS bike,
 CASE WHEN {_BIKE} THEN 0 WHEN {_ANY('highway', report.BIG_ROADS)} THEN 1 WHEN {_ANY('highway', report.HOME_ROADS)} THEN 2 WHEN {_ANY('highway', report.WALKS)} THEN 3 WHEN {_ANY('highway', report.YARDS)} THEN 4 ELSE 5 END AS road,
 CASE WHEN surface IS NULL THEN 3 WHEN {_ANY('surface', report.HARD)} THEN 0 WHEN {_ANY('surface', report.SOFT)} THEN 2 ELSE 1 END AS surface,
 CASE WHEN lit IS NULL THEN 2 WHEN {_ANY('lit', ['no'])} THEN 0 ELSE 1 END AS lit, CASE WHEN maxspeed IS NULL THEN 3 WHEN maxspeed <= 30 THEN 0 WHEN maxspeed <= 50 THEN 1 ELSE 2 END AS speed"""


@query(with_net(POP + f"SELECT edge_id, {_CODES} FROM pop"))
def q_map_codes(spark, sf_dir):
    return report.map_codes(popularity.popularity(labelled(Net(spark, sf_dir))))


@query()
def q_payload_json(spark, sf_dir):
    return report.payload(popularity.popularity(labelled(Net(spark, sf_dir))))


_FEATURES = """length_m, CAST(coalesce(list_has_any(string_split(highway, ';'), ['cycleway']), FALSE) AS DOUBLE) AS cycleway_road,
 CAST(coalesce(list_has_any(string_split(highway, ';'), ['primary', 'secondary', 'trunk']), FALSE) AS DOUBLE) AS main_road, CAST(coalesce(list_has_any(string_split(surface, ';'), ['asphalt']), FALSE) AS DOUBLE) AS asphalt"""
_COMFORT = "length_m * greatest(CAST(0.1 AS DOUBLE), 1 - CAST(0.5 AS DOUBLE) * cycleway_road + CAST(0.75 AS DOUBLE) * main_road - CAST(0.6 AS DOUBLE) * asphalt)"
WEIGHTS = {"cycleway_road": -0.5, "main_road": 0.75, "asphalt": -0.6}


@query(with_net(f"SELECT edge_id, {_FEATURES} FROM net_edges"))
def q_features(spark, sf_dir):
    return costs.feature_table(Net(spark, sf_dir).edges)


@query(with_net(f", f AS (SELECT edge_id, {_FEATURES} FROM net_edges) SELECT edge_id, round({_COMFORT}, 6) AS cost FROM f"))
def q_comfort_cost(spark, sf_dir):
    return _rounded(network.checked_cost(Net(spark, sf_dir).edges, costs.comfort_cost(WEIGHTS)).select("edge_id", "cost"), "cost")


@query(with_net("SELECT edge_id, round(length_m + CASE WHEN coalesce(lit, 'no') = 'no' THEN 100 ELSE 0 END, 6) AS cost FROM net_edges"))
def q_own_cost(spark, sf_dir):
    own = costs.OwnCost(lambda roads: F.col("length_m") + F.when(F.coalesce("lit", F.lit("no")) == "no", 100).otherwise(0))
    return _rounded(network.checked_cost(Net(spark, sf_dir).edges, own).select("edge_id", "cost"), "cost")


@query(with_net("SELECT edge_id, cost FROM (SELECT edge_id, length_m - maxspeed * 2 AS cost FROM net_edges) x WHERE cost IS NULL OR cost <= 0"))
def q_edge_cost(spark, sf_dir):
    return network.bad_costs(network.edge_cost(Net(spark, sf_dir).edges, F.col("length_m") - F.col("maxspeed") * 2)).select("edge_id", "cost")


@query(with_net(f""", f AS (SELECT *, {_FEATURES.replace('length_m, ', '')}, {_FILLED} AS filled FROM net_edges), t AS (SELECT highway, row_number() OVER (ORDER BY count(*) DESC, highway) AS place FROM net_edges WHERE highway IS NOT NULL GROUP BY highway),
best AS (SELECT highway, arg_min(edge_id, CAST(-filled AS BIGINT) * 1000000000 + edge_id) AS edge_id FROM f WHERE highway IS NOT NULL GROUP BY highway), typical AS (SELECT b.edge_id, t.place FROM best b JOIN t ON b.highway = t.highway WHERE t.place <= 5),
c1 AS (SELECT arg_min(edge_id, CAST(-filled AS BIGINT) * 1000000000 + edge_id) AS edge_id FROM f WHERE cycleway_road <> 0), c2 AS (SELECT arg_min(edge_id, CAST(-filled AS BIGINT) * 1000000000 + edge_id) AS edge_id FROM f WHERE main_road <> 0 AND edge_id NOT IN (SELECT edge_id FROM c1)),
c3 AS (SELECT arg_min(edge_id, CAST(-filled AS BIGINT) * 1000000000 + edge_id) AS edge_id FROM f WHERE asphalt <> 0 AND edge_id NOT IN (SELECT edge_id FROM c1 UNION ALL SELECT edge_id FROM c2)),
chosen AS (SELECT edge_id, 1 AS k FROM c1 UNION ALL SELECT edge_id, 2 FROM c2 UNION ALL SELECT edge_id, 3 FROM c3),
plain AS (SELECT t.edge_id FROM typical t JOIN f ON f.edge_id = t.edge_id WHERE t.edge_id NOT IN (SELECT edge_id FROM chosen) AND cycleway_road = 0 AND main_road = 0 AND asphalt = 0 ORDER BY t.place LIMIT 1),
every AS (SELECT edge_id, 0 AS g, 0 AS k FROM plain UNION ALL SELECT edge_id, 1, k FROM chosen UNION ALL SELECT edge_id, 2, place FROM typical WHERE edge_id NOT IN (SELECT edge_id FROM chosen) AND edge_id NOT IN (SELECT edge_id FROM plain)),
shown AS (SELECT edge_id, CAST(row_number() OVER (ORDER BY g, k) - 1 AS INT) AS place FROM every)
SELECT s.place, f.edge_id, f.highway, f.length_m, f.cycleway_road, f.main_road, f.asphalt FROM shown s JOIN f ON f.edge_id = s.edge_id WHERE s.place < 5"""))
def q_preview_features(spark, sf_dir):
    return costs.preview_features(Net(spark, sf_dir).edges)


@query()
def q_preview_cost(spark, sf_dir):
    return costs.preview_cost(Net(spark, sf_dir).edges, costs.comfort_cost(WEIGHTS))


_BLOCK = """, street AS (SELECT edge_id, floor(avg((x0 + x1) / 2) OVER (PARTITION BY least(u, v), greatest(u, v)) / 250) AS bx, floor(avg((y0 + y1) / 2) OVER (PARTITION BY least(u, v), greatest(u, v)) / 250) AS by_ FROM net_edges)"""


@query(with_net(_BLOCK + " SELECT edge_id, CAST(CAST(bx AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(by_ AS BIGINT) AS VARCHAR) AS block FROM street"))
def q_block_cells(spark, sf_dir):
    return learning.block_cells(Net(spark, sf_dir).edges, 250.0)


@query()
def q_spatial_split(spark, sf_dir):
    net = Net(spark, sf_dir)
    return learning.spatial_split(net.edges, net.trips, 250.0)


@query(with_net("SELECT e.edge_id, round((SELECT avg(ln(1 + trips)) FROM net_trips), 9) AS prediction FROM net_edges e"))
def q_ml_dummy(spark, sf_dir):
    rows = labelled(Net(spark, sf_dir))
    return _rounded(learning.train_model(rows, "dummy", cell_m=250.0).predict_log_trips(rows), "prediction", digits=9)


@query()
def q_ml_ridge_eval(spark, sf_dir):
    rows = labelled(Net(spark, sf_dir))
    model = learning.train_model(rows, "ridge", cell_m=250.0)
    return model.feature(rows).withColumn("validation", F.lit(model.validation).cast("double"))


@query(with_net("SELECT edge_id FROM net_edges WHERE coalesce(surface = 'gravel', FALSE) OR edge_id IN (SELECT edge_id FROM net_trips WHERE trips > 15)"))
def q_layer_mask(spark, sf_dir):
    return report.layer(labelled(Net(spark, sf_dir)), F.coalesce(has_any("surface", "gravel") & (F.col("surface") == "gravel"), F.lit(False)) | F.coalesce(F.col("trips") > 15, F.lit(False))).select("edge_id")
