"""Queries on geometry, places, tracks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailforge.functions import geometry as G
from trailforge.operators import network, spatial, tracks
from trailforge.plans.catalog import query
from trailforge.plans.relations import _rounded, walks
from trailforge.plans.testnet import Net, shared, table, with_net
from trailforge.sources import gpx

#: An edge's distance from a point, in SQL.
_DIST = """CASE WHEN (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) = 0 THEN sqrt((px-x0)*(px-x0)+(py-y0)*(py-y0)) ELSE
 sqrt(power(px - x0 - greatest(0, least(1, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))))*(x1-x0), 2) + power(py - y0 - greatest(0, least(1, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))))*(y1-y0), 2)) END"""
_NEAR = f", d AS (SELECT e.edge_id, p.point_id, {_DIST} AS distance FROM net_edges e, (SELECT point_id, x AS px, y AS py FROM net_points) p)"


@query(with_net(_NEAR + " SELECT e.edge_id, e.edge_id IN (SELECT edge_id FROM d WHERE distance <= 30) AS near FROM net_edges e"))
def q_within_radius(spark, sf_dir):
    net = Net(spark, sf_dir)
    return spatial.within_radius(net.edges, net.points, 30.0)


@query(with_net(_NEAR + " SELECT point_id, round(min(distance), 6) AS distance FROM d WHERE distance <= 60 GROUP BY point_id"))
def q_points_near_roads(spark, sf_dir):
    net = Net(spark, sf_dir)
    return _rounded(spatial.points_near_roads(net.edges, net.points, 60.0).select("point_id", "distance"), "distance")


@query(with_net(_NEAR + """, c AS (SELECT DISTINCT point_id FROM d WHERE distance <= 60), n AS (SELECT a.point_id, count(*) AS neighbours FROM net_points a JOIN net_points b ON sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 120 GROUP BY 1)
SELECT n.point_id, n.neighbours FROM n JOIN c ON c.point_id = n.point_id ORDER BY n.neighbours, n.point_id LIMIT 1"""))
def q_focus_point(spark, sf_dir):
    net = Net(spark, sf_dir)
    return spatial.focus_point(net.edges, net.points, 60.0).select("point_id", "neighbours")


@query(with_net(""", u AS (SELECT node, x, y FROM net_nodes WHERE node IN (SELECT u FROM net_edges UNION SELECT v FROM net_edges)),
d AS (SELECT p.point_id, u.node, sqrt((u.x-p.x)*(u.x-p.x)+(u.y-p.y)*(u.y-p.y)) AS distance FROM net_points p, u)
SELECT point_id, node, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, node) AS k FROM d WHERE distance <= 500) x WHERE k = 1"""))
def q_snap_nearest(spark, sf_dir):
    net = Net(spark, sf_dir)
    return _rounded(spatial.snap(net.points, net.edges, net.nodes, 500.0), "distance")


@query(with_net("SELECT min(least(x0, x1)) - 50 AS xmin, min(least(y0, y1)) - 50 AS ymin, max(greatest(x0, x1)) + 50 AS xmax, max(greatest(y0, y1)) + 50 AS ymax FROM net_edges"))
def q_network_bbox(spark, sf_dir):
    return spatial.network_bbox(Net(spark, sf_dir).edges, 50.0)


@query(with_net("SELECT edge_id FROM net_edges WHERE least(x0, x1) <= 800 AND greatest(x0, x1) >= 300 AND least(y0, y1) <= 500 AND greatest(y0, y1) >= 100"))
def q_bbox_slice(spark, sf_dir):
    return spatial.bbox_slice(Net(spark, sf_dir).edges, 300, 100, 800, 500).select("edge_id")


@query("SELECT a.p_partkey, least(a.p_size, b.p_size) - 25.0::DOUBLE AS xmin, least(a.p_retailprice, b.p_retailprice) - 25 AS ymin, greatest(a.p_size, b.p_size) + 25.0::DOUBLE AS xmax, greatest(a.p_retailprice, b.p_retailprice) + 25 AS ymax FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def q_corridor_bbox(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    both = part.alias("a").join(part.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    box = spatial.corridor(F.col("a.p_size").cast("double"), F.col("a.p_retailprice"), F.col("b.p_size").cast("double"), F.col("b.p_retailprice"), 25.0)
    return both.select("a.p_partkey", *[c.alias(k) for k, c in box.items()])


#: Embeddings as lines: neighbouring numbers are x and y.
_LINE = ", p AS (SELECT vec_id, i, CAST(embedding[2*i-1] AS DOUBLE) AS x, CAST(embedding[2*i] AS DOUBLE) AS y FROM (SELECT vec_id, embedding, unnest(range(1, 9)) AS i FROM embeddings) t), s AS (SELECT vec_id, i, x, y, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS step, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i))"


def _lines(spark, sf_dir):
    at = [G.point(F.col("embedding")[2 * i], F.col("embedding")[2 * i + 1]) for i in range(8)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*at).alias("line"))


@query("WITH" + _LINE[1:] + " SELECT vec_id, round(sum(step), 6) AS length FROM s GROUP BY vec_id")
def q_polyline_length(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).select("vec_id", G.polyline_length("line").alias("length")), "length")


@query("WITH" + _LINE[1:] + """, c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(step) OVER (PARTITION BY vec_id) / 2 AS goal FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM c WHERE step IS NOT NULL AND done + step >= goal - 1e-12)
SELECT vec_id, round(x + (goal - done) / step * (nx - x), 5) AS mx, round(y + (goal - done) / step * (ny - y), 5) AS my FROM h WHERE k = 1""")
def q_polyline_midpoint(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("m", G.interpolate("line"))
    return rows.select("vec_id", F.round("m.x", 5).alias("mx"), F.round("m.y", 5).alias("my"))


_UTM = """WITH c AS (SELECT c_custkey, 29.4 + c_custkey % 150 / 100.0::DOUBLE AS lon, 59.5 + c_custkey % 80 / 100.0::DOUBLE AS lat FROM customer),
k AS (SELECT 1/298.257223563::DOUBLE / (2 - 1/298.257223563::DOUBLE) AS n), a AS (SELECT c.*, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone, n, 6378137.0::DOUBLE / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * 0.9996::DOUBLE AS r, 2 * sqrt(n) / (1 + n) AS e,
 n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM c, k),
b AS (SELECT *, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon) - radians(zone * 6 - 183.0::DOUBLE) AS w FROM a),
d AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t*t)) AS eta FROM b)
SELECT c_custkey, zone, round(500000 + r * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)), 4) AS x, round(r * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), 4) AS y FROM d"""


@query(_UTM)
def q_utm_project(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (29.4 + F.col("c_custkey") % 150 / 100).alias("lon"), (59.5 + F.col("c_custkey") % 80 / 100).alias("lat"))
    x, y = G.utm(F.col("lon"), F.col("lat"))
    return rows.select("c_custkey", G.utm_zone(F.col("lon")).alias("zone"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(with_net("SELECT e.edge_id, e.u, e.v, e.key, round(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)), 6) AS length_m, array_to_string(list_sort(string_split(highway, ';')), ';') AS highway, coalesce(e.oneway, FALSE) AS oneway FROM net_edges e JOIN net_nodes a ON a.node = e.u JOIN net_nodes b ON b.node = e.v"))
def q_make_edges(spark, sf_dir):
    net = Net(spark, sf_dir)
    made = network.complete_edges(net.edges.select("u", "v", "key", "highway", "oneway"), net.nodes)
    return _rounded(made.join(net.edges.select("edge_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("key").cast("long").alias("key")), ["u", "v", "key"]).select("edge_id", "u", "v", F.col("key").cast("int").alias("key"), "length_m", "highway", "oneway"), "length_m")


_RULES = tracks.Rules((0.0, 0.0, 1400.0, 880.0), 36.0, 600.0, 18.0, 1.0)


def _kept(spark, sf_dir):
    rows = Net(spark, sf_dir).tracks.select("track_id", "seq", "x", "y", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return tracks.clean(rows, ["track_id"], _RULES, tracks.planar)


@query(with_net("""SELECT track_id, CAST(seq AS BIGINT) AS seq, x, y, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM net_tracks"""))
def q_gpx_points(spark, sf_dir):
    """The tracks are written as GPX, a track by its name, and read again; their places there count from 0."""
    place = shared(spark, "gpx")
    sign = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    time = sign("time", F.concat(F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    point = F.concat(F.lit('<trkpt lat="'), F.col("y").cast("string"), F.lit('" lon="'), F.col("x").cast("string"), F.lit('">'), time, F.lit("</trkpt>"))
    rows = Net(spark, sf_dir).tracks.groupBy("track_id", F.floor(F.col("track_id") / 100).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda x: x["p"]), "").alias("p"))
    # A file is one document, of a hundred tracks at most.
    trk = sign("trk", F.concat(sign("name", F.col("track_id").cast("string")), sign("trkseg", F.col("p"))))
    rows.groupBy("file").agg(sign("gpx", F.array_join(F.collect_list(trk), "")).alias("value")).write.partitionBy("file").text(place)
    return gpx.read_gpx(spark, place).select(F.col("name").cast("long").alias("track_id"), (F.col("seq") + 1).alias("seq"), "x", "y", "t")


@query(with_net(""", q AS (SELECT track_id, CAST(seq AS BIGINT) AS seq, x, y, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM net_tracks),
f AS (SELECT track_id, seq, x, y, t, 0 AS part, x AS lx, y AS ly, t AS lt, (x BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 880) AS has, (x BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 880) AS keep FROM q WHERE seq = 1
UNION ALL SELECT n.track_id, n.seq, n.x, n.y, n.t, CASE WHEN k.keep AND k.has0 AND k.d > 18 THEN k.part + 1 ELSE k.part END, CASE WHEN k.keep THEN n.x ELSE k.lx END, CASE WHEN k.keep THEN n.y ELSE k.ly END, CASE WHEN k.keep THEN n.t ELSE k.lt END, k.has0 OR k.keep, k.keep
 FROM (SELECT g.*, CASE WHEN NOT (g.nx BETWEEN 0 AND 1400 AND g.ny BETWEEN 0 AND 880) THEN FALSE WHEN NOT g.has0 THEN TRUE WHEN g.d < 1 THEN FALSE WHEN g.s <= 0 THEN FALSE WHEN g.s <= 600 AND 3.6 * g.d / g.s > 36 THEN FALSE ELSE TRUE END AS keep
  FROM (SELECT f.track_id, f.seq, f.part, f.lx, f.ly, f.lt, f.has AS has0, n.x AS nx, n.y AS ny, n.t AS nt, sqrt(power(n.x - f.lx, 2) + power(n.y - f.ly, 2)) AS d, n.t - f.lt AS s FROM f JOIN q n ON n.track_id = f.track_id AND n.seq = f.seq + 1) g) k
 JOIN q n ON n.track_id = k.track_id AND n.seq = k.seq + 1)
SELECT track_id, part, seq, x, y, t FROM (SELECT *, count(*) OVER (PARTITION BY track_id, part) AS c FROM f WHERE keep) z WHERE c >= 2"""))
def q_gpx_clean(spark, sf_dir):
    return _kept(spark, sf_dir)


def _overlaps(spark, sf_dir):
    net = Net(spark, sf_dir)
    steps = walks(spark, net).join(net.edges, "edge_id")
    segments = steps.select("algorithm", "od_id", F.col("edge_id").alias("seg"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    own = tracks.track_segments(_kept(spark, sf_dir), "track_id", ["seq"])
    return tracks.overlap(segments, own, 30.0)


@query()
def q_gpx_overlap(spark, sf_dir):
    return _rounded(_overlaps(spark, sf_dir), "nearest_pct", "any_pct")


@query()
def q_gpx_table(spark, sf_dir):
    return tracks.overlap_table(_overlaps(spark, sf_dir))


@query(with_net("SELECT point_id, type FROM net_points WHERE type = 'water'"))
def q_poi_catalog(spark, sf_dir):
    """The points are saved as a catalogue, which is loaded again."""
    from trailforge.sources.points import by_category, load_catalog, save_catalog

    place = shared(spark, "catalogue")
    save_catalog(Net(spark, sf_dir).points, place, ["signals", "parking", "water"], "test")
    points, _ = load_catalog(spark, place)
    return by_category(points, ["water"]).select("point_id", "type")


_POI = {"music": {"kind": ["view", "click"]}, "shop": {"kind": ["purchase", "click"], "k": ["7"]}}


@query("""WITH t AS (SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
SELECT DISTINCT 'node/' || CAST(event_id AS VARCHAR) AS point_id, c.type FROM t JOIN (SELECT 'music' AS type, 'kind' AS key, 'view' AS value UNION ALL SELECT 'music', 'kind', 'click' UNION ALL SELECT 'shop', 'kind', 'purchase' UNION ALL SELECT 'shop', 'kind', 'click' UNION ALL SELECT 'shop', 'k', '7') c
ON (c.key = 'kind' AND c.value = t.kind) OR (c.key = 'k' AND c.value = t.k)""")
def q_poi_classify(spark, sf_dir):
    from trailforge.sources.osm import classify

    rows = table(spark, sf_dir, "events").select(F.lit("node").alias("type"), F.col("event_id").alias("id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"))
    return classify(rows, _POI).select("point_id", "type")


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS lon, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) BETWEEN -180 AND 180, FALSE) AS valid FROM pages")
def q_points_csv_valid(spark, sf_dir):
    """The numbers in the pages' addresses are written as CSV and scanned."""
    from trailforge.sources.points import checked_lonlat, scan_csv

    place = shared(spark, "csv")
    table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("lon"), F.lit("45.5").alias("lat")).write.csv(place, header=True)
    return checked_lonlat(scan_csv(spark, place)).select(F.col("page_id").cast("long").alias("page_id"), "lon", "valid")


@query(with_net("SELECT row_number() OVER (ORDER BY u, v, key) - 1 AS edge_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(key AS BIGINT) AS key FROM net_edges"))
def q_pack_scan(spark, sf_dir):
    """A pack is written and scanned again."""
    from trailforge.sources import pack

    net = Net(spark, sf_dir)
    edges = network.complete_edges(net.edges.select("u", "v", "key", "length_m", "highway", "surface", "lit", "cycleway", "maxspeed", "oneway"), net.nodes)
    folder = shared(spark, "pack")
    pack.write_pack(spark, folder, "grid", edges, net.nodes.select(F.col("node").cast("long").alias("node"), "x", "y"), net.pairs.withColumn("zone", F.lit("open")), net.trips.join(net.edges.select("edge_id", "u", "v", "key"), "edge_id").select("u", "v", "key", "trips"))
    return pack.load_pack(spark, folder).edges.select("edge_id", "u", "v", "key")
