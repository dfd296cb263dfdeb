"""Readers and writers, by files made here."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from trailforge.operators import network, tracks
from trailforge.sources import files, gpx, osm, pack, points


def test_metres_on_the_ellipsoid():
    """Known arcs of the ellipsoid: a degree of the equator, a quarter of a meridian, a degree of latitude at the equator."""
    assert math.isclose(tracks.vincenty(0, 0, 1, 0), 111319.4908, abs_tol=1e-3)
    assert math.isclose(tracks.vincenty(10, 0, 10, 90), 10001965.7293, abs_tol=1e-3)
    assert math.isclose(tracks.vincenty(0, 0, 0, 1), 110574.3886, abs_tol=1e-3)
    assert tracks.vincenty(30, 60, 30, 60) == 0.0


def gpx_file(parts):
    spell = lambda p: f'<trkpt lat="{p[1]}" lon="{p[0]}"><ele>5</ele>' + (f"<time>2024-05-01T10:{p[2] // 60:02d}:{p[2] % 60:02d}Z</time>" if p[2] is not None else "") + "</trkpt>"
    return '<?xml version="1.0" encoding="UTF-8"?><gpx xmlns="http://www.topografix.com/GPX/1/1">' + "".join(f"<trk><name>t{k}</name>" + "".join(f"<trkseg>{''.join(map(spell, s))}</trkseg>" for s in trk) + "</trk>" for k, trk in enumerate(parts)) + "</gpx>"


def test_tracks_are_read_and_cleaned(spark, tmp_path):
    step = 1 / 111319.4908 / math.cos(math.radians(60)) * 50  # about 50 m to the east
    lon = lambda k: 30 + k * step
    first = [(lon(0), 60, 0), (lon(1), 60, 10), (lon(1), 60, 12), (lon(2), 60, 11), (lon(2), 60, 5), (lon(4), 60, 12), (lon(2), 60, 20), (lon(3), 60, None), (lon(9), 60, None), (lon(10), 60, 900), (20.0, 60, 905), (lon(11), 60, 910)]
    (tmp_path / "ride_1.gpx").write_text(gpx_file([[first, [(lon(0), 60, 0), (lon(0), 60, 5)]], [[(lon(5), 60, 1), (lon(6), 60, 20)]]]))
    raw = gpx.read_gpx(spark, str(tmp_path))
    assert {(r.activity_id, r.name) for r in raw.collect()} == {("ride_1:T1:S1", "t0"), ("ride_1:T1:S2", "t0"), ("ride_1:T2:S1", "t1")}
    assert raw.filter("activity_id = 'ride_1:T1:S1'").count() == len(first) and raw.filter("t IS NULL").count() == 2
    got = {(r.activity_id, r.part): [round((p.x - 30) / step) for p in r.geometry] for r in gpx.load_tracks(spark, str(tmp_path)).collect()}
    # Too near, too fast, back in time and out of bounds go; a far step begins a part.
    assert got == {("ride_1:T1:S1", 0): [0, 1, 2, 3], ("ride_1:T1:S1", 1): [9, 10, 11], ("ride_1:T2:S1", 0): [5, 6]}


def test_broken_gpx_is_an_error(spark, tmp_path):
    (tmp_path / "a.gpx").write_text("<gpx><trk></gpx>")
    with pytest.raises(Exception):
        gpx.read_gpx(spark, str(tmp_path)).collect()


def test_points_from_csv_and_geojson(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,lon,lat\nx,10.5,50\ny,11,51.5\n")
    assert sorted((r.name, r.lon, r.lat) for r in points.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [("x", 10.5, 50.0), ("y", 11.0, 51.5)]
    for text in ("name,lon\nx,1\n", "lon,lat\nabc,1\n", "lon,lat\n181,1\n", "lon,lat\n1,NaN\n"):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(ValueError):
            points.read_csv(spark, str(tmp_path / "b.csv"))
    feature = lambda kind, at: {"type": "Feature", "geometry": {"type": kind, "coordinates": at}, "properties": {"k": kind}}
    (tmp_path / "a.json").write_text(json.dumps({"features": [feature("Point", [1, 2]), feature("MultiPoint", [[3, 4], [5, 6]])]}))
    assert sorted((r.lon, r.lat) for r in points.read_geojson(spark, str(tmp_path / "a.json")).collect()) == [(1, 2), (3, 4), (5, 6)]
    (tmp_path / "b.json").write_text(json.dumps({"features": [feature("LineString", [[1, 2], [3, 4]])]}))
    with pytest.raises(ValueError):
        points.read_geojson(spark, str(tmp_path / "b.json"))


def test_points_from_geoparquet(spark, tmp_path):
    line = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y")))
    spark.range(3).select("id", points.as_wkb(line).alias("geometry")).write.parquet(str(tmp_path / "p"))
    assert sorted((r.id, r.x, r.y) for r in points.read_geoparquet(spark, str(tmp_path / "p")).collect()) == [(k, float(k), 2.0) for k in range(3)]
    two = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), F.struct(F.lit(3.0).alias("x"), F.lit(2.0).alias("y")))
    spark.range(1).select("id", points.as_wkb(two).alias("geometry")).write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        points.read_geoparquet(spark, str(tmp_path / "q"))


def test_catalogues_are_replaced_whole(spark, tmp_path):
    place = str(tmp_path)
    assert points.load_catalog(spark, place) is None
    rows = lambda *r: spark.createDataFrame(list(r), "type string, point_id string")
    points.save_catalog(rows(("water", "a"), ("gate", "b")), place, ["water", "gate"], "test")
    points.save_catalog(rows(("water", "c")), place, ["water", "gate"], "test", city="x")
    found, manifest = points.load_catalog(spark, place)
    assert [(r.type, r.point_id) for r in found.collect()] == [("water", "c")] and manifest["city"] == "x"
    assert sorted(p.name for p in (tmp_path / "points").iterdir() if not p.name.startswith(".")) == ["manifest.json", "points.parquet"]
    for bad in (rows(("tree", "a")), rows(("water", "a"), ("water", "a"))):
        with pytest.raises(ValueError):
            points.save_catalog(bad, place, ["water"], "test")
    (tmp_path / "points/points.parquet/type=water/more.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="changed"):
        points.load_catalog(spark, place)


def test_moves_need_a_source(spark, tmp_path):
    (tmp_path / "new").mkdir()
    with pytest.raises(FileNotFoundError):
        files.replace(spark, str(tmp_path / "none"), str(tmp_path / "new"))
    assert (tmp_path / "new").exists()


NODES = {1: (0.0, 0.0), 2: (100.0, 0.0), 3: (100.0, 100.0)}


@pytest.fixture
def parts(spark):
    nodes = network.make_nodes(spark, NODES)
    edges = network.make_edges(spark, [{"u": 2, "v": 3}, {"u": 1, "v": 2}], nodes)
    pairs = spark.createDataFrame([("A1", 1, 3, "open"), ("A2", 1, 2, "closed")], "od_id string, origin long, destination long, zone string")
    labels = spark.createDataFrame([(2, 3, 0, 7), (1, 2, 0, None)], "u long, v long, key long, trips long")
    return edges, nodes, pairs, labels


def test_packs_keep_what_is_open(spark, tmp_path, parts):
    edges, nodes, pairs, labels = parts
    place = str(tmp_path / "p")
    manifest = pack.write_pack(spark, place, "grid", edges, nodes, pairs, labels)
    assert (manifest["roads"], manifest["open_pairs"], manifest["open_labels"]) == (2, 1, 1)
    city = pack.load_pack(spark, place)
    assert sorted((r.edge_id, r.u, r.trips) for r in city.edges.collect()) == [(0, 1, None), (1, 2, 7)]
    again = pack.write_pack(spark, str(tmp_path / "q"), "grid", edges, nodes, pairs, labels)
    assert again["roads"] == manifest["roads"]
    for bad in (edges.withColumn("trips", F.lit(1)), edges.withColumn("zone", F.lit("closed")), edges.withColumn("zone", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            pack.write_pack(spark, str(tmp_path / "r"), "grid", bad, nodes, pairs, labels)
    nodes.limit(1).write.mode("overwrite").parquet(f"{place}/nodes.parquet")
    with pytest.raises(ValueError, match="changed"):
        pack.load_pack(spark, place)
    with pytest.raises(FileNotFoundError):
        pack.load_pack(spark, str(tmp_path / "none"))


def test_cached_routes_and_bundles(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = pack.cache_key("a", {"k": 1})
    assert key == pack.cache_key("a", {"k": 1}) != pack.cache_key("a", {"k": 2})
    for _ in range(2):
        assert pack.cached_routes(spark, str(tmp_path), key, build).count() == 3
    assert len(built) == 1 and pack.cached_routes(spark, str(tmp_path), key + "b", build).count() == 3 and len(built) == 2
    path = pack.export_bundle(str(tmp_path / "b.zip"), {"mine": 1}, {"dataset_id": "d"}, {"notes.txt": b"hi"}, ("extra==1",))
    with zipfile.ZipFile(io.BytesIO(open(path, "rb").read())) as z:
        assert {"solutions.pkl", "manifest.json", "requirements.txt", "files/notes.txt"} == set(z.namelist())
        assert json.loads(z.read("manifest.json"))["solutions"] == ["mine"] and b"extra==1" in z.read("requirements.txt") and b"pyspark==" in z.read("requirements.txt")


def test_servers_are_asked_in_turn():
    servers = [("one", False), ("local", True), ("two", False)]
    inside, outside = (9.0, 47.0, 9.5, 48.0), (100.0, 0.0, 101.0, 1.0)
    assert osm.servers_for(servers, inside) == ["one", "local", "two"] and osm.servers_for(servers, outside) == osm.servers_for(servers, None) == ["one", "two"]
    answers = {"one": {"remark": "busy", "elements": []}, "local": {"elements": []}, "two": {"elements": []}}
    assert osm.download(servers, inside, lambda a, q: answers[a]) == ({"elements": []}, "two")
    answers["local"] = {"elements": [1]}
    assert osm.download(servers, inside, lambda a, q: answers[a])[1] == "local"

    def broken(address, query):
        raise OSError(f"{address} is down")

    with pytest.raises(ConnectionError, match="two is down"):
        osm.download(servers, inside, broken)
    with pytest.raises(ConnectionError, match="no elements"):
        osm.download([("one", False)], inside, lambda a, q: {})
    text = osm.query(inside, {"x": {"k": ["v", 'w"']}})
    assert text == '[out:json][timeout:180];(nwr["k"="v"](47.0,9.0,48.0,9.5);nwr["k"="w\\""](47.0,9.0,48.0,9.5););out center;'


def test_places_without_coordinates_are_refused(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"highway": "crossing", "name": "X"}}, {"type": "way", "id": 1, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"highway": "bus_stop", "public_transport": "platform"}}]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}))
    rows = {(r.point_id, r.type): (r.name, r.lon, r.lat) for r in osm.checked(osm.classify(osm.read_json(spark, str(tmp_path / "a.json")))).collect()}
    assert rows == {("node/1", "crossings"): ("X", 2.0, 1.0), ("way/1", "stops"): (None, 4.0, 3.0)}
    (tmp_path / "b.json").write_text(json.dumps({"elements": [{"type": "way", "id": 2, "tags": {"highway": "crossing"}}]}))
    with pytest.raises(ValueError):
        osm.checked(osm.classify(osm.read_json(spark, str(tmp_path / "b.json"))))


def test_roads_from_map_data(spark, tmp_path):
    at = {1: (9.0, 47.0), 2: (9.001, 47.0), 3: (9.002, 47.0), 4: (9.002, 47.001), 5: (9.003, 47.0)}
    ways = [(10, [1, 2, 3], {"highway": "residential", "maxspeed": "30 km/h"}), (11, [3, 4], {"highway": "path", "oneway": "-1"}), (12, [3, 5], {"highway": "service", "oneway": "yes"}), (13, [1, 5], {"building": "yes"}), (14, [3, 99, 5], {"highway": "service", "oneway": "yes"})]
    elements = [{"type": "node", "id": k, "lon": x, "lat": y} for k, (x, y) in at.items()] + [{"type": "way", "id": k, "nodes": n, "tags": t} for k, n, t in ways]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}))
    raw, nodes = osm.road_graph(osm.read_roads(spark, str(tmp_path / "a.json")))
    edges = network.validate_edges(network.complete_edges(raw, nodes))
    got = {(r.u, r.v, r.key): (r.highway, len(r.geometry), r.oneway, r.maxspeed) for r in edges.collect()}
    assert got == {(1, 3, 0): ("residential", 3, False, 30.0), (3, 1, 0): ("residential", 3, False, 30.0), (4, 3, 0): ("path", 2, True, None), (3, 5, 0): ("service", 2, True, None), (3, 5, 1): ("service", 2, True, None)}
    assert sorted(r.node for r in nodes.collect()) == [1, 3, 4, 5]
    long = edges.filter("u = 1").first().length_m
    assert math.isclose(long, tracks.vincenty(9.0, 47.0, 9.002, 47.0), rel_tol=1e-3)
    every, _ = osm.road_graph(osm.read_roads(spark, str(tmp_path / "a.json")), simplify=False)
    assert {(r.u, r.v) for r in every.collect()} == {(1, 2), (2, 3), (3, 2), (2, 1), (4, 3), (3, 5)}
