"""Operators and queries that SQL does not express, against plain Python on the smallest tables."""

import heapq
import itertools
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailforge.operators import costs, learning, network, report, scoring, search, spatial, tracks, turns
from trailforge.plans import catalog, places, relations, routing
from trailforge.plans.testnet import Net


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return Net(spark, sf_dir)


@pytest.fixture(scope="module")
def edges(net):
    return net.edges.toPandas().astype({"edge_id": int, "u": int, "v": int}).set_index("edge_id", drop=False)


def bearing(e):
    return math.degrees(math.atan2(e.x1 - e.x0, e.y1 - e.y0)) % 360


def penalty(angle):
    a = abs(angle)
    return 0.0 if a <= 25 else 5.0 if a <= 55 else 200.0 if a >= 150 else 10.0 if angle > 0 else 25.0


def angle_of(a, b):
    return (bearing(b) - bearing(a) + 180) % 360 - 180


def least(edges, price, origin, goal, turns_cost=False):
    """The least cost by a plain search; with turns over edges as states."""
    rows = list(edges.itertuples(index=False))
    out = defaultdict(list)
    for k, e in enumerate(rows):
        out[e.u].append(k)
    best, heap = {}, []
    for k in out[origin]:
        heapq.heappush(heap, (price[rows[k].edge_id], k))
    while heap:
        c, k = heapq.heappop(heap)
        state = k if turns_cost else rows[k].v
        if state in best:
            continue
        best[state] = c
        if rows[k].v == goal:
            return c
        for n in out[rows[k].v]:
            heapq.heappush(heap, (c + price[rows[n].edge_id] + (penalty(angle_of(rows[k], rows[n])) if turns_cost else 0.0), n))
    return None


def tokens(value):
    return set() if value is None or value != value else set(value.split(";"))


def features_of(e):
    return {"cycleway_road": float("cycleway" in tokens(e.highway)), "main_road": float(bool(tokens(e.highway) & {"primary", "secondary", "trunk"})), "asphalt": float("asphalt" in tokens(e.surface))}


def felt(e):
    return e.length_m * max(0.1, 1 + sum(relations.WEIGHTS[k] * x for k, x in features_of(e).items()))


def test_scores_from_routes_to_summary(net, edges):
    pairs = [tuple(r) for r in net.pairs.select("od_id", "origin", "destination").collect()]
    solutions = {"comfort": costs.solution(costs.comfort_cost(relations.WEIGHTS), turns=routing.MODEL)}
    known = relations.labelled(net)
    routes = {(r.algorithm, r.od_id): r for r in scoring.build_routes(known, net.pairs, solutions).collect()}
    price = {"shortest": edges.length_m.to_dict(), "comfort": {e.edge_id: felt(e) for e in edges.itertuples(index=False)}}
    trips = {r.edge_id: r.trips for r in known.select("edge_id", "trips").collect()}
    mass = Counter()
    for i, t in trips.items():
        if t is not None:
            mass[t] += edges.length_m[i]
    total = sum(mass.values())
    rank = {t: 50 * (2 * sum(m for s, m in mass.items() if s < t) + own) / total for t, own in mass.items()}
    want = {}
    for od, origin, goal in pairs:
        for name in ("shortest", "comfort"):
            cost = least(edges, price[name], origin, goal, name == "comfort") if name == "comfort" or origin != goal else None
            r = routes.get((name, od))
            assert (cost is None) == (r is None)
            if r is None:
                want[name, od] = None
                continue
            assert math.isclose(r.cost, cost, rel_tol=1e-9)
            steps = [edges.loc[s.edge_id] for s in r.edge_route]
            assert steps[0].u == origin and steps[-1].v == goal and all(a.v == b.u for a, b in zip(steps, steps[1:]))
            length = sum(s.length_m for s in steps)
            counted = sum(rank.get(trips[s.edge_id], 50.0) * s.length_m for s in steps) / length
            cover = 100 * sum(s.length_m for s in steps if trips[s.edge_id] is not None) / length
            n = sum(abs(angle_of(a, b)) > 55 for a, b in zip(steps, steps[1:]))
            want[name, od] = (length, n, cover, counted)
    rows = scoring.score(known, net.pairs, solutions).collect()
    assert {(r.algorithm, r.od_id) for r in rows} == set(want)
    for r in rows:
        w, base = want[r.algorithm, r.od_id], want["shortest", r.od_id]
        assert (r.note == "no route") == (w is None)
        got = (r.length_m, r.turns, r.coverage_pct, r.popularity)
        assert got == (None,) * 4 if w is None else np.allclose(got, w, rtol=1e-9)
        assert math.isclose(r.counted, w[3] if w else 0.0, rel_tol=1e-9)
        assert r.detour_pct is None if w is None or base is None else math.isclose(r.detour_pct, 100 * (w[0] / base[0] - 1), abs_tol=1e-7)
    for s in scoring.summary(net.edges.sparkSession.createDataFrame(rows)).collect():
        own = [want[s.algorithm, od] for od, _, _ in pairs]
        assert abs(s.popularity - np.mean([w[3] if w else 0.0 for w in own])) <= 0.0501
        assert s.routes == f"{sum(w is not None for w in own)} of {len(own)}"
        assert (s.length_km is None) == (None in own)


def test_overlap_by_dense_points(spark, sf_dir, net):
    steps = relations.walks(spark, net).join(net.edges, "edge_id").select("algorithm", "od_id", "x0", "y0", "x1", "y1").toPandas()
    own = tracks.track_segments(places._kept(spark, sf_dir), "track_id", ["seq"]).toPandas()
    ts = np.linspace(0, 1, 101)
    c, d = own[["cx", "cy"]].to_numpy(), own[["dx", "dy"]].to_numpy()
    v = d - c
    vv = np.maximum((v * v).sum(axis=1), 1e-12)
    near = {}
    for key, rows in steps.groupby(["algorithm", "od_id"]):
        a, b = rows[["x0", "y0"]].to_numpy(), rows[["x1", "y1"]].to_numpy()
        p = (a[:, None] + (b - a)[:, None] * ts[None, :, None]).reshape(-1, 2)
        weight = np.repeat(np.hypot(*(b - a).T), len(ts))
        t = np.clip(((p[:, None] - c[None]) * v[None]).sum(axis=2) / vv, 0, 1)
        hit = np.hypot(*(p[:, None] - c[None] - t[:, :, None] * v[None]).transpose(2, 0, 1)) <= 30
        shares = {k: 100 * (weight * hit[:, (own.track == k).to_numpy()].any(axis=1)).sum() / weight.sum() for k in sorted(own.track.unique())}
        near[key] = (max(shares.values()), 100 * (weight * hit.any(axis=1)).sum() / weight.sum(), shares)
    found = catalog.QUERIES["q_gpx_overlap"](spark, sf_dir).collect()
    assert {(r.algorithm, r.od_id) for r in found} == set(near)
    for r in found:
        best, any_, shares = near[r.algorithm, r.od_id]
        assert abs(r.nearest_pct - best) < 1.5 and abs(r.any_pct - any_) < 1.5 and shares[r.ride] >= best - 1.5
    table = pd.DataFrame([r.asDict() for r in found]).groupby("algorithm")[["nearest_pct", "any_pct"]].mean()
    got = catalog.QUERIES["q_gpx_table"](spark, sf_dir).collect()
    assert all(abs(r.nearest_pct - table.nearest_pct[r.algorithm]) <= 0.5001 and abs(r.any_pct - table.any_pct[r.algorithm]) <= 0.5001 for r in got)
    assert [r.nearest_pct for r in got] == sorted((r.nearest_pct for r in got), reverse=True)


def test_split_keeps_blocks_whole(spark, sf_dir, net):
    blocks = {r.edge_id: r.block for r in learning.block_cells(net.edges, 250.0).collect()}
    measured = {r.edge_id for r in net.trips.collect()}
    parts = {r.edge_id: r.part for r in catalog.QUERIES["q_spatial_split"](spark, sf_dir).collect()}
    assert set(parts) == set(blocks) and all((parts[i] == "outside") == (i not in measured) for i in parts)
    of = defaultdict(set)
    for i in measured & set(parts):
        of[blocks[i]].add(parts[i])
    assert all(len(p) == 1 for p in of.values())
    n = Counter(p for s in of.values() for p in s)
    test = math.ceil(0.2 * len(of))
    assert n["test"] == test and n["validation"] == math.ceil(0.25 * (len(of) - test)) and n["train"] == len(of) - n["test"] - n["validation"]


def test_ridge_by_its_normal_equations(spark, sf_dir, net, edges):
    trips = {r.edge_id: r.trips for r in net.trips.collect()}
    x = np.array([[e.length_m, *features_of(e).values()] for e in edges.itertuples(index=False)])
    ids = edges.edge_id.to_numpy()
    on = np.array([i in trips for i in ids])
    y = np.array([math.log1p(trips.get(i, 0)) for i in ids])

    def fitted(rows):
        mean, std = x[rows].mean(axis=0), x[rows].std(axis=0, ddof=1)
        z = (x - mean) / np.where(std > 0, std, 1)
        w = np.linalg.solve(z[rows].T @ z[rows] + np.eye(z.shape[1]), z[rows].T @ (y[rows] - y[rows].mean()))
        return z @ w + y[rows].mean()

    got = catalog.QUERIES["q_ml_ridge_eval"](spark, sf_dir).toPandas().set_index("edge_id")
    want = pd.Series(fitted(on), index=ids).round(9).rank(pct=True)
    assert (got.ml_popularity[ids] - want).abs().max() < 0.02
    known = relations.labelled(net).filter("trips IS NOT NULL")
    part = {r.edge_id: r.part for r in learning.spatial_split(known, known, 250.0).collect()}
    check = np.array([part.get(i) == "validation" for i in ids])
    p, w = fitted(on & ~check)[check], edges.length_m.to_numpy()[check]
    a, b = p - np.average(p, weights=w), y[check] - np.average(y[check], weights=w)
    assert math.isclose(got.validation.iloc[0], (w * a * b).sum() / math.sqrt((w * a * a).sum() * (w * b * b).sum()), abs_tol=1e-4)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_regressors_learn(net, kind):
    rows = relations.labelled(net).withColumn("trips", F.when(F.col("length_m") > 100, 50).otherwise(2))
    model = learning.train_model(rows, kind, cell_m=250.0)
    far = model.predict_log_trips(rows).join(rows, "edge_id").select(F.avg(F.abs(F.col("prediction") - F.log1p("trips")))).first()[0]
    # The mean alone is about 1.4 away.
    assert far < 0.5


def test_ranks_are_shares(spark):
    rng = np.random.default_rng(1)
    values = [None if k % 17 == 0 else float(x) for k, x in enumerate(rng.integers(0, 60, 400))]
    got = learning.rank_pct(spark.createDataFrame(list(enumerate(values)), "i long, v double"), "v").toPandas().sort_values("i")
    want = pd.Series(values).rank(pct=True)
    assert np.allclose(got.rank_pct.to_numpy(float), want.to_numpy(float), equal_nan=True)


def toy(spark, arcs):
    rows = [(k, a, b, 0, float(c), 0.0, 0.0, 1.0, 1.0) for k, (a, b, c) in enumerate(arcs)]
    return spark.createDataFrame(rows, "edge_id long, u long, v long, key long, length_m double, x0 double, y0 double, x1 double, y1 double")


def test_cheapest_simple_paths(spark):
    rng = np.random.default_rng(2)
    arcs = [(a, b, float(rng.integers(10, 99) + rng.random())) for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.5]
    price = {(a, b): c for a, b, c in arcs}
    pairs = [("p1", 0, 6), ("p2", 3, 1), ("p3", 2, 2), ("p4", 0, 99)]
    got = defaultdict(list)
    for r in search.simple_paths(toy(spark, arcs), spark.createDataFrame(pairs, "od_id string, origin long, destination long"), 4).orderBy("od_id", "nth").collect():
        got[r.od_id].append((tuple(r.nodes), r.cost))
    for od, o, d in pairs[:2]:
        every = []
        for n in range(6):
            for mid in itertools.permutations([x for x in range(7) if x not in (o, d)], n):
                path = (o, *mid, d)
                if all(s in price for s in zip(path, path[1:])):
                    every.append((sum(price[s] for s in zip(path, path[1:])), path))
        want = sorted(every)[:4]
        assert [p for p, _ in got[od]] == [p for _, p in want] and np.allclose([c for _, c in got[od]], [c for c, _ in want])
    assert not got["p3"] and not got["p4"]


def test_traversals_are_trees(spark, sf_dir, edges):
    out = defaultdict(set)
    for e in edges.itertuples(index=False):
        out[e.u].add(e.v)
    depth, front = {21: 0}, [21]
    while front:
        front = [b for a in front for b in sorted(out[a]) if b not in depth and not depth.__setitem__(b, depth[a] + 1)]
    for kind, rows in catalog.QUERIES["q_traversal_trees"](spark, sf_dir).toPandas().groupby("kind"):
        nth = rows.set_index("node").nth.to_dict()
        parent = {r.node: None if pd.isna(r.parent) else int(r.parent) for r in rows.itertuples()}
        assert set(parent) == set(depth) and sorted(nth.values()) == list(range(len(depth))) and nth[21] == 0
        assert all(p is None and n == 21 or (n in out[p] and nth[p] < nth[n]) for n, p in parent.items())
        if kind == "bfs":
            assert all(depth[n] == depth[p] + 1 for n, p in parent.items() if p is not None)
            assert [depth[n] for n in sorted(nth, key=nth.get)] == sorted(depth.values())
        else:
            # A node's parent is the last one before it that leads on to it.
            order = sorted(nth, key=nth.get)
            chain = []
            for n in order:
                while chain and chain[-1] != parent[n]:
                    chain.pop()
                assert n == 21 or chain
                chain.append(n)


def test_small_and_large_graphs_agree(spark):
    rng = np.random.default_rng(3)
    arcs = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 25, (40, 2))]
    e = toy(spark, arcs)
    reach = {n: {n} for a, b, _ in arcs for n in (a, b)}
    for _ in range(30):
        for a, b, _ in arcs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    assert dict(map(tuple, network.strong_components(e).collect())) == want
    assert dict(map(tuple, network.strong_components(e, small=0).collect())) == want
    asked = spark.createDataFrame([(arcs[0][0],), (arcs[5][0],), (777,)], "source long")
    a, b = (sorted(map(tuple, network.bfs_hops(e, asked, small=s).collect())) for s in (0, 100))
    assert a == b and {n for s, n, _ in a if s == arcs[0][0]} == reach[arcs[0][0]]


def test_edges_are_numbered_in_order(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(rng.integers(0, 50, (300, 2)))]
    got = network.with_edge_id(spark.createDataFrame(rows, "u long, v long, key long")).collect()
    assert [(r.u, r.v, r.key) for r in sorted(got, key=lambda r: r.edge_id)] == sorted(rows) and {r.edge_id for r in got} == set(range(300))


def test_preview_shows_costs(spark, sf_dir, edges):
    rows = catalog.QUERIES["q_preview_cost"](spark, sf_dir).collect()
    assert 0 < len(rows) <= 5 and len({r.edge_id for r in rows}) == len(rows)
    for r in rows:
        e = edges.loc[r.edge_id]
        assert {k: r[k] for k in relations.WEIGHTS} == features_of(e)
        assert abs(r.factor - felt(e) / e.length_m) <= 0.00501 and abs(r.felt_m - felt(e)) <= 0.0501 and abs(r.length_m - e.length_m) <= 0.0501
    assert all(any(r[k] for r in rows) for k in relations.WEIGHTS)


def test_examples_fill_every_column(spark, sf_dir, edges):
    columns = relations._COLUMNS
    filled = {e.edge_id: {c for c in columns if getattr(e, c) is not None and getattr(e, c) == getattr(e, c)} for e in edges.itertuples(index=False)}
    left, want = set().union(*filled.values()), []
    while left:
        i = min(filled, key=lambda k: (-len(filled[k] & left), -len(filled[k]), k))
        want.append(i)
        left -= filled[i]
    assert [r.edge_id for r in catalog.QUERIES["q_example_rows"](spark, sf_dir).orderBy("nth").collect()] == want


def test_payload_of_every_edge(spark, sf_dir, net, edges):
    codes = {r.edge_id: [r.popularity, r.bike, r.road, r.surface, r.lit, r.speed] for r in catalog.QUERIES["q_map_codes"](spark, sf_dir).collect()}
    got = {r.edge_id: json.loads(r.json) for r in catalog.QUERIES["q_payload_json"](spark, sf_dir).collect()}
    assert set(got) == set(edges.edge_id)
    for i, x in got.items():
        e = edges.loc[i]
        assert np.allclose(x["line"], [[e.y0, e.x0], [e.y1, e.x1]], atol=1e-5) and x["codes"] == codes[i]


# networks with lines


BENT = {1: (0.0, 0.0), 2: (100.0, 0.0), 3: (100.0, 200.0)}


@pytest.fixture(scope="module")
def bent(spark):
    nodes = network.make_nodes(spark, BENT)
    records = [
        {"u": 1, "v": 2, "geometry": [(0, 0), (0, 50), (100, 50), (100, 0)], "highway": "path;cycleway"},
        {"u": 2, "v": 1, "geometry": [(100, 0), (100, 50), (0, 50), (0, 0)]},
        {"u": 2, "v": 3},
    ]
    return network.with_edge_id(network.validate_edges(network.make_edges(spark, records, nodes)))


def test_lines_of_edges(spark, bent):
    rows = {(r.u, r.v): r for r in turns.with_bearings(bent).collect()}
    assert rows[1, 2].length_m == 200 and rows[2, 3].length_m == 200 and rows[1, 2].highway == "cycleway;path"
    assert (rows[1, 2].first, rows[1, 2].last) == (0.0, 180.0) and (rows[2, 1].first, rows[2, 1].last) == (0.0, 180.0) and rows[2, 3].first == 0.0
    pairs = {(r.from_edge, r.to_edge): r.kind for r in turns.turn_pairs(bent).collect()}
    i = {k: r.edge_id for k, r in rows.items()}
    assert pairs == {(i[1, 2], i[2, 1]): "u_turn", (i[1, 2], i[2, 3]): "u_turn", (i[2, 1], i[1, 2]): "u_turn"}
    s = spatial.segments(bent).collect()
    assert len(s) == 7 and sum(math.hypot(r.ex - r.sx, r.ey - r.sy) for r in s) == 600
    assert {r.edge_id for r in spatial.bbox_slice(bent, 40, 40, 60, 60).collect()} == {i[1, 2], i[2, 1]}
    blocks = {r.edge_id: r.block for r in learning.block_cells(bent, 40.0).collect()}
    assert blocks == {i[1, 2]: "1:1", i[2, 1]: "1:1", i[2, 3]: "2:2"}


@pytest.mark.parametrize(("at", "first"), [((0, 0), (0, 0)), ((9, 9), (10, 10)), ((5, 5), (0, 0))])
def test_lines_begin_near_their_node(spark, at, first):
    from trailforge.functions import geometry as G

    line = F.array(*[G.point(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (3, 9), (10, 10))])
    got = spark.range(1).select(G.orient(line, F.lit(float(at[0])), F.lit(float(at[1]))).alias("l")).first().l
    assert (got[0].x, got[0].y) == first and len(got) == 3 and (got[1].x, got[1].y) == (3, 9)


def test_what_maps_show(spark, bent):
    pairs = spark.createDataFrame([("AB07", 1, 3)], "od_id string, origin long, destination long")
    routes = search.find_routes(bent, pairs)
    label = report.pair_labels(routes, bent).first()
    assert (label.label, label.x, label.y) == ("07", 100.0, 0.0)
    ids = {(r.u, r.v): r.edge_id for r in bent.collect()}
    drawn = {r.layer: (r["count"], json.loads(r.json)) for r in report.layers(bent, {"long": (F.col("length_m") > 1, "red"), "none": (F.lit(None).cast("boolean"), "blue")}).collect()}
    assert drawn == {"long": (3, sorted(ids.values())), "none": (0, [])}
    whole = report.explorer(bent.withColumn("popularity", F.lit(10.0)), routes, {"all": (F.lit(True), "red")}, ["length_m"], ["highway"]).collect()
    assert Counter(r.section for r in whole) == {"edges": 3, "routes": 1, "layers": 1, "domains": 2}
    assert json.loads(next(r.json for r in whole if r.section == "routes"))["edges"] == [ids[1, 2], ids[2, 3]]
    with pytest.raises(ValueError, match="leaves"):
        report.explorer(bent.filter("u = 1"), routes, {}, [], [])
    own = spark.createDataFrame([(ids[1, 2], 5.0, "mine")], "edge_id long, own double, highway string")
    done = {r.edge_id: (r.length_m, r.own, r.highway) for r in report.completed(bent, own, ["length_m", "highway"]).collect()}
    assert done == {ids[1, 2]: (200.0, 5.0, "mine"), ids[2, 1]: (200.0, None, None), ids[2, 3]: (200.0, None, None)}


def test_close_up(spark, bent):
    points = spark.createDataFrame([(1, 50.0, 55.0), (2, 52.0, 55.0), (3, 104.0, 100.0)], "point_id long, x double, y double")
    got = spatial.nearby(bent, points, 10.0).collect()
    ids = {(r.u, r.v): r.edge_id for r in bent.collect()}
    assert [(r.point_id, r.edge_id, r.distance) for r in got] == [(3, ids[2, 3], 4.0)]


def test_bad_edges_are_refused(spark):
    nodes = network.make_nodes(spark, BENT)
    good = network.make_edges(spark, [{"u": 1, "v": 2}], nodes)
    for bad in (good.withColumn("trips", F.lit(1)), good.withColumn("length_m", F.lit(0.0)), good.unionByName(good), good.drop("lit"), good.withColumn("key", F.lit("0"))):
        with pytest.raises(ValueError):
            network.validate_edges(bad)
