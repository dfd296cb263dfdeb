"""Turns: pairs of edges where one ends and the next begins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.functions import geometry as G

KINDS = ("straight", "slight", "right", "left", "u_turn")
#: Kinds that count as a turn of a route.
COUNTED = ("left", "right", "u_turn")


@dataclass(frozen=True)
class TurnModel:
    """Penalties in metres by kind of turn, and the angles that tell the kinds apart."""

    straight: float = 0.0
    slight: float = 0.0
    right: float = 0.0
    left: float = 0.0
    u_turn: float = 0.0
    straight_most: float = G.STRAIGHT_MOST
    slight_most: float = G.SLIGHT_MOST
    u_turn_least: float = G.U_TURN_LEAST

    def kind(self, angle: Column) -> Column:
        return G.turn_kind(angle, self.straight_most, self.slight_most, self.u_turn_least)

    def penalty(self, kind: Column) -> Column:
        cases = F.lit(None).cast("double")
        for k in KINDS:
            cases = F.when(kind == k, float(getattr(self, k))).otherwise(cases)
        return cases


_MODELS: dict[str, object] = {"none": None, "default": TurnModel()}


def register_turn_model(name: str, model) -> None:
    """Make a model known by name: a TurnModel, a mapping of its fields, or a function (pairs) -> Column of metres."""
    _MODELS[name] = turn_model(model)


def turn_model(model) -> TurnModel | Callable[[DataFrame], Column] | None:
    """A model by name, from a mapping, or as it is; None: turns cost nothing and are not looked at."""
    if isinstance(model, str):
        if model not in _MODELS:
            raise ValueError(f"no turn model {model!r}; there are {sorted(_MODELS)}")
        return _MODELS[model]
    if isinstance(model, Mapping):
        if unknown := set(model) - {f.name for f in fields(TurnModel)}:
            raise ValueError(f"a turn model has no {sorted(unknown)}")
        return TurnModel(**(asdict(TurnModel()) | dict(model)))
    return model


def with_bearings(edges: DataFrame) -> DataFrame:
    """Edges (with geometry, or x0, y0, x1, y1) with first and last, the bearings of their ends."""
    if "geometry" in edges.columns:
        first, last = G.edge_bearings(F.col("geometry"))
        return edges.withColumns({"first": first, "last": last})
    only = G.bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return edges.withColumns({"first": only, "last": only})


def turn_pairs(edges: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """(from_edge, to_edge, angle, kind, penalty): every edge with every edge that begins at its end, itself back included."""
    model = model or TurnModel()
    b = with_bearings(edges)
    a = b.select(F.col("edge_id").alias("from_edge"), F.col("v").alias("at"), F.col("last"))
    c = b.select(F.col("edge_id").alias("to_edge"), F.col("u").alias("at"), F.col("first"))
    pairs = a.join(c, "at").withColumn("angle", G.turn_angle(F.col("last"), F.col("first")))
    pairs = pairs.withColumn("kind", model.kind(F.col("angle")))
    return pairs.select("from_edge", "to_edge", "angle", "kind", model.penalty(F.col("kind")).alias("penalty"))


def count_turns(steps: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per route (keys) the number of left, right and u-turns, by the standard angles; steps: keys, pos, edge_id."""
    from pyspark.sql import Window

    b = with_bearings(edges).select("edge_id", "first", "last")
    order = Window.partitionBy(*keys).orderBy("pos")
    own = steps.join(b, "edge_id").withColumn("next", F.lead("first").over(order))
    turn = F.when(F.col("next").isNotNull(), G.turn_kind(G.turn_angle(F.col("last"), F.col("next"))).isin(*COUNTED).cast("int")).otherwise(0)
    return own.groupBy(*keys).agg(F.sum(turn).cast("int").alias("turns"))


def turn_examples(edges: DataFrame, preferred: Column) -> DataFrame:
    """The clearest example of each kind: kind, from_edge, to_edge, and for sides a second edge.

    preferred: which edges make good pictures. Edges under 45 m and others than
    the preferred count against an example, as does the distance from the
    kind's typical angle.
    """
    b = edges.withColumn("poor", F.when(preferred, 0).otherwise(1000) + F.greatest(F.lit(0.0), 45 - F.col("length_m")))
    ends = b.select("edge_id", "u", "v", "poor")
    pairs = turn_pairs(edges).join(ends.select(F.col("edge_id").alias("from_edge"), F.col("u").alias("fu"), F.col("poor").alias("fp")), "from_edge")
    pairs = pairs.join(ends.select(F.col("edge_id").alias("to_edge"), F.col("v").alias("tv"), F.col("poor").alias("tp")), "to_edge")
    a, back = F.abs("angle"), F.col("fu") == F.col("tv")
    single = pairs.withColumn("sample", F.when((a <= 25) & ~back, "straight").when((a > 25) & (a <= 55), "slight").when((a >= 150) & back, "u_turn")).filter("sample is not null")
    off = F.when(F.col("sample") == "straight", a).when(F.col("sample") == "slight", F.abs(a - 40)).otherwise(F.abs(a - 180))
    best = single.withColumn("score", F.col("fp") + F.col("tp") + off).groupBy("sample").agg(F.min(F.struct("score", "from_edge", "to_edge")).alias("b"))
    best = best.select(F.col("sample").alias("kind"), "b.from_edge", "b.to_edge", F.lit(None).cast("long").alias("other_edge"))
    side = lambda low, high, goal, name: pairs.filter((F.col("angle") > low) & (F.col("angle") < high)).groupBy("from_edge").agg(F.min(F.struct((F.col("tp") + F.abs(F.col("angle") - goal)).alias("score"), F.col("to_edge"), F.col("fp"))).alias(name))
    both = side(55, 150, 90, "r").join(side(-150, -55, -90, "l"), "from_edge")
    both = both.agg(F.min(F.struct((F.col("r.score") + F.col("l.score") + F.col("r.fp")).alias("score"), F.col("from_edge"), F.col("r.to_edge").alias("to_edge"), F.col("l.to_edge").alias("other_edge"))).alias("b"))
    both = both.filter("b is not null").select(F.lit("sides").alias("kind"), "b.from_edge", "b.to_edge", "b.other_edge")
    return best.unionByName(both)
