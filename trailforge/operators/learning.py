"""Blocks, splits, models of trips, and how good they are."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailforge.functions import geometry as G
from trailforge.operators.costs import feature_table, features
from trailforge.operators.lineage import settled


def block_cells(edges: DataFrame, cell_m: float = 1000.0) -> DataFrame:
    """edge_id and block ("x:y"): the cell of the mean midpoint of all edges between the same two nodes, either way."""
    if not math.isfinite(cell_m) or cell_m <= 0:
        raise ValueError("a cell's side is finite and over 0")
    mid = G.interpolate("geometry") if "geometry" in edges.columns else G.point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    own = edges.select("edge_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), mid.alias("m"))
    street = Window.partitionBy("a", "b")
    cell = lambda c: F.floor(F.avg(F.col("m")[c]).over(street) / cell_m).cast("string")
    return own.select("edge_id", F.concat_ws(":", cell("x"), cell("y")).alias("block"))


def split_groups(groups: list[str], seed: int = 42) -> dict[str, str]:
    """train, validation or test for each group: a fifth of them test, of the rest a quarter validation."""
    groups = sorted(set(groups))
    if len(groups) < 5:
        raise ValueError("at least five blocks are needed")

    def parted(names, share, s):
        order = np.random.RandomState(s).permutation(len(names))
        n = math.ceil(share * len(names))
        out = {names[i] for i in order[:n]}
        return [x for x in names if x not in out], sorted(out)

    rest, test = parted(groups, 0.2, seed)
    train, validation = parted(rest, 0.25, seed + 1)
    return dict.fromkeys(train, "train") | dict.fromkeys(validation, "validation") | dict.fromkeys(test, "test")


def spatial_split(edges: DataFrame, eligible: DataFrame, cell_m: float = 1000.0, seed: int = 42) -> DataFrame:
    """edge_id and part: train, validation, test, or outside for edges that are not eligible (a table of edge_id).

    Blocks are formed of all edges before those are set aside. The driver draws
    them, a name a cell of the area.
    """
    blocks = block_cells(edges, cell_m).join(eligible.select("edge_id", F.lit(True).alias("__in")), "edge_id", "left")
    names = [r[0] for r in blocks.filter("__in").select("block").distinct().collect()]
    parts = F.broadcast(edges.sparkSession.createDataFrame(list(split_groups(names, seed).items()), "block string, part string"))
    return blocks.join(parts, "block", "left").select("edge_id", F.when(F.col("__in"), F.col("part")).otherwise("outside").alias("part"))


def rank_pct(df: DataFrame, value: str, to: str = "rank_pct") -> DataFrame:
    """The rank of a value among all, ties by their mean, as a share of the count.

    Distinct values are counted first. Ranges of them are summed side by side;
    only the ranges' sums, one a partition, are ordered in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = settled(counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum("n").alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("__p").alias("__q"), ahead.alias("ahead"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("inside", inside).join(F.broadcast(sums), F.col("__p") == F.col("__q"))
    ranks = ranks.select("__v", ((F.col("ahead") + F.col("inside") + (F.col("n") + 1) / 2) / F.col("total")).alias(to))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def weighted_corr(df: DataFrame, x: str, y: str, w: str, to: str = "corr") -> DataFrame:
    """One row: the weighted Pearson correlation over rows where all three are finite and the weight over 0; null below two rows or without spread."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    good = df.filter(finite(x) & finite(y) & finite(w) & (F.col(w) > 0)).select(*[F.col(c).cast("double").alias(k) for c, k in ((x, "x"), (y, "y"), (w, "w"))])
    means = good.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("px"), (F.max("y") - F.min("y")).alias("py"))
    both = good.crossJoin(F.broadcast(means))  # one row
    a, b = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = both.agg(F.sum(F.col("w") * a * b).alias("c"), F.sum(F.col("w") * a * a).alias("vx"), F.sum(F.col("w") * b * b).alias("vy"), F.max("n").alias("n"), F.max("px").alias("px"), F.max("py").alias("py"))
    some = (F.col("n") >= 2) & (F.col("px") > 0) & (F.col("py") > 0) & (F.col("vx") * F.col("vy") > 0)
    return sums.select(F.when(some, F.col("c") / F.sqrt(F.when(F.col("vx") * F.col("vy") > 0, F.col("vx") * F.col("vy")))).alias(to))


def regressor(kind: str, columns: list[str], label: str = "y", n: int | None = None, seed: int = 42, **options):
    """An estimator by name: dummy (the mean), ridge, tree, forest or boosted; missing features take the median."""
    if kind == "dummy":
        return MeanOf(label)
    filled = [f"{c}__" for c in columns]
    head = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep")]
    common = {"labelCol": label, "featuresCol": "raw", "predictionCol": "prediction"}
    if kind == "ridge":
        alpha = options.pop("alpha", 1.0)
        scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
        fit = LinearRegression(**common | {"featuresCol": "scaled"}, elasticNetParam=0.0, regParam=alpha / max(1, n or 1), standardization=False, **options)
        return Pipeline(stages=[*head, scaled, fit])
    kinds = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosted": GBTRegressor}
    if kind not in kinds:
        raise ValueError(f"no model {kind!r}; there are {['dummy', 'ridge', *kinds]}")
    return Pipeline(stages=[*head, kinds[kind](**common, seed=seed, **options)])


class MeanOf:
    """An estimator that predicts the mean of the label."""

    def __init__(self, label: str = "y"):
        self.label = label

    def fit(self, df: DataFrame):
        return Constant(df.agg(F.avg(self.label)).first()[0])


class Constant(Transformer):
    def __init__(self, value: float):
        super().__init__()
        self.value = value

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value).cast("double"))


class TrainedModel:
    """A fitted model with the features that it needs."""

    def __init__(self, model, make: Callable, validation: float | None):
        self.model, self.make, self.validation = model, make, validation

    def predict_log_trips(self, edges: DataFrame) -> DataFrame:
        """edge_id and prediction (the logarithm of 1 + trips)."""
        return self.model.transform(feature_table(edges, self.make)).select("edge_id", "prediction")

    def feature(self, edges: DataFrame) -> DataFrame:
        """edge_id and ml_popularity: the prediction's rank as a share, to be used as a feature."""
        return rank_pct(self.predict_log_trips(edges), "prediction", "ml_popularity").select("edge_id", "ml_popularity")


def train_model(edges: DataFrame, train: str | Callable = "ridge", make: Callable = features, seed: int = 42, cell_m: float = 1000.0) -> TrainedModel:
    """Fit the logarithm of 1 + trips on all measured edges; before that, on all but the validation blocks, to measure it on those.

    train: a name for regressor(), or a function (columns, rows) -> estimator with
    fit(df) whose model has transform(df) with a column prediction. Below five
    blocks the measurement is left out.
    """
    known = edges.filter(F.col("trips").isNotNull())
    table = feature_table(edges, make).join(known.select("edge_id", F.log1p("trips").alias("y"), F.col("length_m").alias("w")), "edge_id")
    columns = [c for c in feature_table(edges, make).columns if c != "edge_id"]
    build = (lambda n: regressor(train, columns, n=n, seed=seed)) if isinstance(train, str) else (lambda n: train(columns, n))
    corr = None
    try:
        # The measurement's blocks are those of the measured edges alone.
        held = spatial_split(known, known, cell_m, seed)
    except ValueError:
        held = None
    if held is not None:
        tagged = table.join(held, "edge_id").persist()
        seen, check = tagged.filter(F.col("part") != "validation"), tagged.filter(F.col("part") == "validation")
        if not check.isEmpty() and not seen.isEmpty():
            model = build(seen.count()).fit(seen)
            corr = weighted_corr(model.transform(check), "prediction", "y", "w").first()[0]
    return TrainedModel(build(table.count()).fit(table), make, corr)
