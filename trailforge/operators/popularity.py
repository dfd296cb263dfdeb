"""Length-weighted popularity: where a street's trips stand among all measured metres of street, 0 to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a street without a measurement counts as in a route.
UNKNOWN = 50.0


def _finite(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def align_labels(edges: DataFrame, labels: DataFrame, value: str = "trips", check: bool = True) -> DataFrame:
    """Edges with their label by edge_id, null where there is none; labels must be unique, finite and 0 or more."""
    if check:
        # One pass over the labels: the keys are counted and the values tested together.
        keys = labels.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col(value).isNotNull() & (_finite(value).isNull() | (F.col(value) < 0))).alias("bad"))
        found = keys.agg(F.bool_or("bad").alias("bad"), F.max("n").alias("n")).first()
        if found.bad:
            raise ValueError(f"{value} must be finite and 0 or more")
        if (found.n or 0) > 1:
            raise ValueError("labels repeat an edge_id")
    return edges.join(labels.select("edge_id", value), "edge_id", "left")


def fit_scale(rows: DataFrame, value: str = "trips", length: str = "length_m") -> DataFrame:
    """The scale, a row a distinct value: value, mass (its share of all length), before (the mass below)."""
    known = rows.select(_finite(value).alias("value"), F.col(length).cast("double").alias("length")).filter("value is not null")
    sums = known.groupBy("value").agg(F.sum("length").alias("length"))
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # One row a distinct value: small beside the rows that it stands for.
    return sums.select("value", (F.col("length") / F.sum("length").over(everything)).alias("mass"), (F.coalesce(F.sum("length").over(order), F.lit(0.0)) / F.sum("length").over(everything)).alias("before"))


def apply_scale(rows: DataFrame, scale: DataFrame, value: str = "trips", to: str = "popularity") -> DataFrame:
    """rows with their mid-rank on a scale fitted on these or other rows; null for values that are missing or not finite, and for all on an empty scale.

    The distinct values are looked up by a window over them and the scale's,
    and joined back; rows are neither ordered nor compared with the scale.
    """
    asked = rows.select(_finite(value).alias("value")).filter("value is not null").distinct()
    both = asked.select("value", F.lit(None).cast("double").alias("mass"), F.lit(None).cast("double").alias("before"), F.lit(1).alias("ask"))
    both = both.unionByName(scale.select("value", "mass", "before", F.lit(0).alias("ask")))
    order = Window.orderBy("value", "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("ask") == 0, F.struct("value", "mass", "before")), ignorenulls=True).over(order)
    fitted = F.min("ask").over(Window.partitionBy()) == 0
    found = both.withColumns({"at": last, "fitted": fitted}).filter("ask = 1")
    same = F.col("at.value") == F.col("value")
    rank = F.when(~F.col("fitted"), F.lit(None)).when(F.col("at").isNull(), 0.0).when(same, 50 * (2 * F.col("at.before") + F.col("at.mass"))).otherwise(100 * (F.col("at.before") + F.col("at.mass")))
    found = found.select(F.col("value").alias("__v"), rank.alias(to))
    return rows.join(found, _finite(value) == F.col("__v"), "left").drop("__v")


def popularity(rows: DataFrame, value: str = "trips", length: str = "length_m", to: str = "popularity") -> DataFrame:
    """rows with their mid-rank among themselves."""
    return apply_scale(rows, fit_scale(rows, value, length), value, to)


def layers(rows: DataFrame, hidden: str | None = None):
    """Rows with layer (hidden, unknown or known) and the order in which known ones are drawn."""
    away = F.col(hidden) if hidden else F.lit(False)
    layer = F.when(F.coalesce(away, F.lit(False)), "hidden").when(F.col("popularity").isNull(), "unknown").otherwise("known")
    return rows.withColumn("layer", layer)
