"""Tables of places: CSV, GeoJSON, GeoParquet, and catalogues by category."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.operators.network import LINE
from trailforge.sources import files


def checked_lonlat(df: DataFrame) -> DataFrame:
    """df with lon and lat as numbers and valid: both finite and within their ranges."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    out = df.withColumns({"lon": number("lon"), "lat": number("lat")})
    return out.withColumn("valid", F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~F.isnan("lon") & ~F.isnan("lat"), F.lit(False)))


def _all_valid(df: DataFrame) -> DataFrame:
    out = checked_lonlat(df)
    if not out.filter("NOT valid").isEmpty():
        raise ValueError("lon and lat must be numbers within -180..180 and -90..90")
    return out.drop("valid")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with columns lon and lat."""
    return _all_valid(scan_csv(spark, path))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with columns lon and lat, as texts; for checked_lonlat()."""
    df = spark.read.csv(path, header=True)
    if missing := {"lon", "lat"} - set(df.columns):
        raise ValueError(f"the file lacks {sorted(missing)}")
    return df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Points and multipoints of a GeoJSON feature collection: lon, lat, properties (a map of texts)."""
    schema = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties")
    if not rows.filter(~F.col("type").isin("Point", "MultiPoint") | F.col("type").isNull()).isEmpty():
        raise ValueError("points and multipoints only")
    many = F.when(F.col("type") == "Point", F.array(F.from_json("coordinates", "array<double>"))).otherwise(F.from_json("coordinates", "array<array<double>>"))
    return _all_valid(rows.select("properties", F.explode(many).alias("c")).select(F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"), "properties"))


@F.pandas_udf(T.ArrayType(LINE))
def wkb_parts(raw: pd.Series) -> pd.Series:
    """Well-known binary as a list of parts."""
    from trailforge.functions.lines import from_wkb

    return raw.map(lambda b: None if b is None else [[{"x": x, "y": y} for x, y in part] for part in from_wkb(bytes(b))])


@F.pandas_udf(T.BinaryType())
def as_wkb(lines: pd.Series) -> pd.Series:
    """Lines (or points, as lines of one) as well-known binary."""
    from trailforge.functions.lines import to_wkb

    return lines.map(lambda p: None if p is None else to_wkb([(q["x"], q["y"]) for q in p]))


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """A Parquet file with points in well-known binary: x, y and the other columns."""
    df = spark.read.parquet(path)
    rows = df.withColumn("__p", F.explode(wkb_parts(column)))
    if not rows.filter(F.size("__p") != 1).isEmpty():
        raise ValueError("points and multipoints only")
    return rows.select(F.col("__p")[0]["x"].alias("x"), F.col("__p")[0]["y"].alias("y"), *[c for c in df.columns if c != column])


def by_category(points: DataFrame, categories: list[str]) -> DataFrame:
    """The points of some categories."""
    return points.filter(F.col("type").isin(categories))


def save_catalog(points: DataFrame, folder: str, categories: list[str], source: str, complete: bool = True, **metadata) -> dict:
    """Write a catalogue (type, point_id, ...) with its manifest; the old one stays until the new one is whole."""
    spark = points.sparkSession
    if not points.filter(~F.coalesce(F.col("type").isin(categories), F.lit(False))).isEmpty():
        raise ValueError("a point has an unknown category")
    if not points.groupBy("type", "point_id").count().filter("count > 1").isEmpty():
        raise ValueError("points repeat")
    draft = f"{folder}/points/.draft-{uuid.uuid4().hex}"
    points.write.partitionBy("type").parquet(draft)
    digest = files.table_digest(spark, draft)
    files.replace(spark, draft, f"{folder}/points/points.parquet")
    manifest = {"format_version": 1, "categories": list(categories), "source": source, "complete": complete, "sha256": digest, **metadata}
    files.write_json(spark, f"{folder}/points/manifest.json", manifest)
    return manifest


def load_catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, dict] | None:
    """A catalogue and its manifest; None if there is none. Reading some types reads their files alone."""
    if not files.exists(spark, f"{folder}/points/manifest.json"):
        return None
    manifest = files.read_json(spark, f"{folder}/points/manifest.json")
    if manifest.get("format_version") != 1 or files.table_digest(spark, f"{folder}/points/points.parquet") != manifest["sha256"]:
        raise ValueError("the catalogue has changed")
    return spark.read.parquet(f"{folder}/points/points.parquet"), manifest
