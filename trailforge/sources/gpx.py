"""GPX files as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.operators import tracks

SCHEMA = "trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, time: TIMESTAMP>>>>>>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """A row a point: file, activity_id (<file stem>:T<track>:S<segment>), seq, x, y, ele, t (seconds, null without a time), name (the track's, or null).

    A file is one document with one root; one that is not is an error.
    """
    raw = spark.read.format("xml").option("rowTag", "gpx").option("mode", "FAILFAST").schema(SCHEMA).load(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    track = raw.select("file", F.posexplode("trk").alias("ti", "t"))
    segment = track.select("file", "ti", F.col("t.name").alias("name"), F.posexplode("t.trkseg").alias("si", "s"))
    point = segment.select("file", "ti", "si", F.col("name").alias("track_name"), F.posexplode("s.trkpt").alias("seq", "p"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    activity = F.concat(stem, F.lit(":T"), F.col("ti") + 1, F.lit(":S"), F.col("si") + 1)
    return point.select("file", activity.alias("activity_id"), F.col("seq").cast("long").alias("seq"), F.col("p._lon").alias("x"), F.col("p._lat").alias("y"), F.col("p.ele").alias("ele"), (F.unix_micros("p.time") / 1e6).alias("t"), F.col("track_name").alias("name"))


def load_tracks(spark: SparkSession, path: str, rules: tracks.Rules | None = None) -> DataFrame:
    """Cleaned tracks, a row a part: file, activity_id, part, geometry."""
    kept = tracks.clean(read_gpx(spark, path), ["file", "activity_id"], rules)
    return tracks.lines(kept, ["file", "activity_id"])
