"""City packs: a network with pairs, labels and, if there are any, tracks, as Parquet with a manifest of digests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.operators.network import TARGETS, with_edge_id
from trailforge.operators.popularity import align_labels
from trailforge.sources import files

FORMAT = 2


@dataclass
class City:
    """A pack's relations; edges have trips (null: not measured) and test_area."""

    folder: str
    edges: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    labels: DataFrame
    manifest: dict
    tracks: DataFrame | None = None


def write_pack(spark: SparkSession, folder: str, city: str, edges: DataFrame, nodes: DataFrame, pairs: DataFrame, labels: DataFrame, tracks: DataFrame | None = None, split: dict | None = None, zone: str = "zone") -> dict:
    """Write a pack and return its manifest.

    edges get dense ids in the order of (u, v, key); labels (u, v, key, trips)
    follow them. Rows whose zone, where there is such a column, is not open are
    left out of pairs; edges must be open throughout. Cached routes of an older
    pack are removed.
    """
    if TARGETS & set(edges.columns):
        raise ValueError("edges must not have columns of the target")
    if zone in edges.columns:
        if not edges.filter(~F.col(zone).eqNullSafe(F.lit("open"))).isEmpty():
            raise ValueError("only open data can be saved")
        edges = edges.drop(zone)
    if zone in pairs.columns:
        pairs = pairs.filter(F.col(zone) == "open").drop(zone)
    out = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    numbered = with_edge_id(edges)
    out(numbered.select("edge_id", *edges.columns), "roads")
    stored = spark.read.parquet(f"{folder}/roads.parquet").select("edge_id", "u", "v", "key")
    out(labels.filter("trips IS NOT NULL").join(stored, ["u", "v", "key"]).select("edge_id", "trips"), "labels")
    out(nodes, "nodes")
    out(pairs, "pairs")
    names = ["roads", "nodes", "pairs", "labels"]
    if tracks is not None:
        out(tracks, "tracks")
        names.append("tracks")
    digests = {f"{n}.parquet": files.table_digest(spark, f"{folder}/{n}.parquet") for n in names}
    count = lambda n: spark.read.parquet(f"{folder}/{n}.parquet").count()
    manifest = {
        "format_version": FORMAT,
        "dataset_id": hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()[:16],
        "city": city,
        "files": digests,
        "roads": count("roads"),
        "nodes": count("nodes"),
        "open_pairs": count("pairs"),
        "open_labels": count("labels"),
        "split": split,
        "label_policy": "null = not measured; an explicit zero is kept; labels of the closed zone are withheld",
    }
    files.write_json(spark, f"{folder}/manifest.json", manifest)
    files.delete(spark, f"{folder}/route_cache")
    return manifest


def load_pack(spark: SparkSession, folder: str) -> City:
    """Read a pack; ValueError if a file has changed, a target leaks, or a closed area has labels."""
    if not files.exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"{folder} has no manifest")
    manifest = files.read_json(spark, f"{folder}/manifest.json")
    if manifest.get("format_version") != FORMAT:
        raise ValueError("the pack has another format")
    for name, digest in manifest["files"].items():
        if files.table_digest(spark, f"{folder}/{name}") != digest:
            raise ValueError(f"{name} has changed")
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    edges, nodes, labels = read("roads"), read("nodes"), read("labels")
    if TARGETS & (set(edges.columns) | set(nodes.columns)):
        raise ValueError("edges and nodes must not have columns of the target")
    edges = align_labels(edges, labels)
    if "test_area.parquet" in manifest["files"]:
        area = read("test_area")
        edges = edges.join(area.select("edge_id", "test_area"), "edge_id", "left").withColumn("test_area", F.coalesce("test_area", F.lit(False)))
        if not edges.filter(F.col("test_area") & F.col("trips").isNotNull()).isEmpty():
            raise ValueError("the closed area has labels")
    else:
        edges = edges.withColumn("test_area", F.lit(False))
    tracks = read("tracks") if "tracks.parquet" in manifest["files"] else None
    return City(folder, edges, nodes, read("pairs"), labels, manifest, tracks)


def cached_routes(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """Routes by the key of what they are made from: read if they are there, else built, written and read."""
    place = f"{folder}/route_cache/{hashlib.sha256(key.encode()).hexdigest()}"
    if not files.exists(spark, f"{place}/_SUCCESS"):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def cache_key(*parts) -> str:
    """A key for cached_routes: of each part its own cache_key() where it has one, else its pickled form."""
    from pyspark import cloudpickle

    out = []
    for p in parts:
        own = getattr(p, "cache_key", None)
        out.append(str(own()) if callable(own) else p if isinstance(p, str) else hashlib.sha256(cloudpickle.dumps(p)).hexdigest())
    return "\n".join(out)


def export_bundle(path: str, solutions: dict, manifest: dict, files_: dict[str, bytes] | None = None, requirements: tuple[str, ...] = ()) -> str:
    """A zip with the solutions (pickled), the pack's manifest, the versions in use and further files."""
    import importlib.metadata
    import platform
    import zipfile

    from pyspark import cloudpickle

    pinned = sorted({*requirements, *(f"{n}=={importlib.metadata.version(n)}" for n in ("pyspark", "numpy", "pandas", "pyarrow"))})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("solutions.pkl", cloudpickle.dumps(solutions))
        out.writestr("manifest.json", json.dumps({"dataset_id": manifest.get("dataset_id"), "solutions": sorted(solutions), "python": platform.python_version()}, indent=2))
        out.writestr("requirements.txt", "\n".join(pinned) + "\n")
        for name, content in (files_ or {}).items():
            out.writestr(f"files/{name}", content)
    return path
