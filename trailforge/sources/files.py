"""Small files of any file system that Spark reads: digests, JSON, moves."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def replace(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder to a place that may be taken; what was there steps aside and goes only when the new one stands.

    A crash between the two moves leaves the old one beside its place, whole,
    as <place>.old-<hex>.
    """
    a, fs = _path(spark, old)
    b, _ = _path(spark, new)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{new}.old-{uuid.uuid4().hex}")
    if not fs.exists(a):
        raise FileNotFoundError(old)
    had = fs.exists(b)
    if had and not fs.rename(b, aside):
        raise OSError(f"{new} can't be moved aside")
    if not fs.rename(a, b):
        if had:
            fs.rename(aside, b)
        raise OSError(f"{old} can't be moved to {new}")
    if had:
        fs.delete(aside, True)


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0].lstrip("﻿"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False))


def table_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the digests of a table's files, in their order; the files are hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    rows = files.select(F.sha2("content", 256).alias("d")).orderBy("d").collect()
    return hashlib.sha256("".join(r["d"] for r in rows).encode()).hexdigest()


