"""What the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class of Java's and Python's regular expressions.
BLANK = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def n_words(text: Column) -> Column:
    """The number of words, null texts having none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that all executors share.

    That folder is the session's spark.checkpoint.dir. Only a local session
    that has none, as in tests, gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
            place = tempfile.mkdtemp(prefix="trailforge-")
        sc.setCheckpointDir(place)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of the table has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(texts: DataFrame, text_col: str, size: int) -> int:
    """The session's number of partitions, or so many that each has about ``size`` bytes of text."""
    total = texts.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(parts(texts.sparkSession), -(-total // size))


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
