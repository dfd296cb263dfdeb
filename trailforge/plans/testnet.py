"""A road network derived from the test tables, by SQL that Spark and DuckDB run alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trailforge.operators.lineage import folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "net_nodes": """SELECT p_partkey AS node,
  CAST((p_partkey % 20) * 100 + (p_size % 7) * 3 AS DOUBLE) AS x,
  CAST(FLOOR(p_partkey / 20) * 100 + (p_size % 5) * 4 AS DOUBLE) AS y, p_size AS sz
FROM part""",
    "net_edges": """WITH s AS (
  SELECT a.node AS a, b.node AS b, a.sz AS sz, 0 AS slot, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
    FROM net_nodes a JOIN net_nodes b ON b.node = a.node + 1 WHERE a.node % 20 < 19
  UNION ALL
  SELECT a.node, b.node, a.sz, 2, a.x, a.y, b.x, b.y FROM net_nodes a JOIN net_nodes b ON b.node = a.node + 20),
d AS (SELECT s.*, SQRT((ax-bx)*(ax-bx) + (ay-by_)*(ay-by_)) AS len FROM s),
e AS (
  SELECT a*8 + slot AS edge_id, a AS u, b AS v, 0 AS key, len AS length_m, sz, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM d
  UNION ALL
  SELECT a*8 + slot + 1, b, a, 0, len, sz, bx, by_, ax, ay FROM d WHERE sz % 5 <> 0
  UNION ALL
  SELECT a*8 + 4, a, b, 1, len * CAST(1.25 AS DOUBLE), sz, ax, ay, bx, by_ FROM d WHERE slot = 0 AND a % 50 = 0)
SELECT edge_id, u, v, key, length_m,
  CASE sz % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'cycleway' WHEN 2 THEN 'primary'
              WHEN 3 THEN 'footway;path' WHEN 4 THEN 'service' END AS highway,
  CASE sz % 4 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'asphalt;paving_stones' END AS surface,
  CASE sz % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit,
  CASE sz % 7 WHEN 0 THEN 'lane' WHEN 1 THEN 'no' WHEN 2 THEN 'lane;no' END AS cycleway,
  CAST(CASE sz % 4 WHEN 0 THEN 30 WHEN 1 THEN 50 WHEN 2 THEN 70 END AS DOUBLE) AS maxspeed,
  sz % 5 = 0 AS oneway, x0, y0, x1, y1
FROM e""",
    "net_trips": """SELECT e.edge_id, CAST(COUNT(l.l_partkey) % 23 AS DOUBLE) AS trips
FROM net_edges e LEFT JOIN lineitem l ON l.l_partkey = e.u
WHERE e.u % 4 <> 3 GROUP BY e.edge_id""",
    "net_pairs": """SELECT CONCAT('AB', LPAD(CAST(p_partkey AS VARCHAR(9)), 2, '0')) AS od_id,
  p_partkey * 7 AS origin, 5 * (35 - p_partkey) + 20 AS destination
FROM part WHERE p_partkey < 36""",
    "net_points": """SELECT s_suppkey AS point_id,
  CASE s_nationkey % 3 WHEN 0 THEN 'signals' WHEN 1 THEN 'parking' ELSE 'water' END AS type,
  CAST((s_suppkey * 137) % 1900 + 11 AS DOUBLE) AS x, CAST((s_suppkey * 211) % 900 + 7 AS DOUBLE) AS y
FROM supplier""",
    "net_tracks": """SELECT user_id AS track_id, seq, ts,
  CAST((user_id * 131) % 1500 + seq * 5 AS DOUBLE) AS x, CAST((user_id * 71) % 900 + event_id % 20 AS DOUBLE) AS y
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) t
WHERE seq <= 50""",
}

#: The views that are kept once computed.
KEPT = ("net_edges", "net_trips", "net_tracks")

#: The views as common table expressions, to put before an oracle's own.
CTES = ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items())


def with_net(sql: str) -> str:
    """An oracle's SQL with the network's views; sql may go on with a comma and further expressions, or SELECT."""
    return f"WITH RECURSIVE {CTES}{sql}" if sql.lstrip().startswith(",") else f"WITH {CTES}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again, where all executors see it."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


class Net:
    """The network's relations over one folder of test tables.

    Edges, trips and tracks are read by several steps of a query, so they are
    kept, in memory or else on the executors' disks; a lost block is computed
    again. Equal plans share what is kept.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        for name in ("part", "supplier", "lineitem", "events"):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        for name, sql in VIEWS.items():
            df = spark.sql(sql)
            if name in KEPT:
                df = df.persist()
            df.createOrReplaceTempView(name)
            setattr(self, name.removeprefix("net_"), df)
