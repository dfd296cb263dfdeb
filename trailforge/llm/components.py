"""Connected components of links between long ids, by alternating large and small stars.

Every node ends with the smallest id that it reaches. Each round sends nodes
only minima of their neighbourhoods: the minimum of a key is a partial
aggregate, and the join that brings it back has the links on one side, which
adaptive execution can split where one node has very many of them. No group is
gathered in one task and nothing goes to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with b < a."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: columns a, b (long, any order, repeats and loops allowed).

    Returns (node, component) for every node that has a link to another one;
    component is the smallest node reached. Empty links give an empty table.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    mark = None
    for _ in range(most_rounds):
        # Done when no node has two smaller neighbours and no node is both above and below another.
        state = links.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state[0] == 0 or state == mark:
            break
        if state[0] == state[1] and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        mark = state
        links = cut(_star(_star(links, True), False))
    else:
        raise RuntimeError(f"the components have not settled in {most_rounds} rounds")
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
