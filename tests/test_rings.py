"""Strong components and hop counts of deep graphs."""

from trailforge.operators import network


def test_a_long_ring(spark):
    """2.1 million arcs in one ring: hops all around, one component."""
    n = 2_100_000
    ring = spark.range(n).selectExpr("id AS u", "(id + 1) % 2100000 AS v", "0 AS key", "id AS edge_id")
    row = network.strong_components(ring).selectExpr("count(*)", "max(component)").first()
    assert tuple(row) == (n, 0)
    row = network.bfs_hops(ring, spark.createDataFrame([(5,)], "source long")).selectExpr("count(*)", "max(hops)", "max_by(node, hops)").first()
    assert tuple(row) == (n, n - 1, 4)
