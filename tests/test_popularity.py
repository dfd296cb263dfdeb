"""Popularity and labels on small and odd rows."""

import pytest

from trailforge.operators import popularity as P


def test_mid_ranks_by_length(spark):
    rows = spark.createDataFrame([(1, 5.0, 10.0), (2, 5.0, 10.0), (3, 9.0, 20.0), (4, None, 30.0), (5, float("nan"), 5.0)], "edge_id long, trips double, length_m double")
    got = {r.edge_id: r.popularity for r in P.popularity(rows).collect()}
    assert got == {1: 25.0, 2: 25.0, 3: 75.0, 4: None, 5: None}


def test_values_off_the_scale(spark):
    fit = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "trips double, length_m double")
    asked = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "trips double")
    got = {r.trips: r.popularity for r in P.apply_scale(asked, P.fit_scale(fit)).collect()}
    assert got == {0.5: 0.0, 2.0: 25.0, 9.0: 100.0}


def test_an_empty_scale_gives_nulls(spark):
    none = spark.createDataFrame([], "trips double, length_m double")
    asked = spark.createDataFrame([(0.5,), (None,)], "trips double")
    assert [r.popularity for r in P.apply_scale(asked, P.fit_scale(none)).collect()] == [None, None]


@pytest.mark.parametrize("labels", [[(1, -1.0)], [(1, float("inf"))], [(1, float("nan"))], [(1, 1.0), (1, 2.0)]])
def test_bad_labels_are_refused(spark, labels):
    edges = spark.createDataFrame([(1,)], "edge_id long")
    with pytest.raises(ValueError):
        P.align_labels(edges, spark.createDataFrame(labels, "edge_id long, trips double"))


def test_edges_without_labels_stay(spark):
    edges = spark.createDataFrame([(1,), (2,)], "edge_id long")
    got = P.align_labels(edges, spark.createDataFrame([(1, 4.0)], "edge_id long, trips double")).collect()
    assert {r.edge_id: r.trips for r in got} == {1: 4.0, 2: None}
