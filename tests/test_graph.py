"""Lookups, traversals and aggregates of a small harbour: ships, ports, cargo."""

import pytest
from pyspark.sql import functions as F

from skein.functions.search import geo_knn, geo_within_bbox, geo_within_radius
from skein.plans.graph import PropertyGraph


@pytest.fixture(scope="module")
def g(spark):
    f = spark.createDataFrame
    return PropertyGraph(spark, {
        "Ship": f([(1, "Ada", 300), (2, "Bo", 40), (3, "Cid", 120), (4, "Ada", 90)], "id long, name string, tons long"), "Port": f([(11, "Riga", "LV"), (12, "Oslo", "NO"), (13, "Bergen", "NO")], "id long, name string, land string"),
        "Goods": f([(21, "tin"), (22, "rye"), (23, "oak")], "id long, name string"), "label": f([(3, "Old"), (12, "Old"), (12, "Old")], "id long, label string"),
        "calls": f([(1, 11, 5), (1, 12, 6), (2, 12, 7), (3, 13, 8), (3, 12, 9), (1, 12, 10)], "src long, dst long, day long"), "carries": f([(1, 21, 2.0), (1, 22, 3.0), (2, 22, 4.0), (3, 21, 1.0), (3, 22, 9.0), (3, 23, 5.0)], "src long, dst long, load double"),
        "follows": f([(1, 3), (2, 1), (3, 2)], "src long, dst long"),
    })


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def test_lookups(spark, g):
    assert g.node("Ship", name="Ada") == 1 and g.node("Ship", name="Zoe") is None
    assert rows(g.nodes("Port", land=["NO", "SE"]).select("id")) == [(12,), (13,)]
    assert rows(g.nodes("Old")) == [(12,), (3,)] and rows(g.has_label(ids(spark, 1, 3), "Old")) == [(3,)]
    assert rows(g.nodes_with_property("name", "Ada")) == [(1,), (4,)] and g.nodes_with_property("tons").count() == 4
    with pytest.raises(KeyError):
        g.nodes_with_property("no such")
    assert g.node_count("Ship", "Port") == 7 and g.relationship_count("calls", "follows") == 9


def test_traversal(spark, g):
    assert rows(g.traverse(ids(spark, 2), ["calls", "carries"])) == [(2, 12, "calls", 7, None), (2, 22, "carries", None, 4.0)]
    assert rows(g.neighbors(ids(spark, 1), "calls")) == [(11,), (12,), (12,)] and rows(g.neighbors(ids(spark, 1), "calls", distinct=True)) == [(11,), (12,)]
    assert rows(g.neighbors(ids(spark, 12), ("calls",), "in", True)) == [(1,), (2,), (3,)] and rows(g.neighbors(ids(spark, 1), "follows", "both")) == [(2,), (3,)]
    assert rows(g.neighbors_in(ids(spark, 3), "calls", g.nodes("Old"))) == [(12,)]
    assert rows(g.first_neighbor(ids(spark, 1, 3, 4), "calls")) == [(1, 11), (3, 12)]
    assert rows(g.follow(ids(spark, 2), ("follows", "out"), ("carries", "out"))) == [(2, 21), (2, 22)]
    assert rows(g.has_rel(ids(spark, 1, 4), "calls")) == [(1,)]
    assert rows(g.has_neighbor_with_property(ids(spark, 1, 2, 3), "calls", "Port", name="Bergen")) == [(3,)]


def test_aggregates(spark, g):
    assert rows(g.degree("carries")) == [(1, 2), (2, 1), (3, 3)] and rows(g.degree("calls", "in")) == [(11, 1), (12, 4), (13, 1)]
    assert rows(g.neighbor_counts(ids(spark, 1, 2), "calls")) == [(11, 1), (12, 3)] and rows(g.neighbor_counts(ids(spark, 1, 2), "calls", distinct=True)) == [(11, 1), (12, 2)]
    lands = g["Port"].select("id", F.col("land").alias("group"))
    groups = g.neighbor_groups(ids(spark, 1, 2, 3), "calls", "out", lands)
    assert rows(groups) == [(1, "LV", 1), (1, "NO", 2), (2, "NO", 1), (3, "NO", 2)] and [tuple(r) for r in g.top_by_size(groups, 2).collect()] == [(1, 2), (3, 2)]
    assert rows(g.co_occurring("carries", least=2)) == [(21, 22, 2)] and rows(g.co_occurring("carries")) == [(21, 22, 2), (21, 23, 1), (22, 23, 1)]
    first = g.first_neighbor(ids(spark, 1, 2, 3), "calls").select("id", F.col("neighbor").alias("via"))
    assert rows(g.fold_via("follows", first, first)) == [(11, 12, 1), (12, 11, 1), (12, 12, 1)]


def test_fluent(g):
    assert rows(g.aggregate("Ship", "Port").by_label().run()) == [("Port", 3), ("Ship", 4)]
    assert rows(g.aggregate("Ship").bin("tons", [50, 100, 200], "size").sum("tons").run()) == [(0, 40), (1, 90), (2, 120), (3, 300)]
    assert rows(g.aggregate("Ship").where("tons > 50").through("carries", name="goods").by("goods").count().count_distinct("id", "ships").having("n > 1").run()) == [(21, 2, 2), (22, 2, 2)]
    base = g.aggregate("Ship")
    base.where("tons > 9999")
    assert rows(base.run()) == [(4,)]


def test_places(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 60.0, 10.0), (5, None, 1.0)], "id long, lat double, lon double")
    assert [r["id"] for r in geo_within_radius(p, 0.0, 0.0, 112.0).orderBy("km", "id").collect()] == [1, 2, 3]
    assert geo_within_radius(p, 0.0, 0.0, 111.0).count() == 1
    assert rows(geo_within_bbox(p, (0.0, 60.0), (1.0, 10.0))) == [(2,), (4,)]
    assert [r["id"] for r in geo_knn(p, 59.0, 9.0, 2).collect()] == [4, 3]
