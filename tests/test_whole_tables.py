"""Queries run over all their points; spanning forests against Kruskal's rule, neighbours against brute force."""

import pytest

from plumbline.operators import knn as K
from plumbline.plans import registry
from plumbline.plans.graphs import claims
from plumbline.plans.points import points

DIR = "/root/testdata/sf0.001"


def column(spark, name, c):
    return sorted(r[0] for r in registry.QUERIES[name](spark, DIR).select(c).collect())


def test_every_point_has_a_row(spark):
    pids = sorted(r.pid for r in points(spark, DIR).select("pid").collect())
    assert column(spark, "ranked_components", "node") == pids
    assert column(spark, "edge_components", "node") == pids
    assert column(spark, "mst_cut_components", "node") == pids
    assert column(spark, "support_distance_small", "pid") == pids
    assert column(spark, "knn_small", "src") == sorted(pids * 5)
    assert column(spark, "ground_filter", "pid") == pids
    assert column(spark, "split_tops", "pid") == pids
    near = sorted(r.src for r in K.knn(points(spark, DIR), 8, 8.0).select("src").distinct().collect())
    assert column(spark, "shape_features", "pid") == near
    assert column(spark, "decide_labels", "pid") == sorted(r.pid for r in claims(spark, DIR).select("pid").collect())


@pytest.mark.parametrize(("name", "cap"), [("minimum_spanning_tree", 2.5), ("spanning_forest", 1.2)])
def test_spanning_tree_of_all_points(spark, name, cap):
    edges = sorted({(r.len, min(r.src, r.dst), max(r.src, r.dst)) for r in K.local_edges(points(spark, DIR), 10, cap).collect()})
    up: dict[int, int] = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    want = set()
    for _, a, b in edges:
        if (x := root(a)) != (y := root(b)):
            up[x] = y
            want.add((a, b))
    assert {(r.src, r.dst) for r in registry.QUERIES[name](spark, DIR).collect()} == want


@pytest.mark.parametrize("k", [1, 3, 4, 9])
def test_neighbours_of_strangers(spark, k):
    """Queries that are no points have one more candidate than queries that are; none is missed or doubled."""
    pts = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 50.0, 0.0), (4, 0.0, 0.0, 7.0)]
    ask = [(1, 0.0, 0.0, 0.0), (9, 0.2, 0.1, 0.0), (10, 400.0, 0.0, 0.0)]
    schema = "pid long, x double, y double, z double"
    got = K.knn(spark.createDataFrame(pts, schema), k, 1.0, spark.createDataFrame(ask, schema)).collect()
    want = set()
    for q, *a in ask:
        near = sorted((sum((s - t) ** 2 for s, t in zip(a, b)), p) for p, *b in pts if p != q)[:k]
        want |= {(q, i + 1, p) for i, (_, p) in enumerate(near)}
    assert len(got) == len(want) and {(r.src, r.rank, r.dst) for r in got} == want


def test_neighbours_of_nothing(spark):
    schema = "pid long, x double, y double, z double"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, 0.0, 0.0, 0.0)], schema)
    assert K.knn(none, 3).count() == 0
    assert K.knn(one, 3).count() == 0
    assert K.knn(one, 3, 1.0, none).count() == 0
