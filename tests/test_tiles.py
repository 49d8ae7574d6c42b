"""Neighbours, edges and components over many tiles, held against brute force; no pair of points becomes a row."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import components as CC
from plumbline.operators import graph as G
from plumbline.operators import knn as K
from plumbline.operators import labels as L
from plumbline.plans import graphs
from plumbline.plans.points import places, points

SCHEMA = "pid long, x double, y double, z double"
DIR = "/root/testdata/sf0.001"


@pytest.fixture
def tiles(monkeypatch):
    """Tables of hundreds of points take the way of tables of millions."""
    monkeypatch.setattr(K, "FEW", 40)


def cloud():
    """Points on floors, a pile at one place, and strays far from all others."""
    r = np.random.default_rng(5)
    p = np.c_[r.random((500, 2)) * 30 - 15, np.floor(r.random(500) * 6)]
    p[:60] = [3.0, -2.0, 1.0]
    p[60:64] = [[900.0, 0, 0], [-5000.0, 40, 3], [0, 3e5, 0], [0.5, 3e5, 0]]
    return [(int(i), *map(float, a)) for i, a in zip(r.permutation(5000), p)]


def brute(points, queries, k, cap=float("inf")):
    out = {}
    for q, *a in queries:
        d = sorted(((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]), p) for p, *b in points if p != q)
        out[q] = [(i + 1, p, x) for i, (x, p) in enumerate([t for t in d if t[0] <= cap * cap][:k])]
    return {(q, *t) for q, near in out.items() for t in near}


def test_neighbours_over_tiles(spark, tiles):
    p = cloud()
    got = [tuple(r) for r in K.knn(spark.createDataFrame(p, SCHEMA), 5, 4.0).select("src", "rank", "dst", "d2").collect()]
    assert len(got) == len(p) * 5 and set(got) == brute(p, p, 5)


def test_strangers_over_tiles(spark, tiles):
    p = cloud()
    ask = [p[0], p[62], (9001, 0.0, 0.0, 0.0), (9002, 80.0, -70.0, 0.0), (9003, 1e7, 1e7, -1e7)]
    got = [tuple(r) for r in K.knn(spark.createDataFrame(p, SCHEMA), 7, 1.0, spark.createDataFrame(ask, SCHEMA)).select("src", "rank", "dst", "d2").collect()]
    assert len(got) == len(ask) * 7 and set(got) == brute(p, ask, 7)


def rows_of_joins(df):
    """Names of the joins and windows in the plan that runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if w in plan]


def test_edges_over_tiles(spark, tiles):
    p = cloud()
    edges = K.local_edges(spark.createDataFrame(p, SCHEMA), 10, 2.5)
    got = sorted((r.src, r.dst, r.len) for r in edges.collect())
    assert got == sorted((q, n, float(np.float32(np.sqrt(d)))) for q, _, n, d in brute(p, p, 10, 2.5))
    assert rows_of_joins(edges) == []


def test_columns_travel_packed(spark, tiles):
    r = np.random.default_rng(2)
    grid = np.rint(r.random(5000) * 1e6) / 1e4
    for v in (grid, r.random(50), r.integers(-(2**63), 2**63 - 1, 50), np.array([-0.0, 1.0]), np.array([1e300, -5e-324, 2.0**63]), np.array([3], np.int32)):
        assert K.unpack(K.pack(v), len(v)).tobytes() == (v if v.dtype.kind == "f" else v.astype(np.int64)).tobytes()
    assert len(K.pack(grid)) < 3.2 * len(grid)
    # a tile's rows of a task are one row of the exchange
    plan = K.local_edges(spark.createDataFrame(cloud(), SCHEMA), 10, 2.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange hashpartitioning(bx") < plan.index("MapInArrow") < plan.index("Generate")


def test_places_are_those_of_points(spark, tmp_path):
    li = spark.read.parquet(f"{DIR}/lineitem.parquet")
    # rows that agree in the leading keys only
    twins = li.limit(300).selectExpr("* except (l_extendedprice, l_returnflag)", "l_extendedprice - 1 as l_extendedprice", "'A' as l_returnflag").select(li.columns)
    li.unionByName(twins).unionByName(twins).write.parquet(f"{tmp_path}/lineitem.parquet")
    want, got = points(spark, str(tmp_path)).select("pid", "x", "y", "z"), places(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read = got._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "l_quantity" in read and "l_extendedprice" not in read and "l_shipdate" not in read


def test_moments_over_tiles(spark, tiles):
    p = cloud()
    points = spark.createDataFrame(p, SCHEMA)
    moments = K.local_moments(points, 10, 2.5)
    assert rows_of_joins(moments) == []
    want = {r.pid: r for r in K.moments(K.local_edges(points), points).collect()}
    got = {r.pid: r for r in moments.collect()}
    assert got.keys() == want.keys()
    for q, r in got.items():
        assert r.n == want[q].n and all(r[c] == pytest.approx(want[q][c], abs=1e-9) for c in ("xx", "xy", "xz", "yy", "yz", "zz"))


def test_shapes_over_tiles(spark, tiles):
    p = cloud()
    points = spark.createDataFrame(p, SCHEMA)
    got = {r.pid: r for r in K.nearest_moments(points, 8, 8.0).collect()}
    want = {r.pid: r for r in K.moments(K.knn(points, 8, 8.0), points).collect()}
    assert len(got) == len(p) and got.keys() == want.keys()
    for q, r in got.items():
        assert all(r[c] == pytest.approx(want[q][c], rel=1e-9, abs=1e-9) for c in ("xx", "xy", "zz"))


def test_votes_over_tiles(spark, tiles):
    p = cloud()
    label = {q: q % 3 for q, *_ in p}
    ask = [(9000 + i, float(i * 3 - 20), float(i), 1.5) for i in range(12)]
    seeds = spark.createDataFrame([(*t, label[t[0]]) for t in p], SCHEMA + ", label long")
    got = {r.pid: r.label for r in L.residue(spark.createDataFrame(ask, SCHEMA), seeds).collect()}
    votes = {}
    for q, _, n, _ in brute(p, ask, 5):
        votes.setdefault(q, []).append(label[n])
    assert got == {q: max(set(v), key=lambda x: (v.count(x), -x)) for q, v in votes.items()}


def test_votes_are_counted_in_tiles(spark, tiles, monkeypatch):
    tags = np.array([7, 2, 2, 7, 5, -1, 9])
    label = K._as_votes(4, np.array([0, 0, 0, 0, 2, 3, 3]), None, None, None, tags)[0]
    assert label.to_pylist() == [2, None, 5, -1]
    assert K._as_votes(2, np.zeros(0, np.int64), None, None, None, np.zeros(0, np.int64))[0].to_pylist() == [None, None]
    # points are written once, by one pass over the table, and no vote becomes a row of an exchange
    names, write = [], K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(K, "_rest", lambda left, *a: left.select("pid", F.lit(0).cast("long").alias("label")))
    plan = graphs.QUERIES["residue_vote"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert names == ["points", "knn"] and "Aggregate" not in plan and "Exchange" not in plan


def test_decisions_over_tiles(spark, monkeypatch):
    claims = graphs.claims(spark, DIR).select("pid", "cell", "x", "y", "z", "claims")
    want = sorted(map(tuple, L.decide(claims, 60, 60, quorum=8).collect()))
    monkeypatch.setattr(K, "FEW", 40)
    got = L.decide(claims, 60, 60, quorum=8)
    assert sorted(map(tuple, got.collect())) == want
    # points are not gathered on the driver
    assert "BroadcastHashJoin" not in rows_of_joins(got)


def test_points_without_a_place(spark, tiles):
    p = cloud()
    odd = [(7001, None, 1.0, 1.0), (7002, float("nan"), 1.0, 1.0), (7003, 1.0, float("inf"), 1.0)]
    got = K.knn(spark.createDataFrame(p + odd, SCHEMA), 3, 4.0).select("src", "rank", "dst", "d2").collect()
    assert {tuple(r) for r in got} == brute(p, p, 3)


def test_state_of_many_edges(spark):
    """A round's state is told for more edges than a sum of hashes has room for."""
    n, h = CC._mark(spark.range(24_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert n == 24_000_000 and h != 0


def kruskal(edges):
    up: dict[int, int] = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    kept = set()
    for n, a, b in sorted({(n, min(a, b), max(a, b)) for a, b, n in edges}):
        if (x := root(a)) != (y := root(b)):
            up[max(x, y)] = min(x, y)
            kept.add((a, b, n))
    return kept, root


def edges_of(p, k, cap):
    return [(q, n, float(np.float32(np.sqrt(d)))) for q, _, n, d in brute(p, p, k, cap)]


@pytest.mark.parametrize("cap", [0.8, 2.0])
def test_components_over_tiles(spark, tiles, cap):
    p = cloud()
    odd = [(7001, None, 1.0, 1.0)]
    root = kruskal(edges_of(p, 4, cap))[1]
    got = [tuple(r) for r in G.near_components(spark.createDataFrame(p + odd, SCHEMA), 4, cap).select("node", "component").collect()]
    want = {}
    for q, *_ in p:
        want.setdefault(root(q), []).append(q)
    assert sorted(got) == sorted([(q, min(v)) for v in want.values() for q in v] + [(7001, 7001)])


def test_groups_of_tiles_are_those_of_the_tree(spark, tiles, monkeypatch):
    """Cut groups are found in tiles and joined by places on their rims: no round of a forest, no row for each edge or copy."""
    monkeypatch.setattr(K, "LISTED", 7)
    p = cloud()
    points = spark.createDataFrame(p, SCHEMA)
    want = sorted(map(tuple, G.cut_components(G.near_forest(points, 10, 1.2), points, 1.0).select("node", "component").collect()))
    names, write = [], G.materialise
    for m in (K, G):
        monkeypatch.setattr(m, "materialise", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(graphs, "places", lambda spark, d: points)
    got = graphs.QUERIES["mst_cut_components"](spark, DIR)
    assert names == ["points", "parts", "links"] and sorted(map(tuple, got.select("node", "component").collect())) == want
    rows = K.local_components(points, 10, 2.0).collect()
    pile = {q for q, *a in p if a == [3.0, -2.0, 1.0]}
    assert len(pile) == 60 and all(pile & set(r[c] or ()) <= {min(pile)} for r in rows for c in ("rim", "far"))
    own = [q for r in rows for q in r.own or ()]
    assert sorted(own) == sorted(q for q, *_ in p) and max(len(r[c] or ()) for r in rows for c in ("own", "rim", "far")) == 7


def test_groups_end_at_the_cut(spark, tmp_path):
    """Lengths just above the cut are told apart, as in the SQL, though 32 bits do not hold the difference."""
    one = spark.read.parquet(f"{DIR}/lineitem.parquet").limit(1)
    rows = [one.selectExpr("* except (l_quantity)", f"{z}D as l_quantity").select(one.columns) for z in (1.0, 2.0, 3.00000002)]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in graphs.QUERIES["mst_cut_components"](spark, str(tmp_path)).select("node", "component").collect())
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(graphs.SQL["mst_cut_components"]).fetchall())
    assert [c - got[0][0] for _, c in got] == [0, 0, 2]


@pytest.mark.parametrize("cap", [0.8, 2.5])
def test_forest_over_tiles(spark, tiles, cap):
    p = cloud()
    points = spark.createDataFrame(p, SCHEMA)
    got = [tuple(r) for r in G.near_forest(points, 10, cap).select("src", "dst", "len").collect()]
    want = kruskal(edges_of(p, 10, cap))[0]
    assert len(got) == len(want) and set(got) == want
    # tiles drop most edges before any round
    assert K.local_forests(points, 10, cap).count() < 0.6 * K.local_edges(points, 10, cap).count()


@pytest.mark.parametrize(("k", "every"), [(10, 4), (3, 90)])
def test_ways_over_tiles(spark, tiles, k, every):
    p = cloud()
    odd = [(7000, None, 1.0, 1.0), (7001, None, 1.0, 1.0)]
    tag = {q: int(i % every == 0) for i, (q, *_) in enumerate(p + odd)}
    dist = {q: 0.0 for q in tag if tag[q]}
    edges = edges_of(p, k, 2.5)
    while True:
        before = dict(dist)
        for a, b, n in edges:
            for u, v in ((a, b), (b, a)):
                if u in dist and dist[u] + n < dist.get(v, float("inf")):
                    dist[v] = dist[u] + n
        if dist == before:
            break
    points = spark.createDataFrame([(*t, tag[t[0]]) for t in p + odd], SCHEMA + ", tag long")
    got = [tuple(r) for r in G.near_support_distances(points, k, 2.5).select("pid", "dist").collect()]
    assert sorted(got) == sorted((q, dist.get(q)) for q in tag)
