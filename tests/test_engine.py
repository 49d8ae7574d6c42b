"""Hand-made fixtures and brute force for the engine's operators."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells as C
from plumbline.operators import glazing, mesh
from plumbline.operators import graph as G
from plumbline.operators import instances as I
from plumbline.operators import knn as K
from plumbline.operators import labels as L
from plumbline.operators import raster as R
from plumbline.operators import spatial as P
from plumbline.operators import stencil as S
from plumbline.operators import trajectory as T
from plumbline.operators import views as V
from plumbline.operators import window as W

BOX = (0.0, 0.0, 10.0, 10.0)


def pts(spark, rows, extra=""):
    return spark.createDataFrame([(k, *map(float, r[:3]), *r[3:]) for k, r in enumerate(rows)], "pid long, x double, y double, z double" + extra)


def test_rasters_face_north_and_edges_are_half_open(spark):
    p = pts(spark, [(1.5, 9.5, 50), (1.5, 0.5, 10), (2.0, 9.0, 7)])
    got = {r.cell: r.value for r in C.raster(p, BOX).collect()}
    assert got == {1: 50.0, 91: 10.0, 12: 7.0}
    assert W.box(5, 5, 2) == (3, 3, 7, 7) and C.shape_for((0, 0, 2.5, 3.5), 1.0) == (4, 2)


def interval(spark, zs, lines):
    p = pts(spark, [(0.5, 0.5, z, n) for z, n in zip(zs, lines, strict=True)], ", point_source_id long")
    return C.interval(p, BOX).withColumn("kind", C.surface_kind()).first()


def test_intervals(spark):
    r = interval(spark, [10, 10.1, 30], [1, 1, 2])
    assert (r.value, r.lo, round(r.hi - r.lo, 6), r.method) == (30, 10.1, 19.9, 2)
    r = interval(spark, [1.0] * 10 + [9.0], [1] * 11)
    assert (r.value, r.lo, r.method, r.kind) == (9, 1, 1, 0)
    r = interval(spark, [7.0], [1])
    assert (r.lo, r.hi, r.n, r.method) == (7, 7, 1, 0)
    assert (lambda r: r.hi - r.lo)(interval(spark, [1, 1, 20, 1.1, 1.1, 20], [1, 1, 1, 2, 2, 2])) == 0
    assert interval(spark, [30] * 5 + [5] * 5, [1] * 5 + [2] * 5).kind == 3
    assert interval(spark, [10] * 5 + [10] * 4 + [25], [1] * 5 + [2] * 5).kind == 2
    assert interval(spark, [10] * 40 + [10], [1] * 40 + [2]).kind == 4
    assert interval(spark, [10] * 4, [1, 1, 2, 2]).kind == 1


def test_edge_strength_annihilates_on_a_flat_view(spark):
    rows = [(0.5, 0.5, z, n) for n in (1, 2) for z in np.linspace(0, 10, 30)] + [(5.5, 0.5, z, 1) for z in np.linspace(0, 10, 30)] + [(5.5, 0.5, 3.0, 2)] * 5
    s = {r.cell: r.strength for r in V.edge_strength(pts(spark, rows, ", point_source_id long"), BOX).collect()}
    assert s[90] > 0.5 and s[95] == 0


def test_echo_needs_evidence(spark):
    rows = [(0.5, 0.5, 1, 3)] * 6 + [(5.5, 0.5, 1, 1)] * 6 + [(9.5, 0.5, 1, 3)]
    e = {r.cell: r.ratio for r in V.echo_multi(pts(spark, rows, ", number_of_returns long"), BOX).collect()}
    assert e[90] == 1 and e[95] == 0 and e[99] is None


def test_azimuth_and_bundles(spark):
    rows = [(t, 0.0, 0.0, float(t), a, 1) for t in range(20) for a in (2000, -2000)]
    p = pts(spark, rows, ", gps_time double, scan_angle long, point_source_id long")
    az = {(r.scan_angle > 0, round(r.azimuth)) for r in V.look_azimuth(p).collect()}
    assert az == {(True, 180), (False, 0)}
    assert V.bundle_codes([(1, 1, 0.0, 5), (1, -1, 180.0, 5), (2, 1, 315.0, 5)], 2) in ({(1, 1): 1, (2, 1): 1, (1, -1): 0}, {(1, 1): 0, (2, 1): 0, (1, -1): 1})


def test_flight_dates(spark):
    r = V.flight_dates(spark.createDataFrame([(346631078.37,), (346793921.67,)], "gps_time double")).first()
    assert np.datetime64(int(r.first_s), "s").astype("datetime64[D]") == np.datetime64("2022-09-08") and round(r.last_s - r.first_s, 1) == 162843.3


def test_column_gaps(spark):
    ground = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "cell long, ground_z double")
    vox = spark.createDataFrame([(1, k) for k in range(0, 7)] + [(2, 0), (2, 5)], "cell long, level long")
    got = {r.cell: (r.gap, r.supported) for r in C.column_gaps(vox, ground, h=3.0).collect()}
    assert got[1] == (0.0, True) and got[2] == (2.0, False) and got[3][1] is False


def mask(spark, cells):
    return spark.createDataFrame([(int(c),) for c in cells], "cell long")


def test_stencils_against_dense(spark):
    rng = np.random.default_rng(0)
    g = rng.random((9, 11)) < 0.6
    m = mask(spark, np.flatnonzero(g))
    for name, offs in (("sq", S.square(1)), ("di", S.diamond(2))):
        dil, ero = np.zeros_like(g), np.ones_like(g)
        for y, x in itertools.product(range(9), range(11)):
            near = [(y - dy, x - dx) for dx, dy in offs]
            dil[y, x] = any(0 <= a < 9 and 0 <= b < 11 and g[a, b] for a, b in near)
            ero[y, x] = all(0 <= a < 9 and 0 <= b < 11 and g[a, b] for a, b in near)
        assert {r.cell for r in S.dilate(m, 11, 9, offs).collect()} == set(np.flatnonzero(dil)), name
        assert {r.cell for r in S.erode(m, 11, 9, offs).collect()} == set(np.flatnonzero(ero)), name


def test_hysteresis_keeps_what_hangs_on_a_seed(spark):
    rows = [(40, 1.0), (41, 0.2), (42, 0.2), (49, 0.2), (0, 0.2)]
    d = spark.createDataFrame(rows, "cell long, strength double")
    assert {r.cell for r in S.hysteresis(d, 9, 9).collect()} == {40, 41, 42, 49}


def test_flood_fills_and_stays_in_its_level(spark):
    z = [(y * 20 + x, 0.3 if x < 5 else 1.0 if x < 10 else 3.0, 0 if x < 10 else 1) for y in range(20) for x in range(20)]
    surface = spark.createDataFrame(z, "cell long, z double, n_ground long")
    wet = S.flood(mask(spark, [0, 20]), surface, 0.0, 20, 20)
    assert wet.count() == 100 and wet.select("body").distinct().count() == 1
    assert S.flood(mask(spark, [0]), surface, 0.0, 20, 20, deck_tol=1.0).count() == 200


def test_voxels_connect_in_26_directions(spark):
    v = spark.createDataFrame([(0, 0), (12, 1), (14, 1), (99, 5)], "cell long, zb long")
    lab = {(r.cell, r.zb): r.component for r in S.voxel_components(v, 11, 11).collect()}
    assert lab[0, 0] == lab[12, 1] and lab[14, 1] != lab[0, 0] and len(set(lab.values())) == 3


def cloud(seed, n):
    rng = np.random.default_rng(seed)
    c = rng.random((6, 3)) * [40, 40, 6]
    return np.round(c[rng.integers(0, 6, n)] + rng.normal(size=(n, 3)), 4)


def test_knn_and_edges_by_brute_force(spark):
    x = np.vstack((cloud(1, 150), [[400, 400, 5]]))
    p = pts(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r.src, r.rank): (r.dst, r.d2) for r in K.knn(p, 4, 1.0).collect()}
    assert len(got) == 4 * len(x)
    for (s, k), (_, v) in got.items():
        assert math.isclose(v, np.sort(d[s])[k - 1], rel_tol=1e-9)
    line = pts(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (100, 0, 0)])
    assert K.local_edges(line, 2, 2.5).count() == 6


def test_shapes(spark):
    rng = np.random.default_rng(2)
    roof = np.c_[rng.random((80, 2)) * 4, np.full(80, 5.0)]
    f = K.shape_features(K.knn(pts(spark, roof), 8, 1.0), pts(spark, roof)).toPandas()
    assert (f["nz"] > 0.98).all() and np.allclose(f[["e1", "e2", "e3"]].sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("seed", [0, 1])
def test_tree_is_the_brute_force_tree(spark, seed):
    x = cloud(seed, 90)
    e = [(i, j, float(np.float32(np.sqrt(((x[i] - x[j]) ** 2).sum())))) for i in range(len(x)) for j in range(i) if ((x[i] - x[j]) ** 2).sum() < 30]
    parent = list(range(len(x)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    want = set()
    for w, a, b in sorted((w, min(i, j), max(i, j)) for i, j, w in e):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b))
    got = G.spanning_forest(spark.createDataFrame(e, "src long, dst long, len double"))
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_support_forest_and_shares(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 5, 1.0), (3, 4, 1.0), (2, 3, 5.0)], "src long, dst long, len double")
    nodes = mask(spark, range(7)).withColumnRenamed("cell", "pid")
    f = G.support_forest(e, nodes, spark.createDataFrame([(0, 1), (4, 2), (4, 3)], "pid long, system int"))
    got = {r.pid: (r.system, r.root, r.depth, r.dist) for r in f.collect()}
    assert got[5] == (1, 0, 3, 3.0) and got[3] == (2, 4, 1, 1.0) and got[6] == (0, -1, -1, None) and got[4][0] == 2
    chain = spark.createDataFrame([(0, -1), (1, 0), (2, 1), (3, 2)], "pid long, pred long")
    cats = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 0)], "pid long, cat int")
    s = {r.pid: (round(r.wall_share, 4), round(r.foliage_share, 4)) for r in G.path_shares(G.path_counts(chain, cats)).collect()}
    assert s == {0: (0, 0), 1: (0, 0), 2: (0.5, 0), 3: (0.3333, 0.3333)}


def test_nearest_cells_and_fill():
    rng = np.random.default_rng(4)
    v = rng.random((14, 17)) < 0.08
    d, r, c = R.nearest_index(v)
    at = np.argwhere(v)
    for y, x in itertools.product(range(14), range(17)):
        best = min((y - a) ** 2 + (x - b) ** 2 for a, b in at)
        assert math.isclose(d[y, x] ** 2, best, abs_tol=1e-9) and v[r[y, x], c[y, x]]
    g = np.add.outer(np.arange(40.0), np.zeros(40))
    g[14:26, 14:26] = np.nan
    out, dist = R.fill(g, "auto")
    near, _ = R.fill(g, "nearest")
    assert not np.isnan(out).any() and dist[20, 20] >= 5
    small = (dist < 5) & np.isnan(g)
    assert (out[small] == near[small]).all() and (out[dist >= 5] != near[dist >= 5]).any()
    assert np.isnan(R.fill(g, "nearest", max_gap=3)[0]).any()


def test_tops_and_cloth():
    y, x = np.mgrid[0:20, 0:40]
    g = np.maximum(10 - np.hypot(x - 10, y - 10), 8 - np.hypot(x - 30, y - 10))
    m = R.h_maxima_markers(g, 2.0)
    assert m.max() == 2 and R.h_maxima_markers(g, 50.0).max() == 1
    w = R.watershed(g, m)
    assert (w > 0).all() and w[10, 10] != w[10, 30]
    z = np.full((30, 30), 5.0)
    z[10:16, 10:16] = 15.0
    assert np.abs(R.cloth(z)[z == 5] - 5).mean() < 0.3 and R.cloth(z)[12, 12] < 9


def test_rings(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    rows = [(1, [dict(x=float(a), y=float(b)) for a, b in ring])]
    r = spark.createDataFrame(rows, "id long, ring array<struct<x double, y double>>".replace("x double", "x: double").replace("y double", "y: double"))
    p = pts(spark, [(1, 1, 0), (2, 3, 0), (3.5, 3, 0), (5, 1, 0)])
    assert {x.pid for x in P.points_in_rings(p, r).collect()} == {0, 2}
    assert r.select(P.ring_area(F.col("ring")).alias("a")).first().a == 10.0
    assert {x.pid: round(x.dist, 3) for x in P.near_rings(p, r, 1.0).collect()}[3] == 1.0
    assert P.ring_cells(r, 6, 6, 0.0, 0.0).count() == len([1 for a, b in itertools.product(range(6), range(6)) if inside(ring, a + 0.5, b + 0.5)])


def inside(ring, x, y):
    return sum(((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_decision_ladder(spark):
    bits = lambda *n: sum(1 << L.CODE[k] for k in n)
    rows = [(bits("ground"),), (bits("ground", "water"),), (bits("building", "veg_high"),), (0,)]
    label, why = L.settle(F.col("claims"))
    got = [(r.a, r.b) for r in spark.createDataFrame(rows, "claims int").select(label.alias("a"), why.alias("b")).collect()]
    assert got == [(0, 0), (1, 1), (255, 2), (255, 3)]


def test_trial_order(spark):
    row = dict(cell=50, zb=3, cont=True, sub=True, geo=None, cube=0.2, scatter=0.1, exg=0.0, inside=False, hag=5.0, not_last=False, veg_high=True, building=False)
    rows = [row | dict(pid=k, cell=50 + 30 * k, cube=c) for k, c in enumerate((0.2, 0.3, 0.2, 0.3))]
    d = spark.createDataFrame(rows, "pid long, cell long, zb long, cont boolean, sub boolean, geo double, cube double, scatter double, exg double, inside boolean, hag double, not_last boolean, veg_high boolean, building boolean")
    assert [r.convicted for r in glazing.convict(d, 20, 20).orderBy("pid").collect()] == [True, False, True, False]
    green = d.withColumn("scatter", F.lit(0.9)).withColumn("exg", F.lit(0.5))
    assert not any(r.convicted for r in glazing.convict(green, 20, 20).collect())


def test_sensor_is_found(spark):
    rng = np.random.default_rng(11)
    top = np.array([100.0, 200.0, 1400.0])
    rows = []
    for k in range(600):
        a = np.radians(rng.uniform(-20, 20, 2))
        u = np.array([math.tan(a[0]), math.tan(a[1]), -1.0])
        for rn, h in ((1, 1380.0), (2, 1390.0)):
            rows.append((*(top + u * h), float(k) / 1000, rn, 2, 1))
    p = pts(spark, rows, ", gps_time double, return_number long, number_of_returns long, point_source_id long")
    t = T.sensor_track(T.pulses(p), 10.0, 500).collect()
    assert len(t) == 1 and np.abs(np.array([t[0].x, t[0].y, t[0].z]) - top).max() < 1


def test_instances_and_bands(spark):
    rows = [(1, 0.0 + k * 0.1, 0.0, 0.0) for k in range(40)] + [(2, 0.0, 0.0, k * 0.1) for k in range(40)]
    d = spark.createDataFrame(rows, "inst long, x double, y double, z double")
    e = {r.inst: r for r in I.extents(d).withColumn("pole", I.like_pole()).withColumn("deck", I.like_deck(min_plan=3.0)).collect()}
    assert e[2].pole and not e[1].pole and e[1].deck and abs(e[1].length - 3.9) < 1e-6
    t = I.instance_table(d.withColumn("class", F.lit(6)))
    assert {r.inst: r.rank for r in I.renumber(t).collect()} == {1: 0, 2: 1}


def test_mesh(spark):
    sq = np.array([(0.0, 0), (2, 0), (2, 1), (0, 1)])
    assert len(mesh.prism(sq, 0, 3)) == 10
    star = np.array([(0.0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    area = sum(abs((star[b][0] - star[a][0]) * (star[c][1] - star[a][1]) - (star[b][1] - star[a][1]) * (star[c][0] - star[a][0])) / 2 for a, b, c in mesh.ear_clip(star))
    assert abs(area - 10) < 1e-9
    glb = mesh.to_glb(mesh.prism(sq, 0, 3))
    assert glb[:4] == b"glTF" and int.from_bytes(glb[8:12], "little") == len(glb)


def test_store_round_trip_and_footers(spark, tmp_path):
    from plumbline.sources import store

    p = pts(spark, [(k % 90, k % 77, k % 9) for k in range(500)]).withColumn("classification", F.lit(2))
    path = str(tmp_path / "s")
    store.write_store(p, path, 3)
    store.write_store(p, path, 3, mode="ignore")
    back = store.read_store(spark, path, (10, 10, 20, 20), ["pid", "nothing"])
    assert back.count() == p.where("x between 10 and 20 and y between 10 and 20").count() and "pid" in back.columns
    plan = back._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,10.0)" in plan
    r = store.extent(spark, path).first()
    assert (r.x0, r.x1, r.n) == (0, 89, 500)
    assert [x["first"] for x in store.registry(spark, [path, path]).collect()] == [0, 500]
    assert store.manifest(spark, path).count() >= 1
    store.run_log(spark, str(tmp_path / "log"), "stage", {"rows": 500})
    assert spark.read.json(str(tmp_path / "log")).first()["stage"] == "stage"


def test_documents(spark, tmp_path):
    from plumbline.sources import documents as D

    head = {"type": "CityJSON", "transform": {"scale": [0.001] * 3, "translate": [10, 0, 0]}}
    cube = {"type": "CityJSONFeature", "id": "a", "CityObjects": {"a": {"type": "Building", "geometry": [{"type": "MultiSurface", "lod": "2.2", "boundaries": [[[0, 1, 2]]]}, {"type": "MultiSurface", "lod": "1.2", "boundaries": [[[0, 1, 2]]]}]}}, "vertices": [[0, 0, 0], [1000, 0, 0], [0, 1000, 0]]}
    (tmp_path / "c.jsonl").write_text(json.dumps(head) + "\n" + json.dumps(cube))
    rows = D.cityjson_lines(spark, str(tmp_path / "c.jsonl")).orderBy("seq").collect()
    assert [(r.x, r.y) for r in rows] == [(10, 0), (11, 0), (10, 1)]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"id": "w1", "properties": {"a": "b"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    assert len(D.features(spark, str(tmp_path / "f.json")).first().ring) == 3
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a.jpg", "x": 1.0}, {"x": 2.0}]))
    assert D.photo_manifest(spark, str(tmp_path / "m.json")).count() == 1
    with pytest.raises(ValueError):
        D.pier_ways(spark.createDataFrame([([("w1",)], ("n",), {}, "pier", [(0.0, 0.0)], (0.0, 1.0, 0.0, 1.0))], "sources array<struct<record_id:string>>, names struct<primary:string>, source_tags map<string,string>, class string, path array<struct<x:double,y:double>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"), (50, 50, 60, 60))


def test_sql_functions(spark):
    from plumbline import functions

    functions.register(spark)
    assert spark.sql("select cell_of(2.5D, 1.5D, 0D, 0D, 10L, 1D), angle_gap(350D, 10D)").first()[:] == (12, 20.0)
