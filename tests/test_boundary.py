"""Terrain, boundaries and structures against plain array computations."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import boundary as B
from plumbline.plans import registry

DIR = "/root/testdata/sf0.001"


def around(v, r):
    """All values of the square neighbourhood of each cell; the border mirrors."""
    p = np.pad(v, r, mode="symmetric")
    return np.stack([p[a : a + v.shape[0], b : b + v.shape[1]] for a in range(2 * r + 1) for b in range(2 * r + 1)])


def frame(spark, grid, name):
    rows = [(k, float(v)) for k, v in enumerate(grid.ravel()) if not np.isnan(v)]
    return spark.createDataFrame(rows, f"cell long, {name} double")


def test_filters_and_local_boundary(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.gamma(0.5, 1.0, (13, 17)), 1)
    s[rng.random(s.shape) < 0.3] = np.nan
    v = np.nan_to_num(s)
    cells = frame(spark, v, "v")
    for size, pct in ((3, 50), (5, 90), (5, 100)):
        n = size * size
        want = np.sort(around(v, size // 2), 0)[n - 1 if pct == 100 else int(n * pct / 100)]
        got = {r.cell: r.ref for r in B.percentile_filter(cells, 17, 13, pct, size).collect()}
        assert [got[k] for k in range(v.size)] == want.ravel().tolist()
    got = {r.cell: r.ref for r in B.minimum_filter(cells, 17, 13, 7).collect()}
    assert [got[k] for k in range(v.size)] == around(v, 3).min(0).ravel().tolist()
    t1, t2 = np.nanpercentile(s, 95), np.nanpercentile(s, 75)
    ref = np.sort(around(v, 2), 0)[int(25 * 0.5)]
    want = np.flatnonzero(((v > t1) | ((v > t2) & (v >= ref))).ravel()).tolist()
    assert sorted(r.cell for r in B.local_boundary(frame(spark, s, "strength"), 17, 13, 5).collect()) == want


def returns(spark, seed=4, nx=24, ny=20):
    """Two towers on flat ground, three views, all returns single."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(nx * ny * 9):
        x, y = rng.uniform(0, nx), rng.uniform(0, ny)
        tower = (3 <= int(x) < 10 or 13 <= int(x) < 21) and 4 <= int(y) < 15
        z = (9.0 if tower else 0.0) + rng.uniform(0, 0.02)
        if 15 <= int(x) < 18 and 16 <= int(y) < 19:
            z = 5.0  # too small to count
        rows.append((k, float(x), float(y), float(z), k % 3, 2 if z < 1 else 6, 1, 1))
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double, point_source_id int, classification int, return_number int, number_of_returns int")


def test_two_towers_are_two_structures(spark):
    rows, p = returns(spark)
    box = (0.0, 0.0, 24.0, 20.0)
    got = {}
    for r in B.instances(p, box, edge=3.0, edge_low=1.0, min_area=30.0, span=19).collect():
        got.setdefault(r.inst, set()).add((r.cell % 24, 19 - r.cell // 24))
    assert set(got) == {1, 2}
    assert got[1] == {(x, y) for x in range(3, 10) for y in range(4, 15)} and got[2] == {(x, y) for x in range(13, 21) for y in range(4, 15)}
    floor = spark.range(480).select(F.col("id").alias("cell"), F.lit(0.0).alias("z"))
    assert B.instances(p, box, floor=floor, edge=3.0, edge_low=None, min_area=1.0).select("inst").distinct().count() == 3
    assert B.instances(p, box, floor=floor, edge=3.0, min_height=20.0).count() == 0


def test_terrain(spark):
    rows, p = returns(spark, seed=9)
    box = (0.0, 0.0, 24.0, 20.0)
    dtm, dsm = np.full((20, 24), np.nan), np.full((20, 24), np.nan)
    for _, x, y, z, _, c, _, _ in rows:
        at = int(20 - y), int(x)
        dsm[at] = np.fmax(dsm[at], z)
        if c == 2:
            dtm[at] = np.fmin(dtm[at], z)
    got = {r.cell: r for r in B.dem(p, box).collect()}
    assert len(got) == 480
    have = np.argwhere(~np.isnan(dtm))
    for k, r in got.items():
        at = divmod(k, 24)
        assert (r.dtm is None) == bool(np.isnan(dtm[at])) and (r.dtm is None or r.dtm == r.filled == dtm[at])
        assert (r.dsm is None) == bool(np.isnan(dsm[at])) and (r.dsm is None or r.dsm == dsm[at])
        assert abs(r.distance - np.sqrt(((have - at) ** 2).sum(1)).min()) < 1e-9 and -1 < r.filled < 1
    s = B.dem_stats(B.dem(p, box)).first()
    assert abs(s.void - np.isnan(dtm).mean()) < 1e-12 and s.max_distance > 3
    ground = {r.cell: r for r in B.ground_cells(p, box, resolution=1.0, block=32.0, halo=4.0, rounds=200).collect()}
    # under a tower the cloth finds no ground: it is filled from around
    assert len(ground) == 480 and ground[9 * 24 + 6].ground_z < 1 and not ground[9 * 24 + 6].measured


def test_registered_windows(spark):
    assert registry.QUERIES["ground_cells"](spark, DIR).count() == 3600
    assert registry.QUERIES["dem_stats"](spark, DIR).count() == 1
    assert registry.QUERIES["instances"](spark, DIR).columns == ["cell", "inst"]
