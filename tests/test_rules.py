"""Rules against plain computations: paths with ties, floods, shapes, bands, claims."""

import heapq
import random

import numpy as np

from plumbline.operators import graph as G
from plumbline.operators import instances as I
from plumbline.operators import labels as L
from plumbline.operators import stencil as S


def forest(edges, nodes, roots):
    """Distances first; then the smallest neighbour on a shortest path; then the rest by walking up."""
    ways = {}
    for a, b, n in edges:
        ways.setdefault(a, []).append((b, n))
        ways.setdefault(b, []).append((a, n))
    system = {}
    for p, s in roots:
        system[p] = min(s, system.get(p, s))
    best, heap = {}, [(0.0, 0, p) for p in system]
    while heap:
        d, k, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = (d, k)
        for q, n in ways.get(p, ()):
            heapq.heappush(heap, (d + n, k + 1, q))
    pred = {}
    for p, (d, k) in best.items():
        on = [q for q, n in ways.get(p, ()) if q in best and best[q][0] + n == d and (best[q][0] < d or best[q][1] < k)]
        pred[p] = -1 if p in system else min(on)
    out = {}
    for p in nodes:
        if p not in best:
            out[p] = (-1, -1, 0, None, -1)
            continue
        at, depth = p, 0
        while pred[at] >= 0:
            at, depth = pred[at], depth + 1
        out[p] = (pred[p], at, system[at], best[p][0], depth)
    return out


def check_forest(spark, edges, nodes, roots):
    e = spark.createDataFrame([(a, b, float(n)) for a, b, n in edges], "src long, dst long, len double")
    got = G.support_forest(e, spark.createDataFrame([(n,) for n in nodes], "pid long"), spark.createDataFrame(roots, "pid long, system int"))
    assert {r.pid: (r.pred, r.root, r.system, r.dist, r.depth) for r in got.collect()} == forest(edges, nodes, roots)


def test_support_forest_follows_its_predecessors(spark):
    check_forest(spark, [(3, 100, 1.0), (1, 2, 0.5), (2, 3, 0.5), (3, 4, 1.0)], [1, 2, 3, 4, 100, 7], [(100, 2), (1, 1)])


def test_support_forest_with_ties_and_zero_lengths(spark):
    r = random.Random(3)
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.choice((0.0, 0.5, 0.5, 1.0))) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(70)) if a != b}.values())
    check_forest(spark, edges, list(range(45)), [(0, 2), (0, 5), (17, 1), (33, 4)])


def test_flood(spark):
    r, nx, ny = random.Random(5), 14, 11
    z = {c: r.choice((0.1, 0.3, 2.0, 0.9)) for c in range(nx * ny) if r.random() < 0.9}
    seeds = set(r.sample(sorted(z), 4))
    near = lambda c, diag: [c + dx + nx * dy for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diag or not dx or not dy) and 0 <= c % nx + dx < nx and 0 <= c // nx + dy < ny]

    def parts(cells, diag):
        out, left = [], set(cells)
        while left:
            todo, seen = [min(left)], set()
            while todo:
                c = todo.pop()
                if c in left:
                    left.discard(c)
                    seen.add(c)
                    todo += near(c, diag)
            out.append(seen)
        return out

    mask = seeds | {c for c in z if z[c] <= 0.0 + 0.4}
    wet = set().union(*(p for p in parts(mask, False) if p & seeds))
    rim = {c for c in range(nx * ny) if c % nx in (0, nx - 1) or c // nx in (0, ny - 1)}
    wet |= set().union(*(p for p in parts(set(range(nx * ny)) - wet, False) if not p & rim), set())
    want = {c: min(p) for p in parts(wet, True) for c in p}
    surface = spark.createDataFrame([(c, float(v), 1) for c, v in z.items()], "cell long, z double, n_ground long")
    got = S.flood(spark.createDataFrame([(c,) for c in seeds], "cell long"), surface, 0.0, nx, ny)
    assert {r.cell: r.body for r in got.collect()} == want


def test_roof_band_is_the_histogram_rule(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(30):
        ground = float(rng.choice([0.0, 2.5, -1.25]))
        z = ground + np.round(np.concatenate((rng.normal(rng.uniform(3, 9), 0.6, rng.integers(3, 80)), rng.uniform(0, 20, 6))) * 4) / 4
        rows += [(k, float(v), ground) for v in z]
        lo = ground + 1.0
        zz = z[z >= lo]
        want[k] = (lo, np.inf)
        if len(zz) >= 20:
            edges = np.arange(lo, zz.max() + 0.5, 0.5)
            cnt, _ = np.histogram(zz, edges)
            strong = cnt >= 0.05 * cnt.max()
            top = int(np.argmax(strong))
            while top + 1 < len(cnt) and strong[top + 1]:
                top += 1
            want[k] = (lo, float(edges[top + 1]))
    got = {r.inst: (r.lo, r.hi) for r in I.roof_band(spark.createDataFrame(rows, "inst long, z double, ground double")).collect()}
    assert got == want


def test_shapes_use_robust_heights_and_plan_boxes(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(60):
        n = int(rng.integers(25, 120))
        x, y = rng.uniform(0, rng.uniform(0.5, 12), n), rng.uniform(0, rng.uniform(0.5, 4), n)
        z = rng.uniform(0, rng.uniform(0.3, 9), n)
        z[0] += rng.choice([0, 8])
        rows += [(k, *map(float, v)) for v in zip(x, y, z, strict=True)]
        p = lambda q: np.percentile(z, q)  # noqa: B023, E731
        plan, vert = max(np.ptp(x), np.ptp(y)), np.ptp(z)
        gx, gy = (x - x.min()).astype(int), (y - y.min()).astype(int)
        fill = len(set(zip(gx, gy, strict=True))) / ((gx.max() + 1) * (gy.max() + 1))
        w, v = np.linalg.eigh(np.cov(np.stack((x, y))))
        u = np.stack((x, y), 1) @ v[:, ::-1]
        car = 2.5 <= np.ptp(u[:, 0]) <= 6.5 and 1.4 <= np.ptp(u[:, 1]) <= 2.6 and 1.2 <= p(95) - p(2) <= 2.2
        want[k] = (car, p(98) - p(2) > 2.5 and plan < 1.2, plan >= 5 and plan >= 3 * vert, 2 <= p(98) <= 35 and plan <= 20 and p(2) <= 10,
                   1 <= plan <= 25 and p(2) <= 3 and p(95) - p(2) <= 15 and fill >= 0.22)
    e = I.extents(spark.createDataFrame(rows, "inst long, x double, y double, z double"))
    from pyspark.sql import functions as F

    got = e.select("inst", I.like_car(), I.like_pole(), I.like_deck(), I.like_tree(F.lit(0.0)), I.like_boat(F.lit(0.0))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {k: tuple(map(bool, v)) for k, v in want.items()}


def test_a_claim_takes_only_from_its_list(spark):
    from pyspark.sql import functions as F

    takes = {"water": {"ground"}, "dock": {"water", "ground", "small"}, "bridge": {"ground", "small", "floating", "veg_low", "veg_high"}, "building": {"small", "floating"}, "ground": {"small", "veg_low"}}
    df = spark.createDataFrame([(x,) for x in (*L.LABELS, "unlabelled")], "label string")
    for claim, allowed in takes.items():
        label, kind = L.map_claims(F.col("label"), *[F.lit(claim == c) for c in takes])
        to = "floating" if claim == "dock" else claim
        for r in df.select("label", label.alias("now"), kind.alias("kind")).collect():
            assert r.kind == claim and r.now == (to if r.label in allowed else r.label)


def test_rigging_may_lie_a_hundredth_below_its_floor(spark):
    rows = [(1, 7, "floating", 2.0), (2, 7, "small", 1.995), (3, 7, "small", 1.98), (4, 7, "veg_high", 9.0), (5, 8, "small", 9.0), (6, 7, "ground", 9.0)]
    df = spark.createDataFrame(rows, "pid long, cell long, label string, z double")
    out = L.marina_superstructure(df, spark.createDataFrame([(7,), (8,)], "cell long")).collect()
    assert {r.pid: r.label for r in out} == {1: "floating", 2: "floating", 3: "small", 4: "floating", 5: "small", 6: "ground"}
