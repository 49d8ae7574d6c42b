"""Dense raster kernels in NumPy, and the operators that run them on a group of cells or of points.

A kernel sees one block (a tile with its halo, an instance, a footprint), never a whole survey: the blocks are keyed
rows, and Spark deals them out with ``applyInPandas``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_index(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance in cells, row, column) of the nearest valid cell of each cell: two exact passes of lower envelopes."""
    ny, nx = valid.shape
    big = float(4 * (nx + ny) ** 2)
    d = np.where(valid, 0.0, big)
    row = np.where(valid, np.arange(ny)[:, None], -1)
    # along columns: nearest valid row, from above and from below
    up, low = np.full(nx, -1), np.full(nx, -1)
    best = np.full((ny, nx), big)
    for y in range(ny):
        up = np.where(valid[y], y, up)
        g = np.where(up >= 0, (y - up) ** 2.0, big)
        row[y], best[y] = np.where(g < best[y], up, row[y]), np.minimum(g, best[y])
    for y in range(ny - 1, -1, -1):
        low = np.where(valid[y], y, low)
        g = np.where(low >= 0, (low - y) ** 2.0, big)
        row[y], best[y] = np.where(g < best[y], low, row[y]), np.minimum(g, best[y])
    # along rows: for each cell the column whose column distance plus its own offset is least
    x = np.arange(nx)
    gap = (x[:, None] - x[None, :]) ** 2.0
    out_c = np.zeros((ny, nx), np.int64)
    for y in range(ny):
        cost = gap + best[y][None, :]
        out_c[y] = cost.argmin(1)
        d[y] = cost[x, out_c[y]]
    return np.sqrt(d), np.take_along_axis(row, out_c, 1), out_c


def fill(grid: np.ndarray, method: str = "auto", pix: float = 1.0, k: int = 12, cut: float = 5.0, max_gap: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(filled grid, distance in metres): nearest, inverse distance squared of the k nearest, or auto.

    Auto takes the nearest value below ``cut`` metres and inverse distances beyond.
    """
    valid = ~np.isnan(grid)
    if not valid.any():
        return grid.copy(), np.full(grid.shape, np.inf)
    d, r, c = nearest_index(valid)
    near = grid[r, c]
    out = near.copy()
    want = ~valid if method == "idw" else ~valid & (d * pix >= cut) if method == "auto" else np.zeros_like(valid)
    at, pts = np.argwhere(want), np.argwhere(valid)
    vals = grid[valid]
    for part in np.array_split(at, max(1, len(at) * len(pts) // 4_000_000)):
        if not len(part):
            continue
        d2 = ((part[:, None, :] - pts[None]) ** 2).sum(2)
        n = min(k, len(pts))
        idx = np.argpartition(d2, n - 1, axis=1)[:, :n]
        w = 1.0 / np.maximum(np.take_along_axis(d2, idx, 1), 1e-12)
        out[tuple(part.T)] = (w * vals[idx]).sum(1) / w.sum(1)
    out[valid] = grid[valid]
    if max_gap is not None:
        out[d * pix > max_gap] = np.nan
    return out, d * pix


def h_maxima_markers(height: np.ndarray, h: float) -> np.ndarray:
    """Labels of the tops that rise at least ``h`` over the saddle to any higher top (0 elsewhere)."""
    order = np.argsort(-height, axis=None, kind="stable")
    parent = np.full(height.size, -1)
    top = np.zeros(height.size)
    keep: dict[int, int] = {}
    nx = height.shape[1]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = height.ravel()
    for i in order:
        if np.isnan(flat[i]):
            continue
        y, x = divmod(int(i), nx)
        near = {root(j) for j in _around(y, x, height.shape) if parent[j] >= 0}
        parent[i] = i
        top[i] = flat[i]
        if not near:
            keep[int(i)] = int(i)
            continue
        best = max(near, key=lambda j: (top[j], -j))
        for j in near - {best}:
            if top[j] - flat[i] < h:
                keep.pop(j, None)
            parent[j] = best
        parent[i] = best
    out = np.zeros(height.size, np.int64)
    for k, i in enumerate(sorted(keep), 1):
        out[i] = k
    return out.reshape(height.shape)


def _around(y: int, x: int, shape: tuple[int, int]) -> list[int]:
    ny, nx = shape
    return [b * nx + a for a, b in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1), (x - 1, y - 1), (x + 1, y - 1), (x - 1, y + 1), (x + 1, y + 1)) if 0 <= a < nx and 0 <= b < ny]


def watershed(height: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Every cell with a height goes to the marker that floods it first, from the tops down."""
    out = markers.copy()
    heap = [(-height[tuple(p)], k, tuple(p)) for k, p in enumerate(np.argwhere(markers > 0))]
    heapq.heapify(heap)
    n = len(heap)
    nx = height.shape[1]
    while heap:
        _, _, (y, x) = heapq.heappop(heap)
        for j in _around(y, x, height.shape):
            p = divmod(j, nx)
            if out[p] == 0 and not np.isnan(height[p]):
                out[p] = out[y, x]
                heapq.heappush(heap, (-height[p], n, p))
                n += 1
    return out


def cloth(z: np.ndarray, rigidness: int = 3, rounds: int = 500, step: float = 0.65, gravity: float = 0.2) -> np.ndarray:
    """A cloth let down on the upside-down surface: heights of ground under each cell (NaN cells do not hold it).

    Particles fall by gravity, stop at the surface, and neighbours pull each other level, ``rigidness`` times a round.
    """
    inv = -np.where(np.isnan(z), np.inf, z)
    floor = np.where(np.isinf(inv), -np.inf, inv)
    start = np.nanmax(np.where(np.isinf(floor), np.nan, floor)) + 1.0
    c = np.full(z.shape, start)
    prev = c.copy()
    free = np.ones(z.shape, bool)
    for _ in range(rounds):
        new = np.where(free, c + (c - prev) * 0.99 - gravity * step * step, c)
        prev = c
        c = np.where(new < floor, floor, new)
        free &= c > floor
        for _ in range(rigidness):
            for axis in (0, 1):
                a, b = (c[:-1], c[1:]) if axis == 0 else (c[:, :-1], c[:, 1:])
                fa, fb = (free[:-1], free[1:]) if axis == 0 else (free[:, :-1], free[:, 1:])
                d = (b - a) / 2
                move_a, move_b = np.where(fa & fb, d * 0.5, np.where(fa, d, 0)), np.where(fa & fb, -d * 0.5, np.where(fb, -d, 0))
                if axis == 0:
                    c[:-1] += move_a
                    c[1:] += move_b
                else:
                    c[:, :-1] += move_a
                    c[:, 1:] += move_b
            c = np.maximum(c, floor)
        if np.abs(c - prev).max() < 0.005:
            break
    return -c


def _dense(f: pd.DataFrame, nx: int, ny: int, value: str) -> np.ndarray:
    g = np.full(ny * nx, np.nan)
    g[f["cell"].to_numpy()] = f[value].to_numpy(float)
    return g.reshape(ny, nx)


def fill_cells(cells: DataFrame, nx: int, ny: int, pix: float = 1.0, method: str = "auto", max_gap: float | None = None) -> DataFrame:
    """(block, cell, value, distance, measured) of every cell of each block's grid; (block, cell, value) rows in."""

    def kernel(key, f: pd.DataFrame) -> pd.DataFrame:
        g = _dense(f, nx, ny, "value")
        out, d = fill(g, method, pix, max_gap=max_gap)
        return pd.DataFrame({"block": key[0], "cell": np.arange(nx * ny), "value": out.ravel(), "distance": d.ravel(), "measured": ~np.isnan(g).ravel()}).replace({np.nan: None})

    return cells.select("block", "cell", F.col("value").cast("double").alias("value")).groupBy("block").applyInPandas(kernel, "block long, cell long, value double, distance double, measured boolean")


def ground_filter(points: DataFrame, resolution: float = 1.0, threshold: float = 0.5, block: float = 250.0, halo: float = 25.0, rigidness: int = 3, rounds: int = 500, last_only: bool = True) -> DataFrame:
    """(pid, ground): cloth simulation per block with a halo; a point is written by the block that owns it.

    Points with returns behind them can hold no cloth and are never ground, if ``last_only`` and the columns exist.
    """
    last = F.col("return_number") == F.col("number_of_returns") if last_only and {"return_number", "number_of_returns"} <= set(points.columns) else F.lit(True)
    p = points.select("pid", "x", "y", "z", last.alias("last"))
    for a in "xy":
        lo, hi = (F.floor((F.col(a) + s) / block).cast("long") for s in (-halo, halo))
        p = p.withColumn("b" + a, F.explode(F.sequence(lo, hi)))

    def kernel(key, f: pd.DataFrame) -> pd.DataFrame:
        x, y, z, ok = f["x"].to_numpy(), f["y"].to_numpy(), f["z"].to_numpy(), f["last"].to_numpy(bool)
        cx, cy = np.floor((x - x.min()) / resolution).astype(int), np.floor((y - y.min()) / resolution).astype(int)
        g = np.full((cy.max() + 1, cx.max() + 1), np.inf)
        np.minimum.at(g, (cy[ok], cx[ok]), z[ok])
        g[np.isinf(g)] = np.nan
        if np.isnan(g).all():
            ground = np.zeros(len(f), bool)
        else:
            ground = ok & (np.abs(z - cloth(g, rigidness, rounds)[cy, cx]) <= threshold)
        own = (np.floor(x / block) == key[0]) & (np.floor(y / block) == key[1])
        return pd.DataFrame({"pid": f["pid"][own], "ground": ground[own]})

    return p.groupBy("bx", "by").applyInPandas(kernel, "pid long, ground boolean")


def split_tops(points: DataFrame, pix: float, prominence: float, min_h: float = 0.0, key: str = "inst") -> DataFrame:
    """(pid, key, part): instances cut at the saddles between tops (crowns, cars, boats); (pid, key, x, y, h) in.

    Parts are numbered from 1 by place; cells below ``min_h`` go to the part that floods them, points of cells no top
    reaches keep part 0.
    """

    def kernel(k, f: pd.DataFrame) -> pd.DataFrame:
        cx = np.floor((f["x"] - f["x"].min()) / pix).to_numpy(int)
        cy = np.floor((f["y"] - f["y"].min()) / pix).to_numpy(int)
        g = np.full((cy.max() + 1, cx.max() + 1), -np.inf)
        np.maximum.at(g, (cy, cx), f["h"].to_numpy())
        g[np.isinf(g)] = np.nan
        tops = np.where(g >= min_h, g, np.nan)
        parts = watershed(g, h_maxima_markers(tops, prominence))
        return pd.DataFrame({"pid": f["pid"], key: k[0], "part": parts[cy, cx].astype("int64")})

    return points.select("pid", key, "x", "y", "h").groupBy(key).applyInPandas(kernel, f"pid long, {key} long, part long")


def building_level(cells: DataFrame, footprint: DataFrame, nx: int, ny: int, ring: int = 3, tilt_max: float = 0.02) -> DataFrame:
    """(id, level, tilt, how): one datum a footprint, from the ground heights inside it and the tilt of a ring around.

    ``cells`` is (cell, raw, filled), ``footprint`` (id, cell). The ring is a three-step diamond; its plane comes from
    sums. On level ground the lower quartile holds (a ditch pulls it less than the minimum), else the median.
    """
    from plumbline.operators.stencil import diamond, shifted

    around = shifted(footprint.select("id", "cell"), nx, ny, diamond(ring)).distinct().join(footprint.select("id", "cell"), ["id", "cell"], "left_anti")
    r = around.join(cells.where("raw is not null"), "cell").select("id", (F.col("cell") % nx).alias("cx"), F.floor(F.col("cell") / F.lit(nx)).alias("cy"), "raw")
    s = r.groupBy("id").agg(
        F.count("*").alias("n"), F.covar_pop("cx", "cx").alias("xx"), F.covar_pop("cy", "cy").alias("yy"), F.covar_pop("cx", "cy").alias("xy"), F.covar_pop("cx", "raw").alias("xz"), F.covar_pop("cy", "raw").alias("yz")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    tilt = s.select("id", F.when((F.col("n") >= 8) & (det > 0), F.sqrt(a * a + b * b)).alias("tilt"))
    inside = footprint.join(cells, "cell").groupBy("id").agg(F.percentile("filled", F.lit(0.25)).alias("p25"), F.percentile("filled", F.lit(0.5)).alias("p50"))
    flat = F.coalesce(F.col("tilt") < tilt_max, F.lit(False))
    return inside.join(tilt, "id", "left").select("id", F.when(flat, F.col("p25")).otherwise(F.col("p50")).alias("level"), "tilt", F.when(flat, "p25").otherwise("median").alias("how"))


def balanced_boxes(points: DataFrame, box: tuple[float, float, float, float], max_points: int, min_side: float = 50.0, grid: int = 1024) -> list[tuple[float, float, float, float]]:
    """Boxes of at most ``max_points`` by median cuts of the longer side, down to ``min_side``.

    Cuts come from a histogram of grid x grid bins, so that the driver holds a bounded table whatever the input.
    """
    x0, y0, x1, y1 = box
    sx, sy = (x1 - x0) / grid, (y1 - y0) / grid
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    h = points.where(inside).groupBy(F.floor((F.col("x") - x0) / sx).cast("int").alias("i"), F.floor((F.col("y") - y0) / sy).cast("int").alias("j")).agg(F.count("*").alias("n")).toPandas()
    t = np.zeros((grid, grid))
    t[np.minimum(h["i"], grid - 1), np.minimum(h["j"], grid - 1)] = h["n"]
    out, todo = [], [(0, 0, grid, grid)]
    while todo:
        a, b, c, d = todo.pop()
        part = t[a:c, b:d]
        wide, high = (c - a) * sx, (d - b) * sy
        axis = 0 if wide >= high else 1
        if part.sum() <= max_points or max(wide, high) < 2 * min_side:
            out.append((x0 + a * sx, y0 + b * sy, x0 + c * sx, y0 + d * sy))
            continue
        run = part.sum(1 - axis).cumsum()
        k = int(np.searchsorted(run, run[-1] / 2)) + 1
        least = max(1, int(np.ceil(min_side / (sx if axis == 0 else sy))))
        k = min(max(k, least), len(run) - least)
        todo += [(a, b, a + k, d), (a + k, b, c, d)] if axis == 0 else [(a, b, c, b + k), (a, b + k, c, d)]
    return sorted(out)
