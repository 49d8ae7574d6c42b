"""Neighbourhood operators on sparse cell tables, as equi-joins on shifted cell ids.

A cell table holds (cell, ...) with cell = row * nx + col; a mask is a table of cells. Shifted copies are made with
one explode and summed with one aggregation, so a stencil is one shuffle on the cell id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.session import materialise


def square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def diamond(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square(r) if abs(dx) + abs(dy) <= r]


CROSS = diamond(1)


def shifted(cells: DataFrame, nx: int, ny: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every row once for each offset, with ``cell`` moved; what leaves the grid is dropped."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    out = cells.withColumn("_o", F.explode(steps))
    cx, cy = F.col("cell") % nx + F.col("_o.dx"), F.floor(F.col("cell") / F.lit(nx)) + F.col("_o.dy")
    ok = (cx >= 0) & (cx < nx) & (cy >= 0) & (cy < ny)
    return out.where(ok).withColumn("cell", (cy * nx + cx).cast("long")).drop("_o")


def dilate(mask: DataFrame, nx: int, ny: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return shifted(mask.select("cell"), nx, ny, offsets).distinct()


def erode(mask: DataFrame, nx: int, ny: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells whose whole neighbourhood is in the mask; outside the grid counts as outside the mask."""
    hit = shifted(mask.select("cell"), nx, ny, [(-dx, -dy) for dx, dy in offsets]).groupBy("cell").agg(F.count("*").alias("c"))
    return hit.where(F.col("c") == len(offsets)).select("cell")


def opening(mask: DataFrame, nx: int, ny: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, nx, ny, offsets), nx, ny, offsets)


def closing(mask: DataFrame, nx: int, ny: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(mask, nx, ny, offsets), nx, ny, offsets)


def box_sums(cells: DataFrame, nx: int, ny: int, r: int, **sums: Column) -> DataFrame:
    """(cell, ...): sums over the (2r+1)^2 cells around each cell that has any evidence there."""
    t = cells.select("cell", *[c.alias(k) for k, c in sums.items()])
    return shifted(t, nx, ny, square(r)).groupBy("cell").agg(*[F.sum(k).alias(k) for k in sums])


def cell_components(mask: DataFrame, nx: int, ny: int, connectivity: int = 8) -> DataFrame:
    """(cell, component): connected components of a mask, named by their smallest cell."""
    offs = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if connectivity == 8 else [])
    pairs = shifted(mask.select("cell", F.col("cell").alias("src")), nx, ny, offs)
    edges = pairs.join(mask.select("cell"), "cell").select("src", F.col("cell").alias("dst"))
    lone = mask.select(F.col("cell").alias("src"), F.col("cell").alias("dst"))
    return connected_components(edges.unionByName(lone)).select(F.col("node").alias("cell"), "component")


def keep_large(mask: DataFrame, nx: int, ny: int, least: int, connectivity: int = 8) -> DataFrame:
    """Cells of components with ``least`` cells or more, with their component."""
    lab = cell_components(mask, nx, ny, connectivity)
    big = lab.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("component")
    return lab.join(big, "component")


def hysteresis(cells: DataFrame, nx: int, ny: int, hi: float = 0.5, lo: float = 0.15, value: str = "strength") -> DataFrame:
    """Cells above ``lo`` that hang together, 4-connected, with a cell above ``hi``."""
    weak = cells.where(F.col(value) > lo).select("cell", value)
    lab = cell_components(weak, nx, ny, 4).join(weak, "cell")
    strong = lab.groupBy("component").agg(F.max(value).alias("top")).where(F.col("top") > hi).select("component")
    return lab.join(strong, "component", "left_semi").select("cell")


def holes(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells outside the mask that no 4-connected way outside it ties to the border."""
    spark = mask.sparkSession
    grid = spark.range(nx * ny).withColumnRenamed("id", "cell")
    out = cell_components(grid.join(mask.select("cell"), "cell", "left_anti"), nx, ny, 4)
    x, y = F.col("cell") % nx, F.floor(F.col("cell") / F.lit(nx))
    rim = out.where((x == 0) | (x == nx - 1) | (y == 0) | (y == ny - 1)).select("component").distinct()
    return out.join(rim, "component", "left_anti")


def fill_holes(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    return mask.select("cell").unionByName(holes(mask, nx, ny).select("cell"))


def water_seeds(cells: DataFrame, nx: int, ny: int, low: float = 0.5, sparse: int = 8, least: int = 400, local_mean: float = 6.0) -> DataFrame:
    """Cells that look like open water: (cell, ground_z, n, min_z) rows in, seed cells out.

    Sparse and low cells, closed 5 x 5, in components of ``least`` cells; and cells that are sparse in the mean of
    5 x 5, where a 9 x 9 vote agrees.
    """
    thin = cells.where((F.col("n") > 0) & (F.col("n") <= sparse) & ((F.col("min_z") - F.col("ground_z")) < low)).select("cell")
    region = keep_large(closing(thin, nx, ny, square(2)), nx, ny, least, 4).select("cell")
    near = box_sums(cells, nx, ny, 2, s=F.col("n"))
    grid = cells.sparkSession.range(nx * ny).withColumnRenamed("id", "cell")
    local = grid.join(near, "cell", "left").where(F.coalesce("s", F.lit(0)) / F.lit(25.0) <= local_mean).select("cell")
    both = region.unionByName(local).distinct()
    vote = box_sums(both, nx, ny, 4, s=F.lit(1)).where(F.col("s") / F.lit(81.0) >= 0.5).select("cell")
    return region.unionByName(both.join(vote, "cell", "left_semi")).distinct()


def flood(seeds: DataFrame, surface: DataFrame, level: float | None, nx: int, ny: int, tol: float = 0.4, deck_tol: float | None = None) -> DataFrame:
    """(cell, body): water spread from seed cells over a surface (cell, z, n_ground) that stays near the level."""
    mask = seeds.select("cell")
    if level is not None:
        ok = F.col("z") <= level + tol
        if deck_tol is not None:
            ok = ok | ((F.col("n_ground") == 0) & (F.col("z") <= level + deck_tol))
        mask = mask.unionByName(surface.where(ok).select("cell")).distinct()
    lab = cell_components(mask, nx, ny, 4)
    wet = materialise(lab.join(lab.join(seeds, "cell", "left_semi").select("component").distinct(), "component", "left_semi").select("cell"), "wet")
    return cell_components(fill_holes(wet, nx, ny), nx, ny, 8).select("cell", F.col("component").alias("body"))


def bridge_deck(evidence: DataFrame, nx: int, ny: int, echo: float = 0.5, least: int = 300) -> DataFrame:
    """Cells of decks: (cell, below, ratio) in; a return far below the top and hard echoes, opened 3 x 3, large."""
    cand = evidence.where(F.col("below") & (F.coalesce("ratio", F.lit(1.0)) < echo)).select("cell")
    return keep_large(opening(cand, nx, ny, square(1)), nx, ny, least, 8)


def void_report(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """One row: share of filled cells, number of empty 4-connected areas, cells of the largest."""
    grid = cells.sparkSession.range(nx * ny).withColumnRenamed("id", "cell")
    void = cell_components(grid.join(cells.select("cell"), "cell", "left_anti"), nx, ny, 4)
    size = void.groupBy("component").agg(F.count("*").alias("c"))
    return size.agg(
        (F.lit(1.0) - F.coalesce(F.sum("c"), F.lit(0)) / F.lit(float(nx * ny))).alias("filled"), F.count("*").alias("n_holes"), F.coalesce(F.max("c"), F.lit(0)).alias("largest")
    )


def cube_scatter(points: DataFrame, nx: int, ny: int, bins: int = 60) -> DataFrame:
    """(pid, cube): mean scatter of the 27 voxels around each point's; (pid, cell, hag, scatter) rows in."""
    z = F.floor(F.least(F.greatest(F.col("hag"), F.lit(0.0)), F.lit(bins - 0.1))).cast("long")
    p = points.select("pid", "cell", z.alias("zb"), "scatter")
    vox = p.groupBy("cell", "zb").agg(F.sum("scatter").alias("s"), F.count("*").alias("n"))
    tall = vox.withColumn("dz", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("zb", F.col("zb") + F.col("dz")).where((F.col("zb") >= 0) & (F.col("zb") < bins)).drop("dz")
    near = shifted(tall, nx, ny, square(1)).groupBy("cell", "zb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return p.join(near, ["cell", "zb"]).select("pid", (F.col("s") / F.greatest("n", F.lit(1))).alias("cube"))


def voxel_components(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    """(cell, zb, component): 26-connected components of occupied voxels (cell, zb)."""
    key = F.col("zb") * F.lit(nx * ny).cast("long") + F.col("cell")
    v = voxels.select("cell", "zb").distinct()
    half = [(dx, dy, 1) for dx, dy in square(1)] + [(1, 0, 0), (0, 1, 0), (1, 1, 0), (-1, 1, 0)]
    parts = None
    for dz in (0, 1):
        offs = [(dx, dy) for dx, dy, z in half if z == dz]
        part = shifted(v.select("cell", (F.col("zb") + dz).alias("zb"), key.alias("src")), nx, ny, offs)
        parts = part if parts is None else parts.unionByName(part)
    edges = parts.join(v, ["cell", "zb"]).select("src", key.alias("dst"))
    lone = v.select(key.alias("src"), key.alias("dst"))
    lab = connected_components(edges.unionByName(lone))
    return lab.select((F.col("node") % (nx * ny)).alias("cell"), F.floor(F.col("node") / F.lit(nx * ny)).alias("zb"), "component")
