"""Terrain with its provenance, boundaries by local rank, and separate structures, on a window's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.cells import cell_south, raster, shape_for
from plumbline.operators.raster import fill_cells, ground_filter
from plumbline.operators.stencil import cell_components, hysteresis, opening, square
from plumbline.operators.views import echo_multi, edge_strength
from plumbline.operators.window import Box, inside_half_open
from plumbline.session import materialise


def dem(points: DataFrame, b: Box, pix: float = 1.0, ground: Column | None = None, method: str = "auto", max_gap: float | None = None) -> DataFrame:
    """(cell, dtm, filled, distance, dsm): lowest ground return, the same with holes filled, metres to the nearest
    measured cell, and the top of everything; ``ground`` defaults to the survey's own class 2.

    Every cell of the window has a row. Without ground returns nothing can be filled: filled is null, distance infinite.
    """
    ny, nx = shape_for(b, pix)
    mask = F.col("classification") == 2 if ground is None else ground
    low = raster(points, b, pix, "min", "z", mask).select("cell", F.col("value").cast("double").alias("value"))
    top = raster(points, b, pix, "max").select("cell", F.col("value").cast("double").alias("dsm"))
    grid = points.sparkSession.range(nx * ny).withColumnRenamed("id", "cell")
    every = grid.join(low, "cell", "left").withColumn("block", F.lit(0).cast("long"))
    out = fill_cells(every, nx, ny, pix, method, max_gap)
    return out.select("cell", F.when(F.col("measured"), F.col("value")).alias("dtm"), F.col("value").alias("filled"), "distance").join(top, "cell", "left")


def dem_stats(dem_cells: DataFrame, far: float = 5.0) -> DataFrame:
    """One row: share of cells without ground, share far from any, the greatest distance."""
    return dem_cells.agg(
        F.avg(F.col("dtm").isNull().cast("double")).alias("void"), F.avg((F.col("distance") > far).cast("double")).alias("far_from_evidence"),
        F.max("distance").alias("max_distance"),
    )


def ground_cells(points: DataFrame, b: Box, pix: float = 1.0, **cloth) -> DataFrame:
    """(cell, ground_z, distance, measured): bare earth of every cell of the window, from points that the cloth keeps."""
    ny, nx = shape_for(b, pix)
    kept = ground_filter(points, **cloth).where("ground").select("pid")
    p = points.join(kept, "pid", "left_semi").where(inside_half_open(b))
    low = p.groupBy(cell_south(b, pix).alias("cell")).agg(F.min("z").cast("double").alias("value"))
    every = points.sparkSession.range(nx * ny).withColumnRenamed("id", "cell").join(low, "cell", "left").withColumn("block", F.lit(0).cast("long"))
    return fill_cells(every, nx, ny, pix).select("cell", F.col("value").alias("ground_z"), "distance", "measured")


def mirrored(cells: DataFrame, nx: int, ny: int, r: int) -> DataFrame:
    """Rows (cell, ...) at (sx, sy), and again where a border of r cells mirrors them (edge cells stand twice)."""
    if r > min(nx, ny):
        raise ValueError("the neighbourhood reaches beyond the mirrored grid")

    def spots(at: Column, n: int) -> Column:
        return F.filter(F.array(at, -at - 1, 2 * n - 1 - at), lambda s: (s >= -r) & (s <= n - 1 + r))

    x, y = F.col("cell") % nx, F.floor(F.col("cell") / F.lit(nx))
    out = cells.withColumn("sx", F.explode(spots(x, nx)))
    return out.withColumn("sy", F.explode(spots(y, ny)))


def _around(spots: DataFrame, nx: int, ny: int, r: int, dx: bool = True, dy: bool = True) -> DataFrame:
    """Each mirrored row once for every cell whose neighbourhood of r cells holds it."""
    for on, axis, n in ((dx, "sx", nx), (dy, "sy", ny)):
        if on:
            lo, hi = F.greatest(F.col(axis) - r, F.lit(0)), F.least(F.col(axis) + r, F.lit(n - 1))
            spots = spots.where(lo <= hi).withColumn(axis, F.explode(F.sequence(lo, hi)))
    inside = F.col("sx").between(0, nx - 1) & F.col("sy").between(0, ny - 1)
    return spots.where(inside).withColumn("cell", (F.col("sy") * nx + F.col("sx")).cast("long")).drop("sx", "sy")


def percentile_filter(cells: DataFrame, nx: int, ny: int, pct: float, size: int) -> DataFrame:
    """(cell, ref): the value at a percentile of the size x size cells around; (cell, v) of every cell of the grid in.

    The border mirrors; the rank is rounded down.
    """
    n = size * size
    rank = n - 1 if pct >= 100 else int(n * pct / 100)
    near = _around(mirrored(cells.select("cell", "v"), nx, ny, size // 2), nx, ny, size // 2)
    return near.groupBy("cell").agg(F.element_at(F.array_sort(F.collect_list("v")), rank + 1).alias("ref"))


def minimum_filter(cells: DataFrame, nx: int, ny: int, size: int) -> DataFrame:
    """(cell, ref): the least value of the size x size cells around; rows first, then columns."""
    r = size // 2
    for dx in (True, False):
        near = _around(mirrored(cells.select("cell", "v"), nx, ny, r), nx, ny, r, dx, not dx)
        cells = near.groupBy("cell").agg(F.min("v").alias("v"))
    return cells.withColumnRenamed("v", "ref")


def local_boundary(strength: DataFrame, nx: int, ny: int, size: int = 15, nbr_pct: float = 50, t1_pct: float = 95, t2_pct: float = 75) -> DataFrame:
    """Cells of a boundary: stronger than an absolute cut, or above a floor and not below their neighbourhood.

    (cell, strength) rows in; cuts are percentiles of the strengths that there are, and a cell without one counts as 0.
    """
    cuts = strength.agg(F.percentile("strength", F.lit(t1_pct / 100)).alias("t1"), F.percentile("strength", F.lit(t2_pct / 100)).alias("t2"))
    grid = strength.sparkSession.range(nx * ny).withColumnRenamed("id", "cell")
    v = grid.join(strength.select("cell", "strength"), "cell", "left").select("cell", F.coalesce("strength", F.lit(0.0)).alias("v"))
    ref = percentile_filter(v, nx, ny, nbr_pct, size)
    j = v.join(ref, "cell").crossJoin(F.broadcast(cuts))  # one row
    return j.where((F.col("v") > F.col("t1")) | ((F.col("v") > F.col("t2")) & (F.col("v") >= F.col("ref")))).select("cell")


def instances(
    points: DataFrame, b: Box, pix: float = 1.0, floor: DataFrame | None = None, edge: float = 0.5, edge_low: float | None = 0.15, min_height: float = 2.0,
    min_area: float = 30.0, by: str = "point_source_id", veg_ratio: float | None = 0.8, span: int | None = None,
) -> DataFrame:
    """(cell, inst): separate structures, numbered from 1 by their first cells: tall cells that are no boundary.

    ``floor`` (cell, z) is the ground under every cell; without it, the least top within 51 m stands in. Boundaries
    are linked by hysteresis (a single cut if ``edge_low`` is None); contours are not closed by watershed lines.
    """
    ny, nx = shape_for(b, pix)
    grid = points.sparkSession.range(nx * ny).withColumnRenamed("id", "cell")
    top = materialise(raster(points, b, pix, "max").select("cell", F.col("value").cast("double").alias("v")), "top")
    if floor is None:
        least = top.agg(F.min("v").alias("least"))
        every = grid.join(top, "cell", "left").crossJoin(F.broadcast(least)).select("cell", F.coalesce("v", "least").alias("v"))  # one row
        floor = minimum_filter(every, nx, ny, (span or round(51 / pix)) | 1).select("cell", F.col("ref").alias("z"))
    tall = top.join(floor.select("cell", "z"), "cell").where(F.col("v") - F.col("z") > min_height).select("cell")
    if veg_ratio is not None:
        leafy = echo_multi(points, b, pix).where(F.col("ratio") > veg_ratio).select("cell")
        tall = tall.join(leafy, "cell", "left_anti")
    strength = edge_strength(points, b, pix, by).where("strength is not null")
    edges = strength.where(F.col("strength") > edge).select("cell") if edge_low is None else hysteresis(strength, nx, ny, edge, edge_low)
    core = materialise(opening(tall.join(edges, "cell", "left_anti"), nx, ny, square(1)), "core")
    lab = cell_components(core, nx, ny, 4)
    # one row a structure, not a cell
    large = lab.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") * pix * pix >= min_area)
    order = large.select("component", F.row_number().over(Window.orderBy("component")).alias("inst"))
    return lab.join(order, "component").select("cell", "inst")
