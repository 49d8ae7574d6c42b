"""Cell and voxel tables over points: ids, evidence, rasters with honest intervals, surfaces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.window import Box, inside_half_open, not_noise

VEGETATION = (3, 4, 5)


def shape_for(b: Box, pix: float) -> tuple[int, int]:
    """(rows, columns), rounded half to even."""
    return round((b[3] - b[1]) / pix), round((b[2] - b[0]) / pix)


def _trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def _clamp(c: Column, top: int) -> Column:
    return F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(top).cast("long"))


def cell_north(b: Box, pix: float) -> Column:
    """Raster cell id, rows counted from the north edge; the far edges fall into the last cells."""
    ny, nx = shape_for(b, pix)
    col = _clamp(_trunc((F.col("x") - F.lit(float(b[0]))) / F.lit(float(pix))), nx - 1)
    row = _clamp(_trunc((F.lit(float(b[3])) - F.col("y")) / F.lit(float(pix))), ny - 1)
    return row * F.lit(nx).cast("long") + col


def width_south(b: Box, pix: float) -> int:
    return math.ceil((b[2] - b[0]) / pix)


def cell_south(b: Box, pix: float) -> Column:
    """Table cell id, rows counted from the south edge."""
    nx = width_south(b, pix)
    cx = F.least(F.floor((F.col("x") - F.lit(float(b[0]))) / F.lit(float(pix))).cast("long"), F.lit(nx - 1).cast("long"))
    cy = F.floor((F.col("y") - F.lit(float(b[1]))) / F.lit(float(pix))).cast("long")
    return cy * F.lit(nx).cast("long") + cx


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def cell_evidence(points: DataFrame, b: Box, pix: float = 1.0) -> DataFrame:
    """Per cell: returns, lowest and highest, share of split pulses, ground and water returns. One shuffle."""
    p = points.where(inside_half_open(b) & not_noise())
    return p.groupBy(cell_south(b, pix).alias("cell")).agg(
        F.count("*").alias("n"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
        _share(F.col("return_number") < F.col("number_of_returns")).alias("split_share"),
        F.count_if(F.col("classification") == 2).alias("n_ground"),
        F.count_if(F.col("classification") == 9).alias("n_water"),
    )


def voxel_evidence(points: DataFrame, b: Box, pix: float = 1.0, step: float = 0.5) -> DataFrame:
    """The same per cell and height level, with building and vegetation counts."""
    p = points.where(inside_half_open(b) & not_noise())
    return p.groupBy(cell_south(b, pix).alias("cell"), F.floor(F.col("z") / F.lit(step)).cast("long").alias("level")).agg(
        F.count("*").alias("n"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
        _share(F.col("return_number") < F.col("number_of_returns")).alias("split_share"),
        F.count_if(F.col("classification") == 2).alias("n_ground"),
        F.count_if(F.col("classification") == 9).alias("n_water"),
        F.count_if(F.col("classification") == 6).alias("n_building"),
        F.count_if(F.col("classification").isin(*VEGETATION)).alias("n_veg"),
    )


def raster(points: DataFrame, b: Box, pix: float = 1.0, how: str = "max", values: str = "z", mask: Column | None = None) -> DataFrame:
    """(cell, value): the extremum of a field; cells without evidence have no row."""
    p = points.where(inside_half_open(b))
    if mask is not None:
        p = p.where(mask)
    return p.groupBy(cell_north(b, pix).alias("cell")).agg((F.max if how == "max" else F.min)(values).alias("value"))


def at_extremum(points: DataFrame, b: Box, pix: float, field: str, how: str = "max", values: str = "z") -> DataFrame:
    """(cell, value): another field of the return that won the cell; ties go to the larger id."""
    key = F.struct(F.col(values) if how == "max" else -F.col(values), F.col("pid"))
    return points.where(inside_half_open(b)).groupBy(cell_north(b, pix).alias("cell")).agg(F.max_by(field, key).alias("value"))


def surfaces(points: DataFrame, b: Box, pix: float = 1.0) -> DataFrame:
    """Top, ground, canopy and roof heights in one aggregation."""
    z, c = F.col("z"), F.col("classification")
    return points.where(inside_half_open(b)).groupBy(cell_north(b, pix).alias("cell")).agg(
        F.max("z").alias("dsm"),
        F.min(F.when(c == 2, z)).alias("dtm"),
        F.max(F.when(c.isin(*VEGETATION), z)).alias("canopy"),
        F.max(F.when(c == 6, z)).alias("roofs"),
    )


def interval(points: DataFrame, b: Box, pix: float = 1.0, how: str = "max", quantile: float = 0.9) -> DataFrame:
    """An estimate per cell: value, lo, hi, n, method (0 none, 1 spread, 2 passes), bulk_gap, balance.

    Passes over the cell from two or more flight lines bound the value by the lines' own extrema; else the spread of
    the returns does. Middles are upper medians. The sorted heights of a cell are gathered only for cells of one line.
    """
    agg = F.max if how == "max" else F.min
    p = points.where(inside_half_open(b)).select(cell_north(b, pix).alias("cell"), "point_source_id", "z")
    # a cell and line hold few returns at survey density; the array is sorted once for middle and spread
    per = p.groupBy("cell", "point_source_id").agg(
        agg("z").alias("e"), F.count("*").alias("c"), F.array_sort(F.collect_list("z")).alias("zs")
    )
    q = quantile if how == "max" else 1 - quantile
    per = per.withColumn("mid", F.element_at("zs", (F.floor(F.col("c") / 2) + 1).cast("int"))).withColumn(
        "bound", F.element_at("zs", (F.floor(F.lit(q) * (F.col("c") - 1)) + 1).cast("int"))
    )
    cells = per.groupBy("cell").agg(
        agg("e").alias("value"), F.sum("c").alias("n"), F.count("*").alias("lines"), F.min("e").alias("e_lo"), F.max("e").alias("e_hi"),
        F.first("bound").alias("bound"), (F.max("mid") - F.min("mid")).alias("gap"), (F.min("c") / F.max("c")).alias("bal"),
    )
    multi, many = F.col("lines") > 1, F.col("n") > 1
    one_lo = F.when(many, F.least("bound", "value")).otherwise(F.col("value")) if how == "max" else F.col("value")
    one_hi = F.col("value") if how == "max" else F.when(many, F.greatest("bound", "value")).otherwise(F.col("value"))
    return cells.select(
        "cell", "value",
        F.when(multi, F.col("e_lo")).otherwise(one_lo).alias("lo"),
        F.when(multi, F.col("e_hi")).otherwise(one_hi).alias("hi"),
        "n",
        F.when(multi, 2).when(many, 1).otherwise(0).cast("int").alias("method"),
        F.when(multi, F.col("gap")).alias("bulk_gap"),
        F.when(multi, F.col("bal")).alias("balance"),
    )


def width() -> Column:
    return F.col("hi") - F.col("lo")


def trusted(max_width: float = 0.5, min_returns: int = 1) -> Column:
    return (width() <= F.lit(max_width)) & (F.col("n") >= min_returns)


def surface_kind(bulk_m: float = 0.5, thin: float = 0.2) -> Column:
    """0 unknown, 1 flat, 2 clipped, 3 stepped, 4 undersampled."""
    return (
        F.when(F.col("bulk_gap").isNull(), 0).when(F.col("balance") < thin, 4).when(F.col("bulk_gap") > bulk_m, 3).when(width() > bulk_m, 2).otherwise(1).cast("int")
    )


def estimate_summary(est: DataFrame) -> DataFrame:
    """One row: cells, width percentiles, shares by width, method and kind."""
    k = est.withColumn("w", width()).withColumn("kind", surface_kind())
    return k.agg(
        F.count("*").alias("cells"),
        F.percentile("w", F.lit(0.5)).alias("width_p50"), F.percentile("w", F.lit(0.9)).alias("width_p90"), F.percentile("w", F.lit(0.99)).alias("width_p99"),
        _share(F.col("w") <= 0.5).alias("within_half"),
        *[_share(F.col("method") == m).alias(f"method_{m}") for m in range(3)],
        *[_share(F.col("kind") == m).alias(f"kind_{m}") for m in range(5)],
    )


def cell_quantile(points: DataFrame, b: Box, pix: float, q: float = 0.25, min_n: int = 1) -> DataFrame:
    return (
        points.where(inside_half_open(b)).groupBy(cell_south(b, pix).alias("cell"))
        .agg(F.percentile("z", F.lit(q)).alias("value"), F.count("*").alias("n")).where(F.col("n") >= min_n).select("cell", "value")
    )


def footprint(points: DataFrame, b: Box, pix: float = 1.0) -> DataFrame:
    """The cells that a set of points occupies; points out of the window are dropped."""
    return points.where(inside_half_open(b)).select(cell_north(b, pix).alias("cell")).distinct()


def topmost(points: DataFrame, b: Box, pix: float, field: str) -> DataFrame:
    return points.where(inside_half_open(b)).groupBy(cell_south(b, pix).alias("cell")).agg(F.max_by(field, F.struct("z", "pid")).alias("value"))


def height_above_cell_min(points: DataFrame, b: Box, pix: float = 1.0) -> DataFrame:
    """(pid, hag): height over the lowest return of the cell; a window aggregate on the cell's own partition."""
    p = points.where(inside_half_open(b)).withColumn("cell", cell_south(b, pix))
    return p.select("pid", "cell", (F.col("z") - F.min("z").over(Window.partitionBy("cell"))).alias("hag"))


def crown_thin(points: DataFrame, cell: float = 0.28, few: int = 400) -> DataFrame:
    """The first return of every small voxel; up to ``few`` points are left as they are."""
    n = points.agg(F.count("*").alias("n"))
    key = [F.floor(F.col(a) / F.lit(cell)) for a in "xyz"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("pid"))
    return points.withColumn("_turn", turn).crossJoin(F.broadcast(n)).where((F.col("n") <= few) | (F.col("_turn") == 1)).drop("_turn", "n")


def column_gaps(voxels: DataFrame, ground: DataFrame, step: float = 0.5, floor_band: float = 0.3, min_gap: float = 1.5, max_h: float = 30.0, h: float = 10.0) -> DataFrame:
    """(cell, gap, supported): longest empty run of height bands below ``h`` over each cell's ground."""
    lo, hi = math.floor(floor_band / step), math.ceil(h / step)
    bands = (
        voxels.join(ground, "cell").withColumn("band", F.col("level") - F.floor(F.col("ground_z") / F.lit(step)).cast("long"))
        .where((F.col("band") >= 0) & (F.col("band") < int(max_h / step))).select("cell", "band").distinct()
    )
    at = F.filter(F.sort_array(F.collect_set("band")), lambda v: (v >= lo) & (v < hi))
    whole = ground.select("cell").join(bands.groupBy("cell").agg(at.alias("at")), "cell", "left").withColumn("at", F.coalesce("at", F.array().cast("array<bigint>")))
    edge = F.concat(F.array(F.lit(lo - 1).cast("long")), F.col("at"), F.array(F.lit(hi).cast("long")))
    run = F.array_max(F.zip_with(F.slice(edge, 2, F.size(edge) - 1), F.slice(edge, 1, F.size(edge) - 1), lambda b, a: b - a - 1))
    return whole.select("cell", (run * F.lit(step)).alias("gap")).withColumn("supported", F.col("gap") <= min_gap)
