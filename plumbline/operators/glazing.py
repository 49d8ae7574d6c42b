"""The trial of glazing suspects: which points claimed by both glass and trees are glass, in a fixed order of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.stencil import box_sums, voxel_components


def convict(points: DataFrame, nx: int, ny: int, path: float = 0.25, alone: float = 0.15, far: float = 60.0, majority: float = 0.5) -> DataFrame:
    """(pid, convicted, veg_high, building) after the trial.

    Rows in: pid, cell, zb, cont (contested), sub, geo (distance to the ground through no building; null is infinite),
    cube, scatter, exg, inside, hag, not_last, veg_high, building. Order: far and clear of scatter, or clear enough
    alone; whole panes by majority; rescue of green and rough surroundings; roofs inside outlines; last-return filter.
    """
    geo = F.coalesce("geo", F.when(F.col("sub"), F.lit(float("inf"))))
    first = F.col("cont") & ((F.coalesce(geo >= far, F.lit(False)) & (F.col("cube") < path)) | (F.col("cube") < alone))
    p = points.withColumn("c1", first)
    panes = voxel_components(p.where("cont").select("cell", "zb"), nx, ny)
    lab = p.where("cont").join(panes, ["cell", "zb"])
    guilty = lab.groupBy("component").agg(F.avg(F.col("c1").cast("double")).alias("s")).where(F.col("s") >= majority).select("component")
    whole = lab.join(guilty, "component", "left_semi").select("pid").withColumn("pane", F.lit(True))
    p = p.join(whole, "pid", "left").withColumn("c2", F.col("c1") | F.coalesce("pane", F.lit(False)))
    near = box_sums(p, nx, ny, 1, _n=F.lit(1), _rough=(F.col("scatter") >= 0.2).cast("int"), _green=F.greatest(F.least("exg", F.lit(1.0)), F.lit(-1.0)))
    p = p.join(near, "cell", "left")
    free = (F.col("_rough") / F.col("_n") >= 0.5) & (F.col("_green") / F.col("_n") > 0.02)
    p = p.withColumn("convicted", F.col("c2") & ~free)
    p = p.withColumn("veg1", F.col("veg_high") & ~F.col("convicted"))
    roof = F.col("veg1") & F.col("inside") & ~F.col("cont") & (F.col("hag") > 2) & (F.col("cube") < alone)
    p = p.withColumn("veg2", F.col("veg1") & ~roof).withColumn("b1", F.col("building") | roof)
    per = p.groupBy("cell").agg(F.count_if("veg2").alias("nv"), F.count_if("b1").alias("nb"))
    drop = F.col("b1") & F.col("not_last") & (F.col("nv") > 6 * F.col("nb"))
    return p.join(per, "cell").select("pid", "convicted", F.col("veg2").alias("veg_high"), (F.col("b1") & ~drop).alias("building"))
