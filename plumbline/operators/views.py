"""Statistics by view: echoes, look directions, strength of edges, movement between passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.cells import cell_north, cell_south
from plumbline.operators.window import Box, inside_half_open


def echo_multi(points: DataFrame, b: Box, pix: float = 1.0, min_n: int = 4) -> DataFrame:
    """(cell, ratio): share of returns of split pulses; null below ``min_n`` returns."""
    g = points.where(inside_half_open(b)).groupBy(cell_north(b, pix).alias("cell"))
    return g.agg(
        F.when(F.count("*") >= min_n, F.avg(F.when(F.col("number_of_returns") > 1, 1.0).otherwise(0.0))).alias("ratio")
    )


def angle_rank(points: DataFrame, b: Box, pix: float = 1.0, max_rank: int = 4) -> DataFrame:
    """(cell, line, rank): lines over a cell from the steepest look to the flattest, capped."""
    g = points.where(inside_half_open(b)).groupBy(cell_north(b, pix).alias("cell"), F.col("point_source_id").alias("line"))
    a = g.agg((F.sum(F.abs(F.col("scan_angle").cast("long"))) / F.count("*") * F.lit(0.006)).alias("angle"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("angle", "line")) - 1
    return a.select("cell", "line", F.least(rank, F.lit(max_rank - 1)).cast("int").alias("rank"))


def headings(points: DataFrame) -> DataFrame:
    """(line, heading): degrees from north of each line's travel, by least squares of x and y on time."""
    g = points.groupBy(F.col("point_source_id").alias("line")).agg(
        F.regr_slope("x", "gps_time").alias("vx"), F.regr_slope("y", "gps_time").alias("vy")
    )
    return g.select("line", F.pmod(F.degrees(F.atan2("vx", "vy")) + 360.0, F.lit(360.0)).alias("heading"))


def look_azimuth(points: DataFrame) -> DataFrame:
    """Points with ``azimuth`` of their beam: heading turned by a right angle to the side of the scan angle."""
    h = headings(points)
    side = F.when(F.col("scan_angle") >= 0, 90.0).otherwise(-90.0)
    return points.join(F.broadcast(h), points["point_source_id"] == h["line"]).withColumn(
        "azimuth", F.pmod(F.col("heading") + side + 360.0, F.lit(360.0))
    ).drop("line", "heading")


def viewed_quadrant() -> Column:
    """The quarter that a point is seen from, out of its beam's azimuth."""
    seen = F.pmod(F.col("azimuth") + 180.0, F.lit(360.0))
    return F.floor(F.pmod(seen + 45.0, F.lit(360.0)) / 90.0).cast("int")


def bundle_codes(looks: list[tuple[int, int, float, int]], parts: int) -> dict[tuple[int, int], int]:
    """Looks (line, side, azimuth, returns) merged, closest pair first, into ``parts`` bundles, coded by azimuth.

    A survey has a few looks a line, so this small agglomeration runs on the driver.
    """

    def centre(group):
        s = sum(n * math.sin(math.radians(a)) for _, _, a, n in group)
        c = sum(n * math.cos(math.radians(a)) for _, _, a, n in group)
        return math.degrees(math.atan2(s, c)) % 360

    groups = [[x] for x in sorted(looks)]
    while len(groups) > parts:
        mid = [centre(g) for g in groups]
        gap = lambda i, j: abs((mid[i] - mid[j] + 180) % 360 - 180)  # noqa: B023, E731
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: gap(*p))
        groups[i] += groups.pop(j)
    groups.sort(key=centre)
    return {(line, side): k for k, g in enumerate(groups) for line, side, _, _ in g}


def viewed_from(points: DataFrame, parts: int) -> DataFrame:
    """Points with ``view``: the bundle of looks they are seen from."""
    side = F.when(F.col("scan_angle") >= 0, 1).otherwise(-1)
    az = look_azimuth(points).withColumn("side", side).withColumn("seen", F.pmod(F.col("azimuth") + 180.0, F.lit(360.0)))
    looks = az.groupBy("point_source_id", "side").agg(F.min("seen").alias("a"), F.count("*").alias("n")).collect()  # two rows a line at most
    codes = bundle_codes([(r["point_source_id"], r["side"], r["a"], r["n"]) for r in looks], parts)
    table = points.sparkSession.createDataFrame([(*k, v) for k, v in codes.items()], "point_source_id long, side int, view int")
    return az.join(F.broadcast(table), ["point_source_id", "side"]).drop("azimuth", "seen", "side")


def edge_strength(points: DataFrame, b: Box, pix: float = 1.0, by: str = "point_source_id", floor: float = 0.0) -> DataFrame:
    """(cell, strength): geometric mean, over views with two or more returns, of their spread (top to lower bound).

    Any view that sees no spread makes it zero; without views that see anything it is null.
    """
    p = points.where(inside_half_open(b)).select(cell_north(b, pix).alias("cell"), F.col(by).alias("view"), "z")
    v = p.groupBy("cell", "view").agg(F.max("z").alias("top"), F.count("*").alias("c"), F.array_sort(F.collect_list("z")).alias("zs"))
    low = F.element_at("zs", (F.floor(F.lit(0.9) * (F.col("c") - 1)) + 1).cast("int"))
    w = F.when(F.col("c") > 1, F.greatest(F.col("top") - low, F.lit(float(floor))))
    g = v.withColumn("w", w).groupBy("cell").agg(F.min("w").alias("lo"), F.avg(F.when(F.col("w") > 0, F.log("w"))).alias("m"))
    return g.select("cell", F.when(F.col("lo") <= 0, 0.0).when(F.col("lo").isNotNull(), F.exp("m")).alias("strength"))


def line_spread(points: DataFrame, b: Box, pix: float = 1.0) -> DataFrame:
    """(cell, spread): range over lines of their upper median heights; null below two lines."""
    p = points.where(inside_half_open(b)).select(cell_south(b, pix).alias("cell"), "point_source_id", "z")
    per = p.groupBy("cell", "point_source_id").agg(F.array_sort(F.collect_list("z")).alias("zs"))
    mid = F.element_at("zs", (F.floor(F.size("zs") / 2) + 1).cast("int"))
    g = per.select("cell", mid.alias("m")).groupBy("cell")
    return g.agg(F.when(F.count("*") > 1, F.max("m") - F.min("m")).alias("spread"))


def census(points: DataFrame) -> DataFrame:
    """(code, n, share, separable): returns by class; separable if vegetation and buildings both occur."""
    g = points.groupBy(F.col("classification").alias("code")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))  # a row a class
    both = (F.max(F.col("code").isin(3, 4, 5).cast("int")).over(all_) + F.max((F.col("code") == 6).cast("int")).over(all_)) == 2
    return g.select("code", "n", (F.col("n") / F.sum("n").over(all_)).alias("share"), both.alias("separable"))


def flight_dates(points: DataFrame, standard: bool = True, leap_seconds: int = 18) -> DataFrame:
    """First and last GPS time as seconds of the Unix epoch."""
    shift = 315964800 - leap_seconds + (1_000_000_000 if standard else 0)
    return points.agg((F.min("gps_time") + F.lit(float(shift))).alias("first_s"), (F.max("gps_time") + F.lit(float(shift))).alias("last_s"))


def field_inventory(points: DataFrame, fields: list[str]) -> DataFrame:
    """(field, lowest, highest, all_zero, n): one pass over the table, then a row a field."""
    aggs = [F.struct(F.lit(f).alias("field"), F.min(F.col(f)).cast("double").alias("lowest"), F.max(F.col(f)).cast("double").alias("highest"), F.count(f).alias("n")) for f in fields]
    wide = points.agg(*[a.alias(f) for a, f in zip(aggs, fields, strict=True)])
    rows = wide.select(F.explode(F.array(*fields)).alias("s")).select("s.*")
    return rows.withColumn("all_zero", (F.col("lowest") == 0) & (F.col("highest") == 0))
