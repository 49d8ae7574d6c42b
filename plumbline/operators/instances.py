"""Instances: numbering, per-type tests of shape, bands and tops of buildings, element rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def instance_table(points: DataFrame, least: int = 20) -> DataFrame:
    """(inst, class, size): (pid, inst, class) rows summed; instances below ``least`` points are left out."""
    g = points.groupBy("inst").agg(F.min("class").alias("class"), F.count("*").alias("size"))
    return g.where(F.col("size") >= least)


def renumber(table: DataFrame, key: str = "inst") -> DataFrame:
    """(key, rank): numbers without gaps by falling size, ties to the smaller key."""
    return table.select(key, (F.row_number().over(Window.orderBy(F.desc("size"), key)) - 1).alias("rank"))


def extents(points: DataFrame, key: str = "inst", pix: float = 1.0) -> DataFrame:
    """Per instance: counts, ranges, robust heights, plan extents along the axes (ex, ey) and along the principal axes
    (length, width), and the share of its plan box's cells that hold a point (fill).

    The principal axes of a 2 x 2 covariance have a closed form; extents along them need one more aggregation on the
    same key, so the second shuffle is on a partitioning that is already there.
    """
    a = points.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"),
        *(F.percentile("z", F.lit(q)).alias(f"z{round(q * 100):02d}") for q in (0.02, 0.95, 0.98)),
    )
    a = a.withColumn("theta", F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2)
    j = points.select(key, "x", "y").join(a.select(key, "mx", "my", "x0", "y0", "theta"), key)
    dx, dy, t = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("theta")
    spot = F.struct(*(F.floor((F.col(v) - F.col(f"{v}0")) / F.lit(pix)) for v in "xy"))
    j = j.select(key, (dx * F.cos(t) + dy * F.sin(t)).alias("u"), (dy * F.cos(t) - dx * F.sin(t)).alias("v"), spot.alias("spot"))
    # one row a cell first, so that counting cells needs no set
    c = j.groupBy(key, "spot").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    e = c.groupBy(key).agg((F.max("u1") - F.min("u0")).alias("length"), (F.max("v1") - F.min("v0")).alias("width"), F.count("*").alias("hit"))
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cells = (F.floor(ex / F.lit(pix)) + 1) * (F.floor(ey / F.lit(pix)) + 1)
    return a.join(e, key).select(
        key, "n", "z0", "z1", "z02", "z95", "z98", "theta", "length", "width", ex.alias("ex"), ey.alias("ey"), (F.col("hit") / cells).alias("fill")
    )


def _plan() -> Column:
    return F.greatest("ex", "ey")


def like_car(veg_share: Column | None = None, exg: Column | None = None) -> Column:
    h = F.col("z95") - F.col("z02")
    out = F.col("length").between(2.5, 6.5) & F.col("width").between(1.4, 2.6) & h.between(1.2, 2.2)
    if veg_share is not None:
        out = out & (F.coalesce(veg_share, F.lit(0.0)) <= 0.5)
    if exg is not None:
        out = out & (F.coalesce(exg, F.lit(0.0)) <= 30)
    return out


def like_pole() -> Column:
    return ((F.col("z98") - F.col("z02")) > 2.5) & (_plan() < 1.2)


def like_tree(ground: Column) -> Column:
    return (F.col("z98") - ground).between(2.0, 35.0) & (_plan() <= 20) & ((F.col("z02") - ground) <= 10)


def like_boat(water: Column, max_len: float = 25.0, min_fill: float = 0.22) -> Column:
    return _plan().between(1.0, max_len) & ((F.col("z02") - water) <= 3) & ((F.col("z95") - F.col("z02")) <= 15) & (F.col("fill") >= min_fill)


def like_deck(ratio: float = 3.0, min_plan: float = 5.0) -> Column:
    return (_plan() >= min_plan) & (_plan() >= ratio * F.greatest(F.col("z1") - F.col("z0"), F.lit(1e-9)))


def roof_band(points: DataFrame, key: str = "inst", min_h: float = 1.0, bin_m: float = 0.5, frac: float = 0.05, least: int = 20) -> DataFrame:
    """(key, lo, hi), as heights like z: the band of a building's own returns; (key, z, ground) in, one ground a key.

    The band begins ``min_h`` over the ground. It ends with the lowest unbroken run of height bins that hold ``frac``
    of the fullest one; with fewer than ``least`` points above its beginning it has no end. The top bin is closed: a
    highest point on its lower edge belongs to the bin below.
    """
    over = F.col("z") - F.col("ground") - F.lit(min_h)
    b = points.withColumn("h", over).where(F.col("h") >= 0).groupBy(key, F.floor(F.col("h") / bin_m).cast("long").alias("bin")).agg(F.count("*").alias("c"), F.max("h").alias("top"))
    w = Window.partitionBy(key)
    closed = (F.col("bin") == F.max("bin").over(w)) & (F.col("bin") > 0) & (F.col("top") == F.col("bin") * bin_m)
    b = b.withColumn("bin", F.when(closed, F.col("bin") - 1).otherwise(F.col("bin"))).groupBy(key, "bin").agg(F.sum("c").alias("c"))
    b = b.withColumn("peak", F.max("c").over(w)).withColumn("all", F.sum("c").over(w))
    s = b.where((F.col("c") >= frac * F.col("peak")) & (F.col("all") >= least))
    run = s.withColumn("run", F.col("bin") - F.row_number().over(w.orderBy("bin")))
    first = run.withColumn("r0", F.min("run").over(w)).where("run = r0").groupBy(key).agg((F.max("bin") + 1).alias("end"))
    base = points.groupBy(key).agg((F.min("ground") + F.lit(min_h)).alias("lo"))
    return base.join(first, key, "left").select(key, "lo", F.coalesce(F.col("lo") + F.col("end") * bin_m, F.lit(float("inf"))).alias("hi"))


def coverage(points: DataFrame, cells: DataFrame, key: str = "inst", bin_m: float = 2.0) -> DataFrame:
    """(key, bin, share): share of an outline's 1 m cells that returns of a height bin hit; cells is (key, n_cells)."""
    p = points.groupBy(key, F.floor((F.col("z") - F.col("ground")) / bin_m).cast("long").alias("bin")).agg(F.countDistinct("cell").alias("hit"))
    return p.join(cells, key).select(key, "bin", (F.col("hit") / F.col("n_cells")).alias("share"))


def roof_top(cov: DataFrame, key: str = "inst", bin_m: float = 2.0, cover: float = 0.25, tail: float = 0.02, tail_m: float = 6.0) -> DataFrame:
    """(key, top): upper edge of the highest well-covered bin, with the thin bins above if they end within reach."""
    g = cov.groupBy(key).agg(
        F.max(F.when(F.col("share") >= cover, F.col("bin"))).alias("well"), F.max(F.when(F.col("share") > 0, F.col("bin"))).alias("any"),
        F.max(F.when(F.col("share") >= tail, F.col("bin"))).alias("thin"),
    )
    base = F.coalesce("well", "any")
    reach = F.col("thin").isNotNull() & ((F.col("thin") - base) * bin_m <= tail_m)
    return g.select(key, ((F.when(reach, F.greatest(base, F.col("thin"))).otherwise(base) + 1) * bin_m).alias("top"))


def label_lookup(points: DataFrame, labels: DataFrame, default: int = -1) -> DataFrame:
    return points.select("pid").join(labels.select("pid", "label"), "pid", "left").select("pid", F.coalesce("label", F.lit(default)).alias("label"))


def rect_overlap(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """(intersection, overlap, share of b inside a) of two rectangles given as (x0, y0, x1, y1) column names."""
    c = F.col
    wide = F.greatest(F.lit(0.0), F.least(c(a[2]), c(b[2])) - F.greatest(c(a[0]), c(b[0])))
    high = F.greatest(F.lit(0.0), F.least(c(a[3]), c(b[3])) - F.greatest(c(a[1]), c(b[1])))
    area = lambda r: (c(r[2]) - c(r[0])) * (c(r[3]) - c(r[1]))
    inter = wide * high
    union = area(a) + area(b) - inter
    return inter, F.when(union > 0, inter / union).otherwise(0.0), F.when(area(b) > 0, inter / area(b)).otherwise(0.0)


def rows_by_gap(elements: DataFrame, key: str, value: str, tol: float = 0.8) -> DataFrame:
    """Elements with ``row``: within a key, sorted values split where the gap exceeds the tolerance."""
    w = Window.partitionBy(key).orderBy(value, "id")
    new = F.when(F.col(value) - F.lag(value).over(w) > tol, 1).otherwise(0)
    return elements.withColumn("_n", new).withColumn("row", F.sum("_n").over(w)).drop("_n")


def snap_to_median(elements: DataFrame, key: list[str], value: str, within: float | None = None) -> DataFrame:
    """Values moved to the median of their group; only those near it, if ``within`` (a share) is given."""
    m = F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*key))
    near = F.lit(True) if within is None else F.abs(F.col(value) - F.col("_m")) <= within * F.col("_m")
    return elements.withColumn("_m", m).withColumn(value, F.when(near, F.col("_m")).otherwise(F.col(value))).drop("_m")


def merge_runs(spans: DataFrame, key: list[str], lo: str, hi: str, gap: float = 0.15) -> DataFrame:
    """Spans of a key that touch, or lie closer than ``gap``, as one."""
    w = Window.partitionBy(*key).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_n", F.when(F.col(lo) - reach > gap, 1).otherwise(0)).withColumn("_g", F.sum("_n").over(w))
    return s.groupBy(*key, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("_g")
