"""Spatial joins of points and cells with rings and lines, bucketed by cell and exact after that.

A ring table is (id, ring) with ring ARRAY<STRUCT<x, y>> (open or closed); a way table is (id, path, ...). Rings are
spread over the cells of their bounding boxes, points meet them by cell, and an exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_area(ring: Column) -> Column:
    """Shoelace area, without sign."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Point in ring by crossings of the ray to the right."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    hit = F.zip_with(
        ring, nxt,
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(hit, F.lit(0), lambda s, v: s + v) % 2 == 1


def to_segment(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((x - x0) * dx + (y - y0) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = x0 + t * dx - x, y0 + t * dy - y
    return F.sqrt(ex * ex + ey * ey)


def segments(lines: DataFrame, path: str = "path", closed: bool = False) -> DataFrame:
    """One row a segment: the line's columns and x0, y0, x1, y1, seq."""
    p = F.col(path)
    ends = F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1)) if closed else F.slice(p, 2, F.size(p) - 1)
    starts = p if closed else F.slice(p, 1, F.size(p) - 1)
    z = F.zip_with(starts, ends, lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return lines.select("*", F.posexplode(z).alias("seq", "_s")).select(*[c for c in lines.columns if c != path], "seq", "_s.*")


def _spread(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    g = lambda c: F.floor(c / F.lit(float(size))).cast("long")
    return df.withColumn("gx", F.explode(F.sequence(g(x0), g(x1)))).withColumn("gy", F.explode(F.sequence(g(y0), g(y1))))


def ring_bounds(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def points_in_rings(points: DataFrame, rings: DataFrame, size: float = 10.0) -> DataFrame:
    """Points x the rings they are in: all columns of both; the ring side is spread over its own boxes."""
    r = _spread(rings, *ring_bounds(F.col("ring")), size)
    g = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    p = points.withColumn("gx", g("x")).withColumn("gy", g("y"))
    return p.join(r, ["gx", "gy"]).where(in_ring(F.col("ring"), F.col("x"), F.col("y"))).drop("gx", "gy")


def near_rings(points: DataFrame, rings: DataFrame, grow: float, size: float = 10.0) -> DataFrame:
    """(points' columns, id, dist): rings within ``grow`` of a point; inside counts as distance 0."""
    b = ring_bounds(F.col("ring"))
    r = _spread(rings, b[0] - grow, b[1] - grow, b[2] + grow, b[3] + grow, size)
    g = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    j = points.withColumn("gx", g("x")).withColumn("gy", g("y")).join(r, ["gx", "gy"])
    nxt = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    d = F.array_min(F.zip_with(F.col("ring"), nxt, lambda a, c: to_segment(F.col("x"), F.col("y"), a["x"], a["y"], c["x"], c["y"])))
    dist = F.when(in_ring(F.col("ring"), F.col("x"), F.col("y")), 0.0).otherwise(d)
    return j.withColumn("dist", dist).where(F.col("dist") <= grow).select(*points.columns, "id", "dist")


def nearest_ring(points: DataFrame, rings: DataFrame, grow: float, size: float = 10.0) -> DataFrame:
    """(pid, id): of the grown rings a point is in, the one nearest ungrown; ties to the smaller id."""
    return near_rings(points, rings, grow, size).groupBy("pid").agg(F.min_by("id", F.struct("dist", "id")).alias("id"))


def cell_centres(cells: DataFrame, nx: int, x0: float, y0: float, pix: float) -> DataFrame:
    """Cells with the x and y of their centres (rows from the south)."""
    return cells.withColumn("x", F.lit(x0) + (F.col("cell") % nx + 0.5) * F.lit(pix)).withColumn(
        "y", F.lit(y0) + (F.floor(F.col("cell") / F.lit(nx)) + 0.5) * F.lit(pix)
    )


def ring_cells(rings: DataFrame, nx: int, ny: int, x0: float, y0: float, pix: float = 1.0) -> DataFrame:
    """(cell, id) of the cells whose centres are in a ring: each ring makes its own candidate cells."""
    b = ring_bounds(F.col("ring"))
    lo = lambda c, o, n: F.greatest(F.floor((c - o) / pix).cast("long"), F.lit(0).cast("long"))
    hi = lambda c, o, n: F.least(F.floor((c - o) / pix).cast("long"), F.lit(n - 1).cast("long"))
    r = rings.withColumn("xa", lo(b[0], x0, nx)).withColumn("xb", hi(b[2], x0, nx)).withColumn("ya", lo(b[1], y0, ny)).withColumn("yb", hi(b[3], y0, ny))
    r = r.where("xa <= xb and ya <= yb").withColumn("cx", F.explode(F.sequence("xa", "xb"))).withColumn("cy", F.explode(F.sequence("ya", "yb")))
    c = r.withColumn("cell", F.col("cy") * nx + F.col("cx"))
    c = c.withColumn("x", F.lit(x0) + (F.col("cx") + 0.5) * pix).withColumn("y", F.lit(y0) + (F.col("cy") + 0.5) * pix)
    return c.where(in_ring(F.col("ring"), F.col("x"), F.col("y"))).select("cell", "id")


def ring_ids(rings: DataFrame, nx: int, ny: int, x0: float, y0: float, pix: float = 1.0) -> DataFrame:
    """(cell, id): one ring a cell, the last of those that overlap (by ``ordinal``)."""
    order = rings.select("id", "ordinal")
    return ring_cells(rings, nx, ny, x0, y0, pix).join(order, "id").groupBy("cell").agg(F.max_by("id", "ordinal").alias("id"))


def ways_near_cells(ways: DataFrame, cells: DataFrame, radius: Column, reach: float, nx: int, x0: float, y0: float, pix: float = 1.0, size: float = 10.0) -> DataFrame:
    """(cell, id): cells whose centre lies within a way's radius of it."""
    s = segments(ways.withColumn("r", radius))
    s = _spread(s, F.least("x0", "x1") - reach, F.least("y0", "y1") - reach, F.greatest("x0", "x1") + reach, F.greatest("y0", "y1") + reach, size)
    c = cell_centres(cells.select("cell"), nx, x0, y0, pix)
    g = lambda v: F.floor(F.col(v) / F.lit(float(size))).cast("long")
    j = c.withColumn("gx", g("x")).withColumn("gy", g("y")).join(s, ["gx", "gy"])
    d = to_segment(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return j.where(d <= F.col("r")).select("cell", "id").distinct()


def way_radius(kind: str = "kind", lanes: str = "lanes") -> Column:
    """Half width: foot ways 2.5 m, else 1.75 m a lane and 1.5 m, 3 m at least; unreadable lanes 5 m."""
    n = F.expr(f"try_cast({lanes} as int)")
    wide = F.when(F.col(lanes).isNotNull() & n.isNull(), 5.0).otherwise(F.greatest(F.lit(3.0), F.coalesce(n, F.lit(2)) * 1.75 + 1.5))
    return F.when(F.col(kind).isin("footway", "path", "cycleway", "steps", "pedestrian"), 2.5).otherwise(wide)


def ring_neighbours(rings: DataFrame, reach: float = 6.0, size: float = 50.0) -> DataFrame:
    """(a, b): rings whose outlines come within ``reach`` of each other, both ways round."""
    b = ring_bounds(F.col("ring"))
    s = segments(rings.select("id", "ring"), "ring", closed=True)
    grown = _spread(s, F.least("x0", "x1") - reach, F.least("y0", "y1") - reach, F.greatest("x0", "x1") + reach, F.greatest("y0", "y1") + reach, size)
    plain = _spread(s, F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"), size)
    q = plain.select("gx", "gy", F.col("id").alias("b"), *[F.col(c).alias("q" + c) for c in ("x0", "y0", "x1", "y1")])
    j = grown.withColumnRenamed("id", "a").join(q, ["gx", "gy"]).where("a <> b")
    a_, c = ("x0", "y0", "x1", "y1"), F.col
    other = [c("q" + k) for k in a_]
    mine = [c(k) for k in a_]
    ends = [to_segment(mine[0], mine[1], *other), to_segment(mine[2], mine[3], *other), to_segment(other[0], other[1], *mine), to_segment(other[2], other[3], *mine)]
    side = lambda px, py, x0, y0, x1, y1: (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    cross = (side(other[0], other[1], *mine) * side(other[2], other[3], *mine) < 0) & (side(mine[0], mine[1], *other) * side(mine[2], mine[3], *other) < 0)
    return j.where(cross | (F.least(*ends) <= reach)).select("a", "b").distinct()
