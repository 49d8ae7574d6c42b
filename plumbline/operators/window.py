"""Windows over point tables: boxes, pushable predicates, samples and slabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
NOISE = (7, 18)


def box(cx: float, cy: float, half: float, half_y: float | None = None) -> Box:
    """(minx, miny, maxx, maxy) around a centre."""
    hy = half if half_y is None else half_y
    return cx - half, cy - hy, cx + half, cy + hy


def inside_closed(b: Box) -> Column:
    """Points in the box, all four sides included; plain comparisons, so that they reach the scan."""
    return F.col("x").between(float(b[0]), float(b[2])) & F.col("y").between(float(b[1]), float(b[3]))


def inside_half_open(b: Box) -> Column:
    return (F.col("x") >= float(b[0])) & (F.col("x") < float(b[2])) & (F.col("y") >= float(b[1])) & (F.col("y") < float(b[3]))


def not_noise() -> Column:
    return ~F.col("classification").isin(*NOISE)


def read_window(points: DataFrame, b: Box, fields: list[str] | None = None, drop_noise: bool = True) -> DataFrame:
    """The closed window of a point table; optional fields that the table lacks are left out."""
    out = points.where(inside_closed(b))
    if drop_noise and "classification" in points.columns:
        out = out.where(not_noise())
    if fields is None:
        return out
    need = ["x", "y", "z", "classification"]
    return out.select([c for c in dict.fromkeys([*need, *fields]) if c in points.columns])


def union_tiles(tiles: list[DataFrame]) -> DataFrame:
    """Tiles end to end, with the columns all of them have, in the order of the first."""
    common = [c for c in tiles[0].columns if all(c in t.columns for t in tiles)]
    out = tiles[0].select(common)
    for t in tiles[1:]:
        out = out.unionByName(t.select(common))
    return out


def pid_range(df: DataFrame, lo: int, hi: int, col: str = "pid") -> DataFrame:
    """Rows of an id range, as a comparison that row-group statistics can prune."""
    return df.where(F.col(col).between(lo, hi))


def section(points: DataFrame, at: float, width: float = 2.0, axis: str = "y") -> DataFrame:
    """The slab around a coordinate of one axis."""
    return points.where(F.abs(F.col(axis) - F.lit(float(at))) <= F.lit(width / 2))


def stride(points: DataFrame, every: int) -> DataFrame:
    """Every n-th point by id, without a global order."""
    return points.where(F.pmod(F.col("pid"), F.lit(every)) == 0)


def neighbourhood_view(points: DataFrame, b: Box, margin: float = 60.0) -> DataFrame:
    """The working view: half-open clip with a margin, noise dropped, position of each echo in its pulse."""
    wide = (b[0] - margin, b[1] - margin, b[2] + margin, b[3] + margin)
    return points.where(inside_half_open(wide) & not_noise()).withColumn(
        "echo_pos", F.col("return_number").cast("double") / F.col("number_of_returns")
    )
