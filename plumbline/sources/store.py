"""The point store: Parquet laid out for window scans, and what its footers tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.window import Box, inside_closed, not_noise

#: Side of the squares the store is sorted by, in metres, and rows of a row group.
TILE = 50.0


def tile_id(side: float = TILE, nx: int = 1 << 20) -> Column:
    """Row-major number of the square a point is in."""
    g = lambda c: F.floor(F.col(c) / F.lit(float(side))).cast("long")
    return g("y") * F.lit(nx).cast("long") + g("x")


def write_store(points: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Write points in runs of squares: ranges of squares a file, sorted within, so that statistics prune windows.

    Re-running over a finished store with ``mode="ignore"`` changes nothing; files appear only when the job commits.
    """
    t = points.withColumn("_t", tile_id())
    t = t.repartitionByRange(files, "_t", "pid") if files else t.repartitionByRange("_t", "pid")
    t.sortWithinPartitions("_t", "pid").drop("_t").write.mode(mode).option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str | list[str], box: Box | None = None, fields: list[str] | None = None, drop_noise: bool = True) -> DataFrame:
    """Points of one or more stores; the box and the fields reach the scan."""
    paths = [path] if isinstance(path, str) else path
    parts = [spark.read.parquet(p) for p in paths]
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    want = common if fields is None else [c for c in dict.fromkeys(["x", "y", "z", "classification", *fields]) if c in common]
    out = None
    for p in parts:
        q = p.where(inside_closed(box)) if box else p
        q = (q.where(not_noise()) if drop_noise and "classification" in common else q).select(want)
        out = q if out is None else out.unionByName(q)
    return out


def extent(spark: SparkSession, path: str) -> DataFrame:
    """(x0, y0, x1, y1, n): with aggregate pushdown this reads footers only."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.parquet(path).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def registry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n, first): rows of each store and the global id of its first, in the order of the paths."""
    rows, first = [], 0
    for p in sorted(paths):
        n = spark.read.parquet(p).count()
        rows.append((p, n, first))
        first += n
    return spark.createDataFrame(rows, "path string, n long, first long")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file of a table: a frozen state to compare with."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def run_log(spark: SparkSession, path: str, stage: str, facts: dict[str, int]) -> None:
    """One row a stage: time and facts."""
    row = spark.createDataFrame([(stage, {k: str(v) for k, v in facts.items()})], "stage string, facts map<string,string>")
    row.withColumn("at", F.current_timestamp()).write.mode("append").json(path)
