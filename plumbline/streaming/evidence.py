"""Streams: evidence of new tiles as they arrive, and windows over event and gps time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cells import cell_evidence
from plumbline.operators.window import Box


def tile_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def evidence_stream(points: DataFrame, box: Box, pix: float = 1.0) -> DataFrame:
    """Running cell evidence of a point stream (complete or update mode): the same aggregation as the batch form."""
    return cell_evidence(points, box, pix)


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event time window and kind; rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def pulse_windows(pulses: DataFrame, seconds: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """Pulses per line and half-second of gps time, as a stream."""
    p = pulses.withColumn("at", F.timestamp_seconds(F.col("gps_time"))).withWatermark("at", late)
    return p.groupBy("point_source_id", F.window("at", f"{int(seconds * 1000)} milliseconds").alias("w")).agg(F.count("*").alias("n"))
