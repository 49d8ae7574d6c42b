"""Pulses, and where the sensor was: the point nearest to all beams of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pulses(points: DataFrame) -> DataFrame:
    """First return of every multi-return pulse with the unit direction from its last return up to it."""
    key = ["point_source_id", "gps_time"]
    ends = points.where("number_of_returns > 1").groupBy(*key).agg(
        F.min_by(F.struct("x", "y", "z", "pid"), F.struct("return_number", "pid")).alias("a"),
        F.max_by(F.struct("x", "y", "z"), F.struct("return_number", "pid")).alias("b"),
        F.min("return_number").alias("r0"), F.max("return_number").alias("r1"), F.max("number_of_returns").alias("nr"),
    )
    d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    p = ends.where("r0 = 1 and r1 = nr").select(*key, F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("a.z").alias("z"), n.alias("length"), *[c.alias(k) for k, c in zip(("dx", "dy", "dz"), d, strict=True)])
    return p.where("length > 1e-6").select(*key, "x", "y", "z", *[(F.col(k) / F.col("length")).alias("u" + k[1]) for k in ("dx", "dy", "dz")])


def track_moments(p: DataFrame, window: float = 0.5, least: int = 500, by: list[str] | None = None) -> DataFrame:
    """Per time window (half-open, from the first pulse on): sums of I - uu' and of (I - uu') p."""
    by = by or []
    t0 = p.agg(F.min("gps_time").alias("t0")) if not by else p.groupBy(*by).agg(F.min("gps_time").alias("t0"))
    j = p.crossJoin(F.broadcast(t0)) if not by else p.join(F.broadcast(t0), by)
    w = F.floor((F.col("gps_time") - F.col("t0")) / window).cast("long")
    u = {c: F.col("u" + c) for c in "xyz"}
    a = {(r, c): F.lit(1.0 if r == c else 0.0) - u[r] * u[c] for r in "xyz" for c in "xyz"}
    sums = [F.sum(a[r, c]).alias("a" + r + c) for r, c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    sums += [F.sum(a[r, "x"] * F.col("x") + a[r, "y"] * F.col("y") + a[r, "z"] * F.col("z")).alias("b" + r) for r in "xyz"]
    g = j.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.first("t0").alias("t0"), *sums)
    return g.where(F.col("n") >= least)


def sensor_track(p: DataFrame, window: float = 0.5, least: int = 500, by: list[str] | None = None) -> DataFrame:
    """(by, t, x, y, z, conditioning): where the beams of each window meet, in closed form (a 3 x 3 solve)."""
    import numpy as np
    import pandas as pd

    by = by or []

    def kernel(frames):
        for f in frames:
            m, b = np.zeros((len(f), 3, 3)), f[["bx", "by", "bz"]].to_numpy()
            for i, r in enumerate("xyz"):
                for j, c in enumerate("xyz"):
                    m[:, i, j] = f["a" + min(r, c) + max(r, c)]
            e = np.linalg.eigvalsh(m)
            ok = e[:, 0] > 1e-12
            at = np.full((len(f), 3), np.nan)
            if ok.any():
                at[ok] = np.linalg.solve(m[ok], b[ok][:, :, None])[:, :, 0]
            out = pd.DataFrame({"t": f["t0"] + (f["w"] + 0.5) * window, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "conditioning": e[:, 0] / e[:, 2]})
            for k, c in enumerate(by):
                out.insert(k, c, f[c])
            yield out[ok]

    m = track_moments(p, window, least, by)
    kinds = {f.name: f.dataType.simpleString() for f in m.schema}
    head = "".join(f"{c} {kinds[c]}, " for c in by)
    return m.mapInPandas(kernel, head + "t double, x double, y double, z double, conditioning double")


def tracks(points: DataFrame, window: float = 0.5, min_returns: int = 50_000, least: int = 500) -> DataFrame:
    """Sensor tracks of every line with enough returns."""
    big = points.groupBy("point_source_id").agg(F.count("*").alias("c")).where(F.col("c") >= min_returns).select("point_source_id")
    return sensor_track(pulses(points.join(F.broadcast(big), "point_source_id")), window, least, ["point_source_id"])
