"""Column functions for SQL users: the scalar rules of the engine registered by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, body) of SQL functions; they are inlined by the optimiser, so nothing leaves the JVM.
SQL_FUNCTIONS = {
    "cell_of": ("x DOUBLE, y DOUBLE, x0 DOUBLE, y0 DOUBLE, nx BIGINT, pix DOUBLE", "BIGINT", "cast(floor((y - y0) / pix) as bigint) * nx + least(cast(floor((x - x0) / pix) as bigint), nx - 1)"),
    "excess_green": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "(2 * g - r - b) / greatest(r + g + b, 1)"),
    "echo_position": ("rn DOUBLE, nr DOUBLE", "DOUBLE", "rn / nr"),
    "clip": ("v DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "least(greatest(v, lo), hi)"),
    "angle_gap": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(pmod(a - b + 180D, 360D) - 180D)"),
    "gps_to_unix": ("t DOUBLE", "DOUBLE", "t + 1000000000D + 315964800D - 18D"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions of the session."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
