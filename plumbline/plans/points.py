"""The point projection: any order is a pulse, its lines are returns. One text for both engines.

A point's id follows from its order and its place in it, so no global order is needed at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# window used by most queries: 60 m x 60 m inside the 101 m square
BOX = (20.0, 20.0, 80.0, 80.0)

_RETURNS = """
select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn,
  count(*) over (partition by l_orderkey) as nr
from lineitem"""

_FIELDS = """
select l_orderkey * 64 + rn - 1 as pid,
  ((l_orderkey * 104729) % 100000 * 10 + (l_partkey * 7) % 10000) / 1e4 as x,
  ((l_orderkey * 7919 + 13) % 100000 * 10 + (l_partkey * 11) % 10000) / 1e4 as y,
  l_quantity as z,
  case when l_partkey % 97 = 0 then 7 when l_returnflag = 'A' and l_linestatus = 'F' then 2
    when l_returnflag = 'A' then 1 when l_returnflag = 'N' and l_linestatus = 'F' then 5 when l_returnflag = 'N' then 6
    when l_linestatus = 'F' then 3 else 9 end as classification,
  cast(rn as bigint) as return_number, cast(nr as bigint) as number_of_returns,
  l_suppkey % 6 as point_source_id, l_orderkey * 1e0 as gps_time,
  cast(floor(l_extendedprice) as bigint) % 65536 as intensity, (l_suppkey % 41 - 20) * 166 as scan_angle,
  cast(floor(l_tax * 1e3) as bigint) as red, cast(floor(l_discount * 2e3) as bigint) as green, cast(floor(l_quantity) as bigint) as blue
from r"""

#: The head of an oracle statement: returns r and points p.
HEAD = f"with r as ({_RETURNS}), p as ({_FIELDS})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the lineitem table; one shuffle on the order key, shared by both window functions."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    r = li.selectExpr("*", *[
        "row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
        "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn",
        "count(*) over (partition by l_orderkey) as nr",
    ])
    names = _FIELDS.strip().removeprefix("select").removesuffix("from r").strip()
    return r.selectExpr(*_split(names))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z) of :func:`points`.

    Rows of an order that agree in the keys up to l_quantity lie at one place, so whichever comes first, the ids there are
    the same: the other keys need not be shuffled.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    r = li.selectExpr("*", "row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity) as rn")
    names = _FIELDS.strip().removeprefix("select").removesuffix("from r").strip()
    return r.selectExpr(*_split(names)[:4])


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


#: Cell ids in SQL: north-up raster cells and south-up table cells of BOX at 1 m (60 columns and rows).
NORTH = "cast(least(greatest(floor((80e0 - y) / 1e0), 0), 59) * 60 + least(greatest(floor((x - 20e0) / 1e0), 0), 59) as bigint)"
SOUTH = "cast(floor((y - 20e0) / 1e0) * 60 + least(floor((x - 20e0) / 1e0), 59) as bigint)"
INSIDE = "x >= 20e0 and x < 80e0 and y >= 20e0 and y < 80e0"
CLEAN = "classification not in (7, 18)"
