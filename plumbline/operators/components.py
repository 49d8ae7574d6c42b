"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two shuffles on node keys; the graph after each round is written to the shared folder, so lineage
stays short and lost executors cost one round at most. Nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import drop_materialised, materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node in an edge; component is the smallest node reachable.

    Self-loops and repeated edges are allowed; null ends are ignored. An empty table gives an empty result.
    """
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node")).distinct()
    e = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .distinct()
    )
    e = materialise(e, "cc")
    seen = _mark(e)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        nxt = materialise(_small_star(_large_star(e)), "cc")
        now = _mark(nxt)
        drop_materialised(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = leaves.unionByName(roots)
    lone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    # a table of its own: callers use it several times, and plans over it stay small
    out = materialise(known.unionByName(lone), "components")
    drop_materialised(e)
    return out


def _mark(e: DataFrame) -> tuple[int, int]:
    # no sum: it leaves the range of a long at some 17 million edges
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"] or 0


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
