"""Spanning trees and shortest-path forests on edge tables.

Rounds are joins and aggregations on node keys; what a round leaves is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import knn as K
from plumbline.operators.components import connected_components
from plumbline.session import drop_materialised, materialise


def undirected(edges: DataFrame) -> DataFrame:
    """(src < dst, len): each edge once, with its least length."""
    return (
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("len").cast("float").alias("len"))
        .groupBy("src", "dst").agg(F.min("len").alias("len"))
    )


def near_components(points: DataFrame, k: int, cap: float) -> DataFrame:
    """(node, component) of all points under their capped edges: components of tiles, joined by the nodes they share.

    Single-linkage groups are the same: a least forest, cut at a length, ties what the edges up to that length tie.
    """
    p = K.stored(points)
    rows = materialise(K.local_components(p, k, cap), "parts")
    # sizes of packed files understate rows: no broadcast by way of the driver
    far, rim = (rows.where(F.col(c).isNotNull()).select(F.col("label").alias(as_), F.explode(c).alias("node")) for c, as_ in (("far", "src"), ("rim", "dst")))
    links = materialise(far.join(rim.hint("merge"), "node").where("src <> dst").select("src", "dst").distinct(), "links")
    known = connected_components(links).select(F.col("node").alias("label"), "component")
    own = rows.where("own is not null")
    joined = own.where("open").join(known.hint("merge"), "label", "left").select(F.coalesce("component", "label").alias("component"), "own")
    named = joined.unionByName(own.where("not open").select(F.col("label").alias("component"), "own"))
    lone = p.where(~K.has_place()).select(F.col("pid").alias("node"), F.col("pid").alias("component"))
    return named.select(F.explode("own").alias("node"), "component").unionByName(lone)


def near_forest(points: DataFrame, k: int, cap: float) -> DataFrame:
    """(src, dst, len): the least spanning forest of the capped edges, of which tiles first drop what no forest holds."""
    return _boruvka(materialise(K.local_forests(points, k, cap), "edges"), 40)


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst, len): the least spanning forest, edges ordered by (len, src, dst)."""
    return _boruvka(materialise(undirected(edges), "edges"), max_rounds)


def _boruvka(e: DataFrame, max_rounds: int) -> DataFrame:
    """In a round every component takes its least outgoing edge; components joined by the edges taken become one.

    An edge (src < dst) may come twice.
    """
    tree, work = None, e.select("src", "dst", "len", F.col("src").alias("cs"), F.col("dst").alias("cd"))
    for _ in range(max_rounds):
        key = F.struct("len", "src", "dst", "cs", "cd")
        out = work.select(F.col("cs").alias("c"), key.alias("k")).unionByName(work.select(F.col("cd").alias("c"), key.alias("k")))
        best = out.groupBy("c").agg(F.min("k").alias("k")).select("k.*").distinct()
        best = materialise(best, "best")
        if best.isEmpty():
            break
        part = best.select("src", "dst", "len")
        tree = part if tree is None else tree.unionByName(part)
        lab = materialise(connected_components(best, "cs", "cd"), "lab")
        s, d = lab.select(F.col("node").alias("cs"), F.col("component").alias("ns")), lab.select(F.col("node").alias("cd"), F.col("component").alias("nd"))
        nxt = work.join(s.hint("merge"), "cs").join(d.hint("merge"), "cd").where("ns <> nd").select("src", "dst", "len", F.col("ns").alias("cs"), F.col("nd").alias("cd"))
        nxt = materialise(nxt, "work")  # a component with an edge left has been in a best edge: inner joins lose nothing
        drop_materialised(lab)
        drop_materialised(work)
        work = nxt
    return tree if tree is not None else work.select("src", "dst", "len")


def cut_components(tree: DataFrame, points: DataFrame, longest: float) -> DataFrame:
    """(node, component): single-linkage groups: the tree without edges above a length."""
    lone = points.select(F.col("pid").alias("src"), F.col("pid").alias("dst"))
    return connected_components(tree.where(F.col("len") <= longest).select("src", "dst").unionByName(lone))


def ranked_components(labels: DataFrame) -> DataFrame:
    """(node, comp): components numbered by falling size, ties to the smaller name; a row a component is ranked."""
    size = labels.groupBy("component").agg(F.count("*").alias("n"))
    rank = size.withColumn("comp", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).cast("int"))
    return labels.join(rank.select("component", "comp"), "component").select("node", "comp")


def near_support_distances(points: DataFrame, k: int, cap: float) -> DataFrame:
    """(pid, dist): shortest ways from the points of ``tag`` 1 to all points along capped edges; null where there is none.

    Tiles solve their own edges first; rounds then run over the edges by which a node may still come nearer.
    """
    p = K.stored(points, "tag")
    rows = materialise(K.local_ways(p, k, cap), "ways")
    ways = rows.where("dst is not null").select(F.col("pid").alias("src"), "dst", "len")
    start = rows.where("dst is null").groupBy("pid").agg(F.min("len").alias("dist")).withColumn("fresh", F.lit(True))
    # ways from roots are done in the tiles
    roots = p.where("tag = 1").select("pid", F.lit(0.0).alias("dist"), F.lit(False).alias("fresh"))
    state = materialise(start.unionByName(roots), "state")
    while not state.where("fresh").isEmpty():
        offer = ways.join(state.where("fresh").select(F.col("pid").alias("src"), "dist").hint("merge"), "src").groupBy(F.col("dst").alias("pid")).agg(F.min(F.col("dist") + F.col("len")).alias("new"))
        j = state.select("pid", "dist").join(offer.hint("merge"), "pid", "full")
        better = F.col("dist").isNull() | F.coalesce(F.col("new") < F.col("dist"), F.lit(False))
        nxt = materialise(j.select("pid", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("fresh")), "state")
        drop_materialised(state)
        state = nxt
    return p.select("pid").join(state.select("pid", "dist").hint("merge"), "pid", "left")


def support_forest(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(pid, pred, root, system, dist, depth): metric shortest paths from root points to all nodes.

    ``roots`` is (pid, system); a point in several root sets belongs to the smallest system. Relaxation in rounds, as
    many as it takes: nodes that came nearer offer their distance to their neighbours. Only then the smallest of a
    node's neighbours on a shortest path becomes its predecessor, and root, system and depth follow from the
    predecessors, by pointer doubling. Unreached nodes have system 0, root -1, depth -1 and no distance.
    """
    e = undirected(edges).withColumn("len", F.col("len").cast("double"))
    both = materialise(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "len")), "both")
    r = materialise(roots.groupBy("pid").agg(F.min("system").alias("system")), "roots")
    # steps tell which of two nodes at the same distance (edges of length 0) comes first
    state = materialise(r.select("pid", F.lit(0.0).alias("dist"), F.lit(0).alias("steps"), F.lit(True).alias("fresh")), "forest")
    while not state.where("fresh").isEmpty():
        offer = state.where("fresh").join(both, F.col("pid") == F.col("src")).groupBy(F.col("dst").alias("pid")).agg(
            F.min(F.struct((F.col("dist") + F.col("len")).alias("dist"), (F.col("steps") + 1).alias("steps"))).alias("k")
        )
        j = state.select("pid", F.struct("dist", "steps").alias("o")).join(offer, "pid", "full")
        better = F.col("o").isNull() | (F.col("k").isNotNull() & (F.col("k") < F.col("o")))
        nxt = materialise(j.select("pid", F.when(better, F.col("k")).otherwise(F.col("o")).alias("s"), better.alias("fresh")).select("pid", "s.*", "fresh"), "forest")
        drop_materialised(state)
        state = nxt
    near = state.select("pid", "dist", "steps").join(r.select("pid", F.lit(True).alias("is_root")), "pid", "left")
    ways = (
        state.select(F.col("pid").alias("src"), F.col("dist").alias("d0"), F.col("steps").alias("s0")).join(both, "src")
        .join(near.where("is_root is null").withColumnRenamed("pid", "dst"), "dst")
        .where((F.col("d0") + F.col("len") == F.col("dist")) & ((F.col("d0") < F.col("dist")) | (F.col("s0") < F.col("steps"))))
        .groupBy(F.col("dst").alias("pid")).agg(F.min("src").alias("pred"))
    )
    tree = materialise(near.join(ways, "pid", "left").select("pid", "dist", F.coalesce("pred", F.lit(-1)).alias("pred")), "tree")
    up = materialise(tree.select("pid", F.when(F.col("pred") >= 0, F.col("pred")).otherwise(F.col("pid")).alias("at"), F.when(F.col("pred") >= 0, 1).otherwise(0).alias("depth")), "up")
    while True:
        far = up.select(F.col("pid").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        nxt = materialise(up.join(far, "at").select("pid", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "up")
        drop_materialised(up)
        up = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    found = tree.join(up, "pid").join(r.select(F.col("pid").alias("at"), "system"), "at")
    out = nodes.select("pid").distinct().join(found, "pid", "left")
    return out.select(
        "pid", F.coalesce("pred", F.lit(-1)).alias("pred"), F.coalesce("at", F.lit(-1)).alias("root"), F.coalesce("system", F.lit(0)).cast("int").alias("system"), "dist",
        F.coalesce("depth", F.lit(-1)).alias("depth"),
    )


def path_counts(forest: DataFrame, cats: DataFrame, ncat: int = 3, max_rounds: int = 30) -> DataFrame:
    """(pid, depth, cross_0 ...): points of each category on the stored path, without the point itself.

    Pointer doubling: each round doubles the stretch of path a node has summed.
    """
    c = cats.select("pid", "cat")
    f = forest.select("pid", "pred").join(c, "pid", "left")
    own = [F.when(F.col("cat") == k, 1).otherwise(0).alias(f"s{k}") for k in range(ncat)]
    node = f.select(F.col("pid").alias("p"), *own)
    t = f.select("pid", F.col("pred").alias("up")).join(node, F.col("up") == F.col("p"), "left")
    t = t.select("pid", "up", F.when(F.col("up") >= 0, 1).otherwise(0).alias("depth"), *[F.coalesce(f"s{k}", F.lit(0)).alias(f"c{k}") for k in range(ncat)])
    t = materialise(t, "path")
    for _ in range(max_rounds):
        if t.where("up >= 0").isEmpty():
            break
        u = t.select(F.col("pid").alias("q"), F.col("up").alias("up2"), F.col("depth").alias("d2"), *[F.col(f"c{k}").alias(f"e{k}") for k in range(ncat)])
        nxt = t.join(u, F.col("up") == F.col("q"), "left").select(
            "pid", F.coalesce("up2", F.lit(-1)).alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), *[(F.col(f"c{k}") + F.coalesce(f"e{k}", F.lit(0))).alias(f"c{k}") for k in range(ncat)]
        )
        nxt = materialise(nxt, "path")
        drop_materialised(t)
        t = nxt
    return t.select("pid", "depth", *[F.col(f"c{k}").alias(f"cross_{k}") for k in range(ncat)])


def path_shares(counts: DataFrame, wall: int = 1, foliage: int = 2) -> DataFrame:
    """(pid, wall_share, foliage_share): zero at roots and where nothing was reached."""
    share = lambda k: F.when(F.col("depth") > 0, F.col(f"cross_{k}") / F.col("depth")).otherwise(F.lit(0.0))
    return counts.select("pid", share(wall).alias("wall_share"), share(foliage).alias("foliage_share"))
