"""Rules that turn evidence into labels: priors, an ordered tree, claims, a decision with provenance, map claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.knn import nearest_tags, vote
from plumbline.operators.stencil import box_sums
from plumbline.session import materialise

# Label names in the order of their codes, how specific each is, and the map's claim order with the
# labels each claim may take from.
LABELS = ("ground", "water", "building", "veg_high", "veg_low", "small", "bridge", "floating", "on_bridge", "glazing")
SPECIFIC = {"water": 5, "on_bridge": 5, "floating": 4, "bridge": 4, "glazing": 2, "building": 2, "veg_high": 2, "veg_low": 2, "small": 2, "ground": 1}
FAMILY = {
    "ground": "terrain", "water": "terrain", "building": "structure", "glazing": "structure", "bridge": "structure",
    "veg_high": "vegetation", "veg_low": "vegetation", "small": "object", "floating": "object", "on_bridge": "object",
}
CODE = {k: i for i, k in enumerate(LABELS)}
UNSET = 255


def excess_green() -> Column:
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    return (g * 2.0 - r - b) / F.greatest(r + g + b, F.lit(1.0))


def planarity() -> Column:
    return (F.sqrt("e2") - F.sqrt("e3")) / F.sqrt("e1")


def scattering() -> Column:
    return F.sqrt("e3") / F.sqrt("e1")


def priors(points: DataFrame) -> DataFrame:
    """Points with the cheap opinions that later rules weigh (needs features nz, planar, scatter)."""
    return points.select(
        "pid", (F.col("scatter") >= 0.2).alias("foliage_prop"), (F.col("nz") > 0.9).alias("roof_like"), (F.col("nz") < 0.3).alias("wall_like"),
        (F.col("classification") == 2).alias("ground_seed"), (F.col("classification") == 9).alias("water_seed"),
    )


def penetrable() -> Column:
    return (F.col("echo") >= 0.45) & (F.col("not_last") | (F.col("scatter") >= 0.2))


def tree() -> Column:
    """One label by ordered tests; earlier rows of the ladder win."""
    c = F.col
    return (
        F.when(c("in_water") & c("at_plane") & c("water_like"), F.lit("water"))
        .when(c("csf") & (c("hag") < 1), F.lit("ground"))
        .when(c("hag") < 0.4, F.lit("ground"))
        .when((c("hag") <= 2) & c("green"), F.lit("veg_low"))
        .when(c("hag") <= 2, F.lit("small"))
        .when(penetrable() & (c("planar") >= 0.7), F.lit("glazing"))
        .when(penetrable(), F.lit("veg_high"))
        .when((c("planar") >= 0.7) & (c("scatter") < 0.3), F.lit("building"))
        .otherwise(F.lit("unlabelled"))
    )


def family(label: Column) -> Column:
    out = F.lit("none")
    for k, v in FAMILY.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def claims_mask(claims: dict[str, Column]) -> Column:
    """A bit for each label claimed; null counts as no claim."""
    bits = [F.when(F.coalesce(claims[k], F.lit(False)), F.lit(1 << CODE[k])).otherwise(F.lit(0)) for k in LABELS if k in claims]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("int")


def claims_of(mask: Column) -> dict[str, Column]:
    return {k: F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1 for i, k in enumerate(LABELS)}


def settle(mask: Column) -> tuple[Column, Column]:
    """(label code, provenance): a single claim wins; of several the single most specific; else 255, to be voted on."""
    has = claims_of(mask)
    count = sum((has[k].cast("int") for k in LABELS[1:]), has[LABELS[0]].cast("int"))
    top = F.greatest(*[F.when(has[k], SPECIFIC[k]).otherwise(0) for k in LABELS])
    best = sum((F.when(has[k] & (F.lit(SPECIFIC[k]) == top), 1).otherwise(0) for k in LABELS[1:]), F.when(has[LABELS[0]] & (F.lit(SPECIFIC[LABELS[0]]) == top), 1).otherwise(0))
    pick = F.lit(UNSET)
    for k in LABELS:
        pick = F.when(has[k] & (F.lit(SPECIFIC[k]) == top), CODE[k]).otherwise(pick)
    label = F.when(best == 1, pick).otherwise(UNSET).cast("int")
    why = F.when(count == 1, 0).when((count > 1) & (best == 1), 1).when(count == 0, 3).otherwise(2).cast("int")
    return label, why


def decide(points: DataFrame, nx: int, ny: int, quorum: int = 20, k: int = 5) -> DataFrame:
    """(pid, label, settled) from claims (pid, cell, x, y, z, claims): settle, demote the lonely, vote on the rest.

    Building and high-vegetation labels need ``quorum`` other claims of their kind in the 3 x 3 cells around them.
    Unset points take the vote of their k nearest settled ones, kept to their own claims if they have two or more and
    any vote matches.
    """
    label, why = settle(F.col("claims"))
    p = points.withColumn("label", label).withColumn("settled", why)
    bit = lambda name: F.shiftright(F.col("claims"), CODE[name]).bitwiseAND(F.lit(1))
    near = box_sums(p, nx, ny, 1, nb=bit("building"), nv=bit("veg_high"))
    p = p.join(near, "cell", "left")
    lonely = ((F.col("label") == CODE["building"]) & (F.col("nb") - 1 < quorum)) | ((F.col("label") == CODE["veg_high"]) & (F.col("nv") - 1 < quorum))
    p = p.withColumn("label", F.when(lonely, UNSET).otherwise(F.col("label"))).withColumn("settled", F.when(lonely & (F.col("settled") < 2), 2).otherwise(F.col("settled")))
    p = materialise(p.select("pid", "x", "y", "z", "claims", "label", "settled"), "settled")
    seeds, rest = p.where(F.col("label") != UNSET), p.where(F.col("label") == UNSET)
    near_k = nearest_tags(seeds.select("pid", "x", "y", "z", F.col("label").cast("long").alias("tag")), k, 1.0, rest)
    votes = near_k.groupBy("src", F.col("tag").cast("int").alias("label")).agg(F.count("*").alias("c"))
    own = rest.select(F.col("pid").alias("src"), "claims", "settled")
    # sizes of packed files understate rows: without the hints Spark would broadcast points by way of the driver
    v = votes.join(own.hint("merge"), "src")
    mine = F.pow(F.lit(2), F.col("label")).cast("int").bitwiseAND(F.col("claims")) > 0
    many = F.bit_count("claims") >= 2
    v = v.withColumn("mine", F.when(many & mine, 1).otherwise(0))
    best = v.groupBy("src").agg(F.max_by("label", F.struct(F.col("mine"), F.col("c"), -F.col("label"))).alias("voted"))
    out = rest.select("pid", "settled").join(best.withColumnRenamed("src", "pid").hint("merge"), "pid", "left")
    return seeds.select("pid", "label", "settled").unionByName(out.select("pid", F.coalesce("voted", F.lit(UNSET)).alias("label"), "settled"))


def quorum_counts(points: DataFrame, nx: int, ny: int, flag: Column) -> DataFrame:
    """(cell, others): flagged points in the 3 x 3 cells around."""
    return box_sums(points.withColumn("_f", flag.cast("int")), nx, ny, 1, others=F.col("_f"))


def residue(points: DataFrame, seeds: DataFrame, k: int = 5, written: bool = False) -> DataFrame:
    return vote(points, seeds, k, written=written)


def map_claims(label: Column, water: Column, dock: Column, bridge: Column, building: Column, ground: Column) -> tuple[Column, Column]:
    """(label, map's opinion) after the map's claims in their order; a claim takes only from the labels on its list.

    Every claim is judged on the label that the claims before it left; its opinion stays even where it lost.
    """
    # The labels that each claim may take from.
    take = {
        "water": ("ground",), "dock": ("water", "ground", "small"), "bridge": ("ground", "small", "floating", "veg_low", "veg_high"),
        "building": ("small", "floating"), "ground": ("small", "veg_low"),
    }
    kind = F.lit("")
    for cond, name in ((water, "water"), (dock, "dock"), (bridge, "bridge"), (building, "building"), (ground, "ground")):
        label = F.when(cond & label.isin(*take[name]), F.lit("floating" if name == "dock" else name)).otherwise(label)
        kind = F.when(cond, F.lit(name)).otherwise(kind)
    return label, kind


def building_veto(label: Column, near_footprint: Column, low: Column) -> Column:
    """Buildings away from every footprint are floating if low, else small."""
    return F.when((label == "building") & ~near_footprint, F.when(low, F.lit("floating")).otherwise(F.lit("small"))).otherwise(label)


def vegetation_veto(label: Column, in_water: Column) -> Column:
    return F.when(label.isin("veg_high", "veg_low") & in_water, F.lit("floating")).otherwise(label)


def marina_superstructure(points: DataFrame, bodies: DataFrame) -> DataFrame:
    """(pid, label): vegetation and small things above the lowest floating point of their water cell float too.

    Floors are single-precision, and a point may lie a hundredth below its floor.
    """
    low = points.where("label = 'floating'").join(bodies.select("cell"), "cell", "left_semi").groupBy("cell").agg(F.min(F.col("z").cast("float")).alias("floor"))
    j = points.join(low, "cell", "left")
    above = F.col("z").cast("double") > (F.col("floor") - F.lit(0.01).cast("float")).cast("double")
    rig = F.col("label").isin("veg_high", "veg_low", "small") & above
    return j.select("pid", F.when(F.coalesce(rig, F.lit(False)), "floating").otherwise(F.col("label")).alias("label"))


def refine_by_path(label: Column, wall: Column, foliage: Column, cube: Column, exg: Column) -> Column:
    """Two corrections by the share of the support path, both judged before either is applied."""
    to_building = (label == "veg_high") & (foliage < 2 / 3) & (wall > 1 / 3) & (cube < 0.3) & (exg <= 0.02)
    to_veg = (label == "building") & (wall < 2 / 3) & (foliage > 1 / 3) & (cube > 0.3) & (exg > 0.02)
    return F.when(to_building, "building").when(to_veg, "veg_high").otherwise(label)


def confusion(points: DataFrame, truth: str, label: str) -> DataFrame:
    return points.groupBy(F.col(truth).alias("truth"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def scores(points: DataFrame, truth: Column, label: Column) -> DataFrame:
    """One row: hits, false alarms, misses, precision, recall, F1, overlap (null where undefined)."""
    t = points.agg(F.count_if(truth & label).alias("tp"), F.count_if(~truth & label).alias("fp"), F.count_if(truth & ~label).alias("fn"))
    d = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select("tp", "fp", "fn", d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1"), d(tp, tp + fp + fn).alias("iou"))


def overlap_matrix(points: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """(a, b, share): of each pair of layers, the points in both over the points of the smaller; one aggregation."""
    names = list(layers)
    aggs = [F.count_if(layers[a] & layers[b]).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]]
    wide = points.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.least(f"`{a}|{a}`", f"`{b}|{b}`") > 0, F.col(f"`{a}|{b}`") / F.least(f"`{a}|{a}`", f"`{b}|{b}`")).alias("share"))
        for i, a in enumerate(names) for b in names[i + 1 :]
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
