"""Queries over raster kernels, the glazing trial, meshes, streams and vectors, with SQL where it can follow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import cells as C
from plumbline.operators import glazing, mesh
from plumbline.operators import raster as R
from plumbline.operators import window as W
from plumbline.plans.graphs import _RINGS, evidence, rings
from plumbline.plans.points import BOX, HEAD, INSIDE, SOUTH, points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, head: str = HEAD):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"{head}{sql}"
        return f

    return add


def ground_cells(spark, d):
    p = points(spark, d).where(W.inside_half_open(BOX) & (F.col("classification") == 2))
    return p.groupBy(C.cell_south(BOX, 1.0).alias("cell")).agg(F.min("z").alias("value")).withColumn("block", F.lit(0).cast("long"))


_FILL = f""", g as (select {SOUTH} as cell, min(z) as value from p where {INSIDE} and classification = 2 group by 1), c as (select unnest(range(3600)) as cell),
d as (select c.cell, min((c.cell % 60 - g.cell % 60) * (c.cell % 60 - g.cell % 60) + (c.cell // 60 - g.cell // 60) * (c.cell // 60 - g.cell // 60)) as d2 from c, g group by 1)"""


@query("distance_to_evidence", _FILL + " select cell, sqrt(d2) as distance from d")
def _(spark, d):
    return R.fill_cells(ground_cells(spark, d), 60, 60, method="nearest").select("cell", "distance")


@query("void_distances", _FILL + " select count(*) as n, quantile_cont(sqrt(d2), 0.5) as p50, quantile_cont(sqrt(d2), 0.9) as p90, max(sqrt(d2)) as top from d where d2 > 0")
def _(spark, d):
    f = R.fill_cells(ground_cells(spark, d), 60, 60, method="nearest").where("not measured")
    return f.agg(F.count("*").alias("n"), F.percentile("distance", F.lit(0.5)).alias("p50"), F.percentile("distance", F.lit(0.9)).alias("p90"), F.max("distance").alias("top"))


@query("fill_auto")
def _(spark, d):
    return R.fill_cells(ground_cells(spark, d), 60, 60).select("cell", F.round("value", 4).alias("value"), "distance", "measured")


@query("building_level")
def _(spark, d):
    from plumbline.operators.spatial import ring_cells

    f = R.fill_cells(ground_cells(spark, d), 60, 60)
    cells = f.select("cell", F.when(F.col("measured"), F.col("value")).alias("raw"), F.col("value").alias("filled"))
    return R.building_level(cells, ring_cells(rings(spark, d), 60, 60, 20.0, 20.0).select("id", "cell"), 60, 60)


@query("ground_filter")
def _(spark, d):
    return R.ground_filter(points(spark, d), 1.0, 0.5, 16.0, 4.0, rounds=80)


@query("split_tops")
def _(spark, d):
    p = points(spark, d)
    i = (F.floor((F.col("x") - 40) / 12) * 10 + F.floor((F.col("y") - 40) / 12)).cast("long")
    return R.split_tops(p.select("pid", i.alias("inst"), "x", "y", F.col("z").alias("h")), 1.0, 6.0, 2.0)


@query("balanced_boxes")
def _(spark, d):
    b = R.balanced_boxes(points(spark, d), (0.0, 0.0, 102.0, 102.0), 8000, 10.0, 256)
    return spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(b)], "box int, x0 double, y0 double, x1 double, y1 double")


@query("glazing_trial")
def _(spark, d):
    e = evidence(spark, d)
    e = e.withColumns({
        "zb": F.floor(F.least(F.greatest("hag", F.lit(0.0)), F.lit(59.9))).cast("long"), "cont": F.col("planar") > 0.7, "sub": F.col("hag") > 3, "geo": F.when(F.col("intensity") % 3 > 0, F.col("intensity") % 100 * 1.0),
        "cube": F.col("scatter"), "inside": F.col("cell") % 2 == 0, "veg_high": F.col("echo") >= 0.45, "building": F.col("planar") >= 0.6,
    })
    return glazing.convict(e, 60, 60)


@query("footprint_prisms", _RINGS.lstrip(", ") + " select id, cast(10 as bigint) as triangles, round(abs(sum(s.x0 * s.y1 - s.x1 * s.y0)) / 2, 4) as roof from sg group by id", head="with ")
def _(spark, d):
    m = mesh.footprint_prisms(rings(spark, d).select("id", "ring", F.lit(0.0).alias("z0"), F.lit(5.0).alias("z1")))
    return mesh.normals(m).groupBy("id").agg(F.count("*").alias("triangles"), F.round(F.sum(F.when(F.col("nz") > 0.5, F.col("area"))), 4).alias("roof"))


@query("weld_vertices", "select cast(n_nationkey as bigint) as id, cast(8 as bigint) as vertices from nation", head="")
def _(spark, d):
    m = mesh.footprint_prisms(rings(spark, d).select("id", "ring", F.lit(0.0).alias("z0"), F.lit(5.0).alias("z1")))
    w = mesh.weld(m)
    return w.groupBy("id").agg((F.max(F.greatest("a", "b", "c")) + 1).cast("long").alias("vertices"))


@query("glb_scenes")
def _(spark, d):
    m = mesh.footprint_prisms(rings(spark, d).select("id", "ring", F.lit(0.0).alias("z0"), F.lit(5.0).alias("z1")))
    return mesh.glb_files(m).select("id", F.length("glb").alias("bytes"), F.sha2("glb", 256).alias("sha256"))


_VEC = """with q as (select vec_id as a, embedding as x from embeddings where vec_id % 50 = 0),
s as (select q.a as query_id, vec_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: (cast(x[i] as double) - embedding[i]) * (cast(x[i] as double) - embedding[i]))) as d2 from q, embeddings where vec_id <> a),
r as (select *, row_number() over (partition by query_id order by round(d2, 9), vec_id) as rank from s) select query_id, cast(rank as int) as rank, vec_id from r where rank <= 5"""


@query("vec_neighbours", _VEC, head="")
def _(spark, d):
    """Exact neighbours of a stated query set: queries in blocks meet the vectors by an equi-join on the block."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(0).alias("blk"))
    blocks = q.groupBy("blk").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    j = v.withColumn("blk", F.lit(0)).join(blocks, "blk").select("vec_id", "embedding", F.explode("qs").alias("s")).select("vec_id", "embedding", "s.*").where("vec_id <> query_id")
    diff = F.zip_with("embedding", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    w = Window.partitionBy("query_id").orderBy(F.round("d2", 9), "vec_id")
    j = j.withColumn("d2", F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "rank", "vec_id")


@query("pier_ways", "select cast(r_regionkey + 40 as bigint) as id, 'pier' as kind, r_name as name from region where r_regionkey <> 3", head="")
def _(spark, d):
    from plumbline.sources.documents import pier_ways

    r = spark.read.parquet(f"{d}/region.parquet").selectExpr(
        "array(named_struct('record_id', concat('w', r_regionkey + 40, '@', 3))) as sources", "named_struct('primary', r_name) as names", "map('man_made', 'pier') as source_tags", "'quay' as class",
        "array(named_struct('x', 1e0 * r_regionkey, 'y', 0e0)) as path",
        "named_struct('xmin', case when r_regionkey = 3 then 900e0 else 1e0 * r_regionkey end, 'xmax', case when r_regionkey = 3 then 901e0 else r_regionkey + 1e0 end, 'ymin', 0e0, 'ymax', 1e0) as bbox")
    return pier_ways(r, (0.0, 0.0, 10.0, 10.0)).select("id", "kind", "name")


@query("event_stream", """select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2""", head="")
def _(spark, d):
    """The stream over the events file, run to its end into a table of the session."""
    from plumbline.streaming.evidence import event_counts

    import uuid

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = event_counts(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d), late="10000 days")
    name = f"events_{uuid.uuid4().hex[:8]}"
    q = s.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
