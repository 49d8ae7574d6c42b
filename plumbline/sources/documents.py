"""Map and model documents as tables: map ways with nested columns, OSM JSON, CityJSON lines, photo manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_LIST = "array<struct<x:double,y:double>>"


def pier_ways(ways: DataFrame, box: tuple[float, float, float, float], margin: float = 50.0) -> DataFrame:
    """(id, kind, name, path) of piers, breakwaters and quays of OSM whose bounds meet the box.

    Rows in: sources ARRAY<STRUCT<record_id>>, names STRUCT<primary>, source_tags MAP, class, path, bbox STRUCT.
    A box that the table does not cover is an error, so that silence never means "no piers".
    """
    x0, y0, x1, y1 = box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin
    cover = ways.agg(F.min("bbox.xmin").alias("a"), F.min("bbox.ymin").alias("b"), F.max("bbox.xmax").alias("c"), F.max("bbox.ymax").alias("d")).first()
    if cover["a"] is None or cover["a"] > box[2] or cover["c"] < box[0] or cover["b"] > box[3] or cover["d"] < box[1]:
        raise ValueError("the map table does not cover this box")
    record = F.col("sources")[0]["record_id"]
    kind = F.coalesce(F.element_at("source_tags", F.lit("man_made")), F.col("class"))
    hit = (F.col("bbox.xmax") >= x0) & (F.col("bbox.xmin") <= x1) & (F.col("bbox.ymax") >= y0) & (F.col("bbox.ymin") <= y1)
    w = ways.where(hit & record.startswith("w") & kind.isin("pier", "breakwater", "quay"))
    return w.select(F.expr("cast(substring(split(sources[0].record_id, '@')[0], 2) as bigint)").alias("id"), kind.alias("kind"), F.col("names.primary").alias("name"), "path")


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, tags, geometry) rows of OSM JSON documents (one document a file)."""
    el = "array<struct<id:bigint,type:string,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,lat:double,lon:double>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<elements:{el}>").alias("d"))
    return docs.select(F.explode("d.elements").alias("e")).select("e.*")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, ring) of the polygons of GeoJSON documents; the outer ring."""
    kind = "struct<features:array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    f = docs.select(F.explode("d.features").alias("f")).where("f.geometry.type = 'Polygon'")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("f.id", "f.properties", open_ring(ring).alias("ring"))


def open_ring(ring):
    """A ring without its closing point."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, n - 1)).otherwise(ring)


def cityjson_lines(spark: SparkSession, path: str, lod: str = "2.2") -> DataFrame:
    """(object, face, ring, seq, x, y, z) of line-delimited CityJSON at a level of detail (one feature a line).

    The first line's transform applies to all; it is one row, broadcast.
    """
    lines = spark.read.text(path)
    t = lines.select(F.from_json("value", "struct<type:string,transform:struct<scale:array<double>,translate:array<double>>>").alias("h")).where("h.type = 'CityJSON'").select("h.transform").limit(1)
    kind = "struct<type:string,id:string,CityObjects:map<string,struct<type:string,geometry:array<struct<type:string,lod:string,boundaries:string>>>>,vertices:array<array<double>>>"
    f = lines.select(F.from_json("value", kind).alias("f")).where("f.type = 'CityJSONFeature'")
    o = f.select("f.vertices", F.explode("f.CityObjects").alias("object", "o")).select("object", "vertices", F.explode("o.geometry").alias("g")).where(F.col("g.lod") == lod)
    deep = F.when(F.col("g.type") == "Solid", F.flatten(F.from_json("g.boundaries", "array<array<array<array<int>>>>"))).otherwise(F.from_json("g.boundaries", "array<array<array<int>>>"))
    faces = o.select("object", "vertices", F.posexplode(deep).alias("face", "rings")).select("object", "vertices", "face", F.posexplode("rings").alias("ring", "at"))
    v = faces.select("object", "vertices", "face", "ring", F.posexplode("at").alias("seq", "i")).withColumn("v", F.col("vertices")[F.col("i")])
    c = [(F.col("v")[k] * F.col("transform.scale")[k] + F.col("transform.translate")[k]).alias("xyz"[k]) for k in range(3)]
    return v.crossJoin(F.broadcast(t)).select("object", "face", "ring", "seq", *c)


def photo_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of photo manifests that name a file."""
    kind = "array<struct<file:string,x:double,y:double,heading:double,fov:double,pitch:double,cam_z:double,date:string,dist_m:double,unused:boolean>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("m")).select("m.*").where("file is not null")
