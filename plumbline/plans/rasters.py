"""Queries over windows, cells, voxels and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import boundary as B
from plumbline.operators import cells as C
from plumbline.operators import stencil as S
from plumbline.operators import views as V
from plumbline.operators import window as W
from plumbline.plans.points import BOX, CLEAN, HEAD, INSIDE, NORTH, SOUTH, points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, head: str = HEAD):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"{head}{sql}"
        return f

    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


@query("window_scan", f" select pid, x, y, z, classification, intensity from p where x between 20e0 and 80e0 and y between 20e0 and 80e0 and {CLEAN}")
def _(spark, d):
    return W.read_window(points(spark, d), BOX, ["pid", "intensity", "no_such_field"]).select("pid", "x", "y", "z", "classification", "intensity")


@query("window_scan_halfopen", f" select pid, x, y from p where {INSIDE}")
def _(spark, d):
    return points(spark, d).where(W.inside_half_open(BOX)).select("pid", "x", "y")


@query("noise_kept", " select classification, count(*) as n from p where x between 20e0 and 80e0 and y between 20e0 and 80e0 group by classification")
def _(spark, d):
    return W.read_window(points(spark, d), BOX, drop_noise=False).groupBy("classification").agg(F.count("*").alias("n"))


@query("multi_tile_union", " select pid, x, y from p where x between 20e0 and 40e0 and y between 20e0 and 40e0 union all select pid, x, y from p where x between 60e0 and 80e0 and y between 60e0 and 80e0")
def _(spark, d):
    p = points(spark, d)
    a = p.where(W.inside_closed((20, 20, 40, 40))).select("pid", "x", "y", "z")
    b = p.where(W.inside_closed((60, 60, 80, 80))).select("pid", "x", "y", "intensity")
    return W.union_tiles([a, b])


@query("working_view", " select pid, return_number / cast(number_of_returns as double) as echo_pos from p where x >= 30e0 and x < 70e0 and y >= 30e0 and y < 70e0 and classification not in (7, 18)")
def _(spark, d):
    return W.neighbourhood_view(points(spark, d), (40, 40, 60, 60), 10.0).select("pid", "echo_pos")


@query("pid_range_scan", " select pid, z from p where pid between 64000 and 128000")
def _(spark, d):
    return W.pid_range(points(spark, d), 64_000, 128_000).select("pid", "z")


@query("section_slab", " select pid, x, z from p where abs(y - 50e0) <= 1e0")
def _(spark, d):
    return W.section(points(spark, d), 50.0).select("pid", "x", "z")


@query("stride_sample", " select pid, x, y from p where pid % 7 = 0")
def _(spark, d):
    return W.stride(points(spark, d), 7).select("pid", "x", "y")


@query("spatial_sort", " select cast(floor(y / 50e0) * 3 + floor(x / 50e0) as bigint) as tile, count(*) as n, min(pid) as first_pid, max(pid) as last_pid from p group by 1")
def _(spark, d):
    from plumbline.sources.store import tile_id

    return points(spark, d).groupBy(tile_id(50.0, 3).alias("tile")).agg(F.count("*").alias("n"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))


@query("class_census", """, g as (select classification as code, count(*) as n from p group by 1)
select code, n, n / cast(sum(n) over () as double) as share, (max(case when code in (3, 4, 5) then 1 else 0 end) over () + max(case when code = 6 then 1 else 0 end) over ()) = 2 as separable from g""")
def _(spark, d):
    return V.census(points(spark, d))


@query("survey_dates", " select min(gps_time) + 1315964782e0 as first_s, max(gps_time) + 1315964782e0 as last_s from p")
def _(spark, d):
    return V.flight_dates(points(spark, d))


_INV = ["x", "y", "z", "classification", "intensity", "return_number", "number_of_returns", "scan_angle", "gps_time", "point_source_id", "red"]


@query("field_inventory", " " + " union all ".join(
    f"select '{f}' as field, cast(min({f}) as double) as lowest, cast(max({f}) as double) as highest, count({f}) as n, min({f}) = 0 and max({f}) = 0 as all_zero from p" for f in _INV))
def _(spark, d):
    return V.field_inventory(points(spark, d), _INV)


for _how, _name in (("max", "dsm"), ("min", "low")):
    def _make(how):
        return lambda spark, d: C.raster(points(spark, d), BOX, 1.0, how)
    query(f"raster_{_name}", f" select {NORTH} as cell, {_how}(z) as value from p where {INSIDE} group by 1")(_make(_how))


@query("raster_ground", f" select {NORTH} as cell, min(z) as value from p where {INSIDE} and classification = 2 group by 1")
def _(spark, d):
    return C.raster(points(spark, d), BOX, 1.0, "min", mask=F.col("classification") == 2)


@query("surfaces", f""" select {NORTH} as cell, max(z) as dsm, min(case when classification = 2 then z end) as dtm,
 max(case when classification in (3, 4, 5) then z end) as canopy, max(case when classification = 6 then z end) as roofs from p where {INSIDE} group by 1""")
def _(spark, d):
    return C.surfaces(points(spark, d), BOX)


@query("ndsm", f", s as (select {NORTH} as cell, max(z) as dsm, min(case when classification = 2 then z end) as dtm from p where {INSIDE} group by 1) select cell, dsm - dtm as ndsm from s where dtm is not null")
def _(spark, d):
    return C.surfaces(points(spark, d), BOX).where("dtm is not null").select("cell", (F.col("dsm") - F.col("dtm")).alias("ndsm"))


for _how in ("max", "min"):
    def _make(how):
        return lambda spark, d: C.at_extremum(points(spark, d), BOX, 1.0, "point_source_id", how)
    query(f"provenance_{_how}", f" select {NORTH} as cell, arg_max(point_source_id, {{'a': {'' if _how == 'max' else '-'}z, 'b': pid}}) as value from p where {INSIDE} group by 1")(_make(_how))

_INTERVAL = f""", c as (select {NORTH} as cell, point_source_id as line, z from p where {INSIDE}),
l as (select cell, line, max(z) as e, count(*) as c, list_sort(list(z)) as zs from c group by 1, 2),
l2 as (select *, zs[cast(floor(c / 2e0) as bigint) + 1] as mid, zs[cast(floor(9e-1 * (c - 1)) as bigint) + 1] as bound from l),
g as (select cell, max(e) as value, cast(sum(c) as bigint) as n, count(*) as k, min(e) as elo, max(e) as ehi, any_value(bound) as bound, max(mid) - min(mid) as gap, min(c) / cast(max(c) as double) as bal from l2 group by cell),
est as (select cell, value, case when k > 1 then elo when n > 1 then least(bound, value) else value end as lo, case when k > 1 then ehi else value end as hi, n,
 case when k > 1 then 2 when n > 1 then 1 else 0 end as method, case when k > 1 then gap end as bulk_gap, case when k > 1 then bal end as balance from g)"""
_KIND = "case when bulk_gap is null then 0 when balance < 2e-1 then 4 when bulk_gap > 5e-1 then 3 when hi - lo > 5e-1 then 2 else 1 end"


@query("interval_full", _INTERVAL + " select cell, value, lo, hi, n, method, bulk_gap, balance from est")
def _(spark, d):
    return C.interval(points(spark, d), BOX)


@query("surface_kind", _INTERVAL + f" select cell, {_KIND} as kind, hi - lo as width from est")
def _(spark, d):
    return C.interval(points(spark, d), BOX).select("cell", C.surface_kind().alias("kind"), C.width().alias("width"))


@query("trusted_cells", _INTERVAL + " select cell from est where hi - lo <= 5e-1 and n >= 2")
def _(spark, d):
    return C.interval(points(spark, d), BOX).where(C.trusted(0.5, 2)).select("cell")


@query("estimate_summary", _INTERVAL + f""", k as (select *, hi - lo as w, {_KIND} as kind from est)
select count(*) as cells, quantile_cont(w, 0.5) as width_p50, quantile_cont(w, 0.9) as width_p90, quantile_cont(w, 0.99) as width_p99,
 avg(case when w <= 5e-1 then 1e0 else 0e0 end) as within_half, """ + ", ".join(f"avg(case when method = {m} then 1e0 else 0e0 end) as method_{m}" for m in range(3)) + ", "
 + ", ".join(f"avg(case when kind = {m} then 1e0 else 0e0 end) as kind_{m}" for m in range(5)) + " from k")
def _(spark, d):
    return C.estimate_summary(C.interval(points(spark, d), BOX))


_EV = "count(*) as n, min(z) as min_z, max(z) as max_z, avg(case when return_number < number_of_returns then 1e0 else 0e0 end) as split_share, count(*) filter (classification = 2) as n_ground, count(*) filter (classification = 9) as n_water"


@query("cell_evidence", f" select {SOUTH} as cell, {_EV} from p where {INSIDE} and {CLEAN} group by 1")
def _(spark, d):
    return C.cell_evidence(points(spark, d), BOX)


@query("voxel_evidence", f" select {SOUTH} as cell, cast(floor(z / 5e-1) as bigint) as level, {_EV}, count(*) filter (classification = 6) as n_building, count(*) filter (classification in (3, 4, 5)) as n_veg from p where {INSIDE} and {CLEAN} group by 1, 2")
def _(spark, d):
    return C.voxel_evidence(points(spark, d), BOX)


@query("voxel_projection_check", f" select {SOUTH} as cell, count(*) as n, max(z) as max_z from p where {INSIDE} and {CLEAN} group by 1")
def _(spark, d):
    return C.voxel_evidence(points(spark, d), BOX).groupBy("cell").agg(F.sum("n").alias("n"), F.max("max_z").alias("max_z"))


@query("cell_quantile", f" select {SOUTH} as cell, quantile_cont(z, 0.25) as value from p where {INSIDE} group by 1 having count(*) >= 3")
def _(spark, d):
    return C.cell_quantile(points(spark, d), BOX, 1.0, 0.25, 3)


@query("footprint_occupied", f" select distinct {NORTH} as cell from p where {INSIDE} and classification = 6")
def _(spark, d):
    return C.footprint(points(spark, d).where("classification = 6"), BOX)


@query("topmost_label", f" select {SOUTH} as cell, arg_max(classification, {{'a': z, 'b': pid}}) as value from p where {INSIDE} group by 1")
def _(spark, d):
    return C.topmost(points(spark, d), BOX, 1.0, "classification")


@query("presence_masks", f" select {SOUTH} as cell, bool_or(classification = 2) as has_ground, bool_or(classification = 6) as has_building, bool_or(classification in (3, 4, 5)) as has_veg from p where {INSIDE} group by 1")
def _(spark, d):
    c = F.col("classification")
    return points(spark, d).where(W.inside_half_open(BOX)).groupBy(C.cell_south(BOX, 1.0).alias("cell")).agg(
        F.bool_or(c == 2).alias("has_ground"), F.bool_or(c == 6).alias("has_building"), F.bool_or(c.isin(3, 4, 5)).alias("has_veg"))


@query("height_above_cell_min", f" select pid, {SOUTH} as cell, z - min(z) over (partition by {SOUTH}) as hag from p where {INSIDE}")
def _(spark, d):
    return C.height_above_cell_min(points(spark, d), BOX)


@query("crown_thin", " select pid, x, y, z from p where classification = 5 qualify row_number() over (partition by floor(x / 0.28e0), floor(y / 0.28e0), floor(z / 0.28e0) order by pid) = 1 or count(*) over () <= 400")
def _(spark, d):
    return C.crown_thin(points(spark, d).where("classification = 5")).select("pid", "x", "y", "z")


_GROUND = f"gr as (select {SOUTH} as cell, min(z) as ground_z from p where {INSIDE} and classification = 2 group by 1)"


@query("column_gap", f""", {_GROUND}, v as (select distinct {SOUTH} as cell, cast(floor(z / 5e-1) as bigint) as level from p where {INSIDE} and {CLEAN}),
b as (select distinct v.cell, level - cast(floor(ground_z / 5e-1) as bigint) as band from v join gr using (cell)),
e as (select cell, band from b where band >= 0 and band < 20 union all select cell, -1 from gr union all select cell, 20 from gr),
s as (select cell, band - lag(band) over (partition by cell order by band) - 1 as run from e),
g as (select cell, max(run) * 5e-1 as gap from s group by cell) select cell, gap, gap <= 15e-1 as supported from g""")
def _(spark, d):
    p = points(spark, d)
    ground = p.where(W.inside_half_open(BOX)).where("classification = 2").groupBy(C.cell_south(BOX, 1.0).alias("cell")).agg(F.min("z").alias("ground_z"))
    return C.column_gaps(C.voxel_evidence(p, BOX), ground, h=10.0)


@query("echo_multi", f" select {NORTH} as cell, case when count(*) >= 4 then avg(case when number_of_returns > 1 then 1e0 else 0e0 end) end as ratio from p where {INSIDE} group by 1")
def _(spark, d):
    return V.echo_multi(points(spark, d), BOX)


@query("look_rank", f""", a as (select {NORTH} as cell, point_source_id as line, sum(abs(scan_angle)) / count(*) * 0.006e0 as angle from p where {INSIDE} group by 1, 2)
select cell, line, cast(least(row_number() over (partition by cell order by angle, line) - 1, 3) as int) as rank from a""")
def _(spark, d):
    return V.angle_rank(points(spark, d), BOX)


_HEAD = ", h as (select point_source_id as line, (degrees(atan2(regr_slope(x, gps_time), regr_slope(y, gps_time))) + 360e0) % 360e0 as heading from p group by 1)"


@query("beam_heading", _HEAD + " select line, round(heading, 6) as heading from h")
def _(spark, d):
    return V.headings(points(spark, d)).select("line", *r6("heading"))


@query("viewed_quadrant", _HEAD + """ select point_source_id, cast(floor((((heading + case when scan_angle >= 0 then 90e0 else -90e0 end + 360e0) % 360e0 + 180e0) % 360e0 + 45e0) % 360e0 / 90e0) as int) as quadrant, count(*) as n
 from p join h on line = point_source_id group by 1, 2""")
def _(spark, d):
    return V.look_azimuth(points(spark, d)).groupBy("point_source_id", V.viewed_quadrant().alias("quadrant")).agg(F.count("*").alias("n"))


@query("viewed_bundles")
def _(spark, d):
    return V.viewed_from(points(spark, d), 2).groupBy("view").agg(F.count("*").alias("n"))


_EDGE = f""", c as (select {NORTH} as cell, point_source_id as v, max(z) as top, count(*) as c, list_sort(list(z)) as zs from p where {INSIDE} group by 1, 2),
w as (select cell, case when c > 1 then greatest(top - zs[cast(floor(9e-1 * (c - 1)) as bigint) + 1], 0e0) end as w from c),
es as (select cell, case when min(w) <= 0 then 0e0 when min(w) is not null then exp(avg(case when w > 0 then ln(w) end)) end as strength from w group by cell)"""


@query("edge_strength", _EDGE + " select cell, round(strength, 6) as strength from es")
def _(spark, d):
    return V.edge_strength(points(spark, d), BOX).select("cell", *r6("strength"))


@query("line_spread", f""", l as (select {SOUTH} as cell, list_sort(list(z)) as zs from p where {INSIDE} group by {SOUTH}, point_source_id)
select cell, case when count(*) > 1 then max(zs[cast(floor(len(zs) / 2e0) as bigint) + 1]) - min(zs[cast(floor(len(zs) / 2e0) as bigint) + 1]) end as spread from l group by cell""")
def _(spark, d):
    return V.line_spread(points(spark, d), BOX)


# the square that holds every point, as x and y stay below 101
WHOLE = (0.0, 0.0, 101.0, 101.0)
WCELL = "cast(floor(y) * 101 + floor(x) as bigint)"


def whole_mask(spark, d):
    return points(spark, d).where("classification = 6").select(C.cell_south(WHOLE, 1.0).alias("cell")).distinct()


#: Components in SQL: the smallest name a node has heard of; only nodes whose name fell tell their neighbours.
LEAST = """(with recursive cc(node, component) using key (node) as (select {key}, {key} from {nodes} union
 select e.t, min(cc.component) from cc join e on e.s = cc.node join recurring.cc as old on old.node = e.t where cc.component < old.component group by e.t)
 select node as {key}, component from cc)"""
_MASK = f", m as (select distinct {WCELL} as cell from p where classification = 6)"
_REACH = """, e as (select a.cell as s, b.cell as t from m a, (select unnest([-1, 0, 1]) as dx) i, (select unnest([-1, 0, 1]) as dy) j, m b
 where b.cell = a.cell + dy * 101 + dx and a.cell % 101 + dx between 0 and 100 and {cond}), f as """ + LEAST.replace("{key}", "cell").replace("{nodes}", "m")
_R8 = _REACH.format(cond="(dx <> 0 or dy <> 0)")
_R4 = _REACH.format(cond="abs(dx) + abs(dy) = 1")


@query("cell_components_8", _MASK + _R8 + " select cell, component from f")
def _(spark, d):
    return S.cell_components(whole_mask(spark, d), 101, 101, 8)


@query("cell_components_4", _MASK + _R4 + " select cell, component from f")
def _(spark, d):
    return S.cell_components(whole_mask(spark, d), 101, 101, 4)


@query("large_components", _MASK + _R4 + " select cell, component from f where component in (select component from f group by component having count(*) >= 3)")
def _(spark, d):
    return S.keep_large(whole_mask(spark, d), 101, 101, 3, 4)


_GRID = ", o as (select unnest(range(-{r}, {r} + 1)) as dx), o2 as (select a.dx, b.dx as dy from o a, o b{cond})"
_SHIFT = ", sh as (select (cell // 60 + dy) * 60 + cell % 60 + dx as cell from {m}, o2 where cell % 60 + dx between 0 and 59 and cell // 60 + dy between 0 and 59)"
_BM = f", m as (select distinct {SOUTH} as cell from p where {INSIDE} and classification = 6)"


def big_mask(spark, d):
    return points(spark, d).where(W.inside_half_open(BOX)).where("classification = 6").select(C.cell_south(BOX, 1.0).alias("cell")).distinct()


@query("dilate_diamond", _BM + _GRID.format(r=2, cond=" where abs(a.dx) + abs(b.dx) <= 2") + _SHIFT.format(m="m") + " select distinct cell from sh")
def _(spark, d):
    return S.dilate(big_mask(spark, d), 60, 60, S.diamond(2))


@query("erode_square", _BM + _GRID.format(r=1, cond="") + _SHIFT.format(m="m") + " select cell from sh group by cell having count(*) = 9")
def _(spark, d):
    return S.erode(big_mask(spark, d), 60, 60, S.square(1))


@query("box_mean", f", m as (select {SOUTH} as cell, count(*) as n from p where {INSIDE} group by 1)" + _GRID.format(r=2, cond="")
       + ", sh as (select (cell // 60 + dy) * 60 + cell % 60 + dx as cell, n from m, o2 where cell % 60 + dx between 0 and 59 and cell // 60 + dy between 0 and 59) select cell, sum(n) / 25e0 as mean_n from sh group by cell")
def _(spark, d):
    c = points(spark, d).where(W.inside_half_open(BOX)).groupBy(C.cell_south(BOX, 1.0).alias("cell")).agg(F.count("*").alias("n"))
    return S.box_sums(c, 60, 60, 2, n=F.col("n")).select("cell", (F.col("n") / F.lit(25.0)).alias("mean_n"))


@query("hysteresis_cells", f""", c as (select {WCELL} as cell, max(z) - min(z) as s from p group by 1), m as (select cell, s from c where s > 20)""" + _R4
       + " select cell from f where component in (select component from f join m using (cell) group by component having max(s) > 35)")
def _(spark, d):
    c = points(spark, d).groupBy(C.cell_south(WHOLE, 1.0).alias("cell")).agg((F.max("z") - F.min("z")).alias("strength"))
    return S.hysteresis(c, 101, 101, 35, 20)


@query("void_report")
def _(spark, d):
    return S.void_report(points(spark, d).where(W.inside_half_open(BOX)).select(C.cell_south(BOX, 1.0).alias("cell")).distinct(), 60, 60)


def _ev_with_ground(spark, d):
    e = C.cell_evidence(points(spark, d), BOX)
    return e.withColumn("ground_z", F.col("min_z"))


@query("water_seed_cells")
def _(spark, d):
    return S.water_seeds(_ev_with_ground(spark, d), 60, 60, least=30)


@query("flood_bodies")
def _(spark, d):
    e = _ev_with_ground(spark, d)
    seeds = e.where("n_water > n_ground and n <= 8").select("cell")
    surface = e.select("cell", F.col("min_z").alias("z"), "n_ground")
    return S.flood(seeds, surface, 1.0, 60, 60)


@query("bridge_deck_cells")
def _(spark, d):
    p = points(spark, d).where(W.inside_half_open(BOX)).withColumn("cell", C.cell_south(BOX, 1.0))
    top = p.groupBy("cell").agg(F.max("z").alias("top"), F.min("z").alias("low"), F.avg(F.when(F.col("number_of_returns") > 4, 1.0).otherwise(0.0)).alias("ratio"))
    return S.bridge_deck(top.select("cell", (F.col("low") < F.col("top") - 6).alias("below"), "ratio"), 60, 60, least=4)


_CUBE = f""", c as (select pid, {SOUTH} as cell, z - min(z) over (partition by {SOUTH}) as hag, (intensity % 100) / 1e2 as scatter from p where {INSIDE}),
q as (select *, cast(floor(least(greatest(hag, 0e0), 599e-1)) as bigint) as zb from c),
v as (select cell, zb, sum(scatter) as s, count(*) as n from q group by 1, 2), o as (select unnest([-1, 0, 1]) as d),
nb as (select (cell // 60 + b.d) * 60 + cell % 60 + a.d as cell, zb + c3.d as zb, s, n from v, o a, o b, o c3 where cell % 60 + a.d between 0 and 59 and cell // 60 + b.d between 0 and 59),
t as (select cell, zb, sum(s) as s, sum(n) as n from nb group by 1, 2)
select pid, round(t.s / t.n, 6) as cube from q join t using (cell, zb)"""


@query("cube_scatter", _CUBE)
def _(spark, d):
    p = C.height_above_cell_min(points(spark, d), BOX).join(points(spark, d).select("pid", (F.col("intensity") % 100 / 100.0).alias("scatter")), "pid")
    return S.cube_scatter(p, 60, 60).select("pid", *r6("cube"))


@query("local_boundary", _EDGE + """, lbc as (select quantile_cont(strength, 0.95) as t1, quantile_cont(strength, 0.75) as t2 from es),
lbg as (select lba.cell, coalesce(es.strength, 0e0) as v from (select unnest(range(3600)) as cell) lba left join es using (cell)), lbo as (select unnest(range(-7, 8)) as d),
lbn as (select lbg.cell, lbg.cell // 60 + o1.d as y, lbg.cell % 60 + o2.d as x from lbg, lbo o1, lbo o2),
lbs as (select cell, (case when y < 0 then -y - 1 when y > 59 then 119 - y else y end) * 60 + case when x < 0 then -x - 1 when x > 59 then 119 - x else x end as src from lbn),
lbr as (select lbs.cell, list_sort(list(lbg.v))[113] as ref from lbs join lbg on lbg.cell = lbs.src group by 1)
select lbg.cell from lbg join lbr using (cell), lbc where v > t1 or (v > t2 and v >= ref)""")
def _(spark, d):
    return B.local_boundary(V.edge_strength(points(spark, d), BOX), 60, 60)


@query("dem", f""", dmg as (select {NORTH} as cell, min(z) as dtm from p where {INSIDE} and classification = 2 group by 1), dmt as (select {NORTH} as cell, max(z) as dsm from p where {INSIDE} group by 1),
dma as (select unnest(range(3600)) as cell), dmd as (select dma.cell, sqrt(min((dma.cell % 60 - dmg.cell % 60) * (dma.cell % 60 - dmg.cell % 60) + (dma.cell // 60 - dmg.cell // 60) * (dma.cell // 60 - dmg.cell // 60))) as distance from dma, dmg group by 1)
select dma.cell, cast(dtm as double) as dtm, distance, cast(dsm as double) as dsm from dma left join dmg using (cell) left join dmt using (cell) join dmd using (cell)""")
def _(spark, d):
    return B.dem(points(spark, d), BOX, method="nearest").select("cell", "dtm", "distance", "dsm")


@query("dem_stats")
def _(spark, d):
    return B.dem_stats(B.dem(points(spark, d), BOX))


@query("ground_cells")
def _(spark, d):
    return B.ground_cells(points(spark, d), BOX, resolution=1.0, block=16.0, halo=4.0, rounds=80)


@query("instances")
def _(spark, d):
    return B.instances(points(spark, d), BOX, edge=60.0, edge_low=40.0, min_area=4.0, veg_ratio=None, span=11)
