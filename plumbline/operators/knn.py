"""Exact nearest neighbours, capped edges and shape features of 3-D points.

Points go to cubic tiles with a margin from the tiles around, each once a tile; a NumPy kernel searches a tile through a
grid fitted to its density, so no pair of points is ever a row but the neighbours found. Within a cap as long as the
margin every neighbour is seen. Uncapped, a query whose k-th neighbour lies beyond the margin then meets every tile that
its k-th neighbour so far, or a bound from the tiles' counts, lets hold a nearer point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import materialise, ship

#: Own points of a tile: the goal for tables of middle size, and at most. Tables below the goal are one tile.
FEW, MANY = 20_000, 300_000
#: Candidate pairs that a kernel holds at once.
PAIRS = 400_000
#: Rows that a task packs at once on their way to tiles.
PACKED = 500_000
#: Nodes of a component in a row, at most.
LISTED = 10_000
#: Lengths are compared with this margin where cells and tiles are told by rounded quotients.
SLACK = 1e-9
_AXES = "xyz"
_COV = ("xx", "xy", "xz", "yy", "yz", "zz")
#: How pack() holds a column: doubles by the digits of their grid, whole numbers, doubles as they are.
_GRIDS, _WHOLE, _AS_IS = (0, 2, 4), 254, 255


# ---- in a tile --------------------------------------------------------------------------------------------------
def _cells(xyz: np.ndarray, low: np.ndarray, s: float, side: np.ndarray) -> np.ndarray:
    c = np.floor((xyz - low) / s).astype(np.int64) + 1
    return (c[:, 2] * side[1] + c[:, 1]) * side[0] + c[:, 0]


def _few_a_place(sid: np.ndarray, sxyz: np.ndarray, k: int) -> np.ndarray:
    """Seeds that can be among k nearest others: of those at one place the k + 1 smallest ids."""
    o = np.lexsort((sid, sxyz[:, 2], sxyz[:, 1], sxyz[:, 0]))
    p = sxyz[o]
    start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)])
    nth = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return o[nth <= k]


def nearest(sid: np.ndarray, sxyz: np.ndarray, qid: np.ndarray, qxyz: np.ndarray, k: int, cap: float | None = None):
    """(query, seed, d2) as positions: exactly the k nearest seeds of another id, by d2, then id; sorted by query."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(sid) or not len(qid):
        return none
    low = np.minimum(sxyz.min(0), qxyz.min(0))
    extent = float((np.maximum(sxyz.max(0), qxyz.max(0)) - low).max())
    least = max(extent / 1e6, 1e-12)

    def side(s):
        return (np.floor((np.maximum(sxyz.max(0), qxyz.max(0)) - low) / s) + 3).astype(np.int64)

    def crowd(s):
        c = np.unique(_cells(sxyz, low, s, side(s)), return_counts=True)[1].astype(float)
        return (c * c).sum() / c.sum()

    def fit():
        """A cell length at which a point shares its cell with some k / 2 points."""
        s = max(extent / max(len(sxyz), 1) ** (1 / 3), least)
        while crowd(s) > 1.5 * (k + 2) and s > 2 * least:
            s /= 1.6
        while s < extent and crowd(s) < 0.5 * (k + 2):
            s *= 1.3
        return s

    keep = np.arange(len(sid))
    s = fit()
    if crowd(s) > 3 * (k + 2):
        keep = _few_a_place(sid, sxyz, k)
        sid, sxyz = sid[keep], sxyz[keep]
        s = fit()
    if cap is not None:
        s = min(s, cap * (1 + 2 * SLACK))
    todo, found = np.arange(len(qid)), []
    while len(todo):
        dims = side(s)
        key = _cells(sxyz, low, s, dims)
        order = np.argsort(key, kind="stable")
        key = key[order]
        mid = _cells(qxyz[todo], low, s, dims)
        rows = (mid[:, None] + np.array([(dz * dims[1] + dy) * dims[0] for dz in (-1, 0, 1) for dy in (-1, 0, 1)])[None, :]).ravel()
        first = np.searchsorted(key, rows - 1).reshape(-1, 9)
        size = np.searchsorted(key, rows + 1, side="right").reshape(-1, 9) - first
        count = size.sum(1)
        last = s > extent or (cap is not None and s >= cap * (1 + SLACK))
        by = np.argsort(count, kind="stable")
        open_, at = [], 0
        while at < len(by):
            # ascending counts: the last of a batch is the widest
            n = max(1, int(np.searchsorted(np.arange(1, len(by) - at + 1) * np.maximum(count[by[at:]], 1), PAIRS, side="right")))
            part = by[at : at + n]
            at += n
            sz, cnt = size[part].ravel(), count[part]
            flat = np.arange(int(cnt.sum())) + np.repeat(first[part].ravel() - (np.cumsum(sz) - sz), sz)
            q, seed = np.repeat(np.arange(n), cnt), order[flat]
            a, b = qxyz[todo[part]][q], sxyz[seed]
            d2 = (a[:, 0] - b[:, 0]) * (a[:, 0] - b[:, 0]) + (a[:, 1] - b[:, 1]) * (a[:, 1] - b[:, 1]) + (a[:, 2] - b[:, 2]) * (a[:, 2] - b[:, 2])
            d2[qid[todo[part]][q] == sid[seed]] = np.inf
            if cap is not None:
                d2[d2 > cap * cap] = np.inf
            wide = max(int(cnt.max(initial=0)), k)
            m = np.full((n, wide), np.inf)
            m[np.arange(wide)[None, :] < cnt[:, None]] = d2
            far = np.partition(m, k - 1, axis=1)[:, k - 1]
            done = np.ones(n, bool) if last else far <= (s * (1 - SLACK)) ** 2
            open_.append(part[~done])
            take = np.flatnonzero((d2 <= far[q]) & np.isfinite(d2) & done[q])
            q, seed, d2 = q[take], seed[take], d2[take]
            o = np.lexsort((sid[seed], d2, q))
            q, seed, d2 = q[o], seed[o], d2[o]
            start = np.searchsorted(q, np.arange(n))
            o = np.arange(len(q)) - start[q] < k
            found.append((todo[part][q[o]], keep[seed[o]], d2[o]))
        todo = todo[np.sort(np.concatenate(open_))] if open_ else todo[:0]
        s = 2 * s if cap is None else min(2 * s, cap * (1 + 2 * SLACK))
    q, seed, d2 = (np.concatenate(c) for c in zip(*found))
    found.clear()
    o = np.argsort(q, kind="stable")
    return q[o], seed[o], d2[o]


def pack(v: np.ndarray) -> bytes:
    """A column, bit by bit, in few bytes: differences of whole numbers (of a decimal grid), bytes of one weight together."""
    kind, w = _WHOLE, v
    if v.dtype.kind == "f":
        v = v.astype(np.float64)
        with np.errstate(all="ignore"):
            for kind in _GRIDS:
                for some in (v[:16], v):
                    w = np.rint(some * 10.0**kind).astype(np.int64)
                    fits = ((w / 10.0**kind).view(np.int64) == some.view(np.int64)).all()
                    if not fits:
                        break
                if fits:
                    break
            else:
                kind = _AS_IS
    if kind == _AS_IS:
        w = v.view(np.int64)
    else:
        w = np.diff(w.astype(np.int64), prepend=np.int64(0))
        w = (w << 1) ^ (w >> 63)
    planes = w.view(np.uint8).reshape(-1, 8).T.tobytes()
    return bytes([kind]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(b: bytes, n: int) -> np.ndarray:
    """The column of n numbers that :func:`pack` took."""
    planes = pa.Codec("zstd").decompress(memoryview(b)[1:], decompressed_size=8 * n)
    w = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.int64).ravel()
    if b[0] == _AS_IS:
        return w.view(np.float64)
    w = np.cumsum(((w >> 1) & np.int64(2**63 - 1)) ^ -(w & 1))
    return w if b[0] == _WHOLE else w / 10.0 ** b[0]


def _lists(n: int, q: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values, sorted by query, as a list for each of n queries."""
    return pa.ListArray.from_arrays(np.searchsorted(q, np.arange(n + 1)).astype(np.int32), pa.array(values))


def _as_lists(n, q, dst, d2, off, tag):
    return [_lists(n, q, dst), _lists(n, q, d2)]


def _as_tags(n, q, dst, d2, off, tag):
    return [_lists(n, q, tag)]


def _as_votes(n, q, dst, d2, off, tag):
    """The most frequent tag of each query's neighbours, the lowest of several; null where there are none."""
    tags, t = np.unique(tag, return_inverse=True)
    pair, c = np.unique(q * max(len(tags), 1) + t, return_counts=True)
    who = pair // max(len(tags), 1)
    o = np.lexsort((pair, -c, who))
    best = o[np.flatnonzero(np.diff(who, prepend=-1))]
    label, none = np.zeros(n, tag.dtype), np.ones(n, bool)
    label[who[best]], none[who[best]] = tags[pair[best] % max(len(tags), 1)], False
    return [pa.array(label, mask=none).cast(pa.int64())]


def _as_moments(n, q, dst, d2, off, tag):
    """Number and population covariances of the neighbours, around their mean, of each query."""
    c = np.bincount(q, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        o = [a - (np.bincount(q, a, n) / c)[q] for a in off]
        cov = [np.bincount(q, o["xyz".index(a)] * o["xyz".index(b)], n) / c for a, b in _COV]
    return [pa.array(c), *[pa.array(v) for v in cov]]


LISTS = (_as_lists, "dst array<long>, d2 array<double>")
TAGS = (_as_tags, "tags array<long>")
VOTES = (_as_votes, "label long")
MOMENTS = (_as_moments, "n long, " + ", ".join(f"{c} double" for c in _COV))


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


# ---- tiles ------------------------------------------------------------------------------------------------------
def has_place() -> Column:
    """Null and non-finite coordinates are no place."""
    ok = [F.coalesce(F.abs(F.col(a).cast("double")) < F.lit(float("inf")), F.lit(False)) for a in _AXES]
    return ok[0] & ok[1] & ok[2]


def _placed(points: DataFrame, *more: str) -> DataFrame:
    """Points that have a place; the others have no neighbours."""
    return points.where(has_place()).select("pid", *[F.col(a).cast("double").alias(a) for a in _AXES], *more)


def stored(points: DataFrame, *more: str) -> DataFrame:
    return materialise(points.select("pid", *_AXES, *more), "points")


def _tile(a: str | Column, size: float) -> Column:
    return F.floor((F.col(a) if isinstance(a, str) else a) / F.lit(float(size))).cast("long")


def tile_size(points: DataFrame, least: float, many: int) -> float:
    """The longest multiple of a length whose fullest tile holds ``many`` points at most (or that length)."""
    steps = sorted(m for j in range(24) for m in (2**j, 3 * 2**j))
    cells = points.groupBy(*[_tile(a, least).alias("b" + a) for a in _AXES]).agg(F.count("*").alias("c"))
    every = cells.withColumn("m", F.explode(F.array(*[F.lit(m) for m in steps])))
    full = every.groupBy("m", *[F.floor(F.col("b" + a) / F.col("m")).alias("b" + a) for a in _AXES]).agg(F.sum("c").alias("c"))
    most = {r.m: r.c for r in full.groupBy("m").agg(F.max("c").alias("c")).collect()}
    fit = [m for m in steps if most.get(m, 0) <= many]
    # lengths at which all points share one tile need not be told apart
    return least * (max((m for m in fit if m <= min((x for x in steps if x not in fit), default=steps[-1])), default=1))


def dealt(points: DataFrame, size: float, margin: float, queries: bool) -> DataFrame:
    """Points in their tile (role 3, or 1 where they are no queries) and in those within a margin (role 1)."""
    m = margin * (1 + 2 * SLACK)
    out = points.select("*", *[_tile(a, size).alias("t" + a) for a in _AXES])
    for a in _AXES:
        out = out.withColumn("b" + a, F.explode(F.sequence(_tile(F.col(a) - F.lit(m), size), _tile(F.col(a) + F.lit(m), size))))
    own = (F.col("bx") == F.col("tx")) & (F.col("by") == F.col("ty")) & (F.col("bz") == F.col("tz"))
    return out.withColumn("role", F.when(own, 3).otherwise(1) if queries else F.lit(1)).drop("tx", "ty", "tz")


def per_tile(tiles: DataFrame, kernel, schema: str) -> DataFrame:
    """What the kernel gives of each tile's columns. A task's rows of a tile travel as one row of packed columns."""
    ship(tiles.sparkSession)
    key = ["b" + a for a in _AXES]
    names = [c for c in tiles.columns if c not in key]
    packed = ", ".join([f"{b} long" for b in key] + ["n long"] + [f"{c} binary" for c in names])
    fields = _arrow(packed, tiles.sparkSession)

    def together(held):
        t = pa.Table.from_batches(held)
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        o = np.lexsort([c[b] for b in key])
        c = {x: v[o] for x, v in c.items()}
        first = np.flatnonzero(np.r_[True, np.any([c[b][1:] != c[b][:-1] for b in key], axis=0)])
        end = np.r_[first[1:], len(o)]
        cols = [[pack(c[x][i:j]) for i, j in zip(first, end)] for x in names]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*[c[b][first] for b in key], end - first, *cols], fields)], schema=fields)

    def gather(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield together(held)
                held, n = [], 0
        if n:
            yield together(held)

    def spread(table):
        n = table.column("n").to_numpy()
        c = {x: np.concatenate([unpack(b.as_py(), k) for b, k in zip(table.column(x), n)]) for x in names}
        return kernel(c | {b: np.repeat(table.column(b).to_numpy(), n) for b in key})

    return tiles.mapInArrow(gather, packed).groupBy(*key).applyInArrow(spread, schema)


def _tile_points(c: dict[str, np.ndarray]):
    xyz = np.stack([c[a] for a in _AXES], 1)
    return xyz, np.flatnonzero(c["role"] & 1), np.flatnonzero(c["role"] & 2)


def _capped_tiles(points: DataFrame, cap: float) -> tuple[DataFrame, float]:
    """Placed points, dealt to tiles with a margin of the cap, and the tiles' size; infinite where one tile takes all."""
    n = points.count()
    size = float("inf") if n <= FEW else tile_size(points, cap, min(MANY, max(FEW, n // 64)))
    if size < float("inf"):
        return dealt(points, size, cap, True), size
    return points.select("*", F.lit(3).alias("role"), *[F.lit(0).alias("b" + a) for a in _AXES]), size


def _on_rim(c: dict[str, np.ndarray], own: np.ndarray, xyz: np.ndarray, cap: float, size: float) -> np.ndarray:
    """Which of a tile's own points (positions) other tiles see as well."""
    if size == np.inf:
        return np.zeros(len(own), bool)
    tile = np.stack([c["b" + a] for a in _AXES], 1)[own]
    m = cap * (1 + 2 * SLACK)  # as in dealt()
    return ((np.floor((xyz[own] - m) / size) != tile) | (np.floor((xyz[own] + m) / size) != tile)).any(1)


def capped(points: DataFrame, k: int, cap: float, make, schema: str) -> DataFrame:
    """What ``make`` gives of each tile's ids and edges: (ids of its queries, positions of queries, ids found, d2, a function for their offsets, rim).

    ``points`` are read several times. Queries on the rim are seen by other tiles as well. Where points carry a ``tag``,
    ``make`` also gets those of its queries and of the ids found.
    """
    tagged = "tag" in points.columns
    tiles, size = _capped_tiles(_placed(points, *(["tag"] if tagged else [])), cap)
    fields = _arrow(schema, points.sparkSession)

    def kernel(c):
        xyz, s, q = _tile_points(c)
        a, b, d2 = nearest(c["pid"][s], xyz[s], c["pid"][q], xyz[q], k, cap)
        rim = _on_rim(c, q, xyz, cap, size)
        tags = (c["tag"][q], c["tag"][s[b]]) if tagged else ()
        return pa.table(make(c["pid"][q], a, c["pid"][s[b]], d2, lambda: (xyz[s[b]] - xyz[q[a]]).T, rim, *tags), schema=fields)

    return per_tile(tiles, kernel, schema)


def local_edges(points: DataFrame, k: int = 10, cap: float = 2.5) -> DataFrame:
    """(src, dst, len): the k nearest within the cap, directed."""

    def make(ids, q, dst, d2, off, rim):
        return [pa.array(ids[q]), pa.array(dst), pa.array(np.sqrt(d2).astype(np.float32))]

    return capped(stored(points), k, cap, make, "src long, dst long, len float")


def local_moments(points: DataFrame, k: int = 10, cap: float = 2.5) -> DataFrame:
    """(pid, n, covariances) of the k nearest within the cap, of the points that have any."""

    def make(ids, q, dst, d2, off, rim):
        has = np.bincount(q, minlength=len(ids)) > 0
        return [pa.array(ids[has]), *[c.filter(pa.array(has)) for c in _as_moments(len(ids), q, dst, d2, off(), None)]]

    return capped(stored(points), k, cap, make, "pid long, " + MOMENTS[1])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges kept, component of each node) of the least forest; edges of nodes below n in rising order: Boruvka rounds."""
    comp, at, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        open_ = a != b
        a, b, at = a[open_], b[open_], at[open_]
        if not len(at):
            return np.sort(np.concatenate(kept)), comp
        ends, pos = np.stack([a, b], 1).ravel(), np.repeat(np.arange(len(at)), 2)
        best = np.full(n, -1)
        best[ends[::-1]] = pos[::-1]  # the last one written stays: the first edge of each component
        c = np.flatnonzero(best >= 0)
        take = best[c]
        kept.append(at[np.unique(take)])
        up = np.arange(n)
        up[c] = np.where(a[take] == c, b[take], a[take])
        mutual = (up[up[c]] == c) & (c < up[c])
        up[c[mutual]] = c[mutual]
        while (up[up] != up).any():
            up = up[up]
        comp, a, b = up[comp], up[a], up[b]


def local_forests(points: DataFrame, k: int = 10, cap: float = 2.5) -> DataFrame:
    """(src < dst, len): of the capped edges those that a least spanning forest, by (len, src, dst), can hold.

    An edge that is the last of a cycle of a tile's edges is in no least forest; a few edges come from two tiles.
    """

    def make(ids, q, dst, d2, off, rim):
        src, length = ids[q], np.sqrt(d2).astype(np.float32)
        lo, hi = np.minimum(src, dst), np.maximum(src, dst)
        o = np.lexsort((hi, lo, length))
        lo, hi, length = lo[o], hi[o], length[o]
        nodes = np.unique(np.concatenate([lo, hi]))
        keep, _ = forest(len(nodes), np.searchsorted(nodes, lo), np.searchsorted(nodes, hi))
        return [pa.array(lo[keep]), pa.array(hi[keep]), pa.array(length[keep])]

    return capped(stored(points), k, cap, make, "src long, dst long, len float")


def local_components(stored_points: DataFrame, k: int = 10, cap: float = 2.5) -> DataFrame:
    """(label, open, own, rim, far): the components of each tile's capped edges, named by their smallest node there.

    A row holds one list: nodes of the tile (``own``, every point with a place in one tile; ``open`` where other tiles may
    join the component to theirs), those that other tiles can see (``rim``), or nodes of other tiles (``far``).
    Points at one place are one component, since each has the smallest of the other ids there among its neighbours. They
    share their other neighbours, and have none elsewhere if there are more than k of them. So the smallest id of a place
    asks for all of them, and stands for them in ``rim`` and ``far``.
    """
    tiles, size = _capped_tiles(_placed(stored_points), cap)
    schema = "label long, open boolean, own array<long>, rim array<long>, far array<long>"
    fields, listed = _arrow(schema, stored_points.sparkSession), LISTED

    def rows(name, label, values, open_=None):
        """Rows of one list each, of one label; labels come grouped."""
        start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]][: len(label)])
        size = np.diff(np.r_[start, len(label)])
        parts = -(-size // listed)
        first = np.repeat(start - listed * (np.cumsum(parts) - parts), parts) + listed * np.arange(parts.sum())
        lists = pa.ListArray.from_arrays(np.r_[first, len(label)].astype(np.int32), pa.array(values))
        given = {"label": pa.array(label[first]), name: lists} | ({} if open_ is None else {"open": pa.array(open_[first])})
        return pa.table([given.get(f.name, pa.nulls(len(first), f.type)) for f in fields], schema=fields)

    def kernel(c):
        xyz, own, ids = np.stack([c[a] for a in _AXES], 1), (c["role"] & 2) > 0, c["pid"]
        o = np.lexsort((ids, xyz[:, 2], xyz[:, 1], xyz[:, 0]))
        p = xyz[o]
        new = np.r_[True, (p[1:] != p[:-1]).any(1)]
        place = np.empty(len(o), np.int64)
        place[o] = np.cumsum(new) - 1
        least, many = o[new], np.diff(np.r_[np.flatnonzero(new), len(o)])
        here = own[least]
        asks = np.flatnonzero(here & (many <= k))
        a, b, _ = nearest(ids, xyz, ids[least[asks]], xyz[least[asks]], k, cap)
        _, comp = forest(len(least), asks[a], place[b])
        name = np.full(len(least), np.iinfo(np.int64).max)
        np.minimum.at(name, comp, ids[least])
        rim = np.zeros(len(least), bool)
        rim[here] = _on_rim(c, least[here], xyz, cap, size)
        inside, open_ = np.zeros(len(least), bool), np.zeros(len(least), bool)
        inside[comp[here]] = True
        far = ~here & inside[comp]
        open_[comp[rim | far]] = True
        out = []
        for kind, at in (("own", np.flatnonzero(own)), ("rim", least[rim]), ("far", least[far])):
            at = at[np.lexsort((ids[at], name[comp[place[at]]]))]
            mine = comp[place[at]]
            out.append(rows(kind, name[mine], ids[at], open_[mine] if kind == "own" else None))
        return pa.concat_tables(out)

    return per_tile(tiles, kernel, schema)


def local_ways(stored_points: DataFrame, k: int = 10, cap: float = 2.5) -> DataFrame:
    """Shortest ways along each tile's capped edges from its roots (tag 1): rows (pid, null, distance) of nodes reached,
    and rows (pid, dst, len) of the edges, in one direction, by which a node may yet come nearer.

    A node is no nearer to a root than to its nearest neighbour, so an edge helps only where that distance and the
    edge's length are below the distance found in the tile.
    """

    def make(ids, q, dst, d2, off, rim, tag, found):
        nodes = np.unique(np.concatenate([ids, dst]))
        own, a, b = np.searchsorted(nodes, ids), np.searchsorted(nodes, ids)[q], np.searchsorted(nodes, dst)
        length = np.sqrt(d2).astype(np.float32).astype(np.float64)
        root = np.zeros(len(nodes), bool)
        root[own], root[b] = tag == 1, found == 1
        # of strangers the nearest neighbour is not known here
        floor = np.zeros(len(nodes))
        floor[own] = np.inf
        np.minimum.at(floor, a, length)
        floor[np.isinf(floor)] = 0.0
        d, fresh = np.where(root, 0.0, np.inf), root
        while fresh.any():
            old = d.copy()
            for u, v in ((a, b), (b, a)):
                go = fresh[u]
                np.minimum.at(d, v[go], old[u[go]] + length[go])
            fresh = d < old
        src, end, size = [], [], []
        for u, v in ((a, b), (b, a)):
            may = ~root[u] & (floor[u] + length < d[v])
            src.append(nodes[u[may]])
            end.append(nodes[v[may]])
            size.append(length[may])
        near = np.isfinite(d) & ~root
        n = int(near.sum())
        return [
            pa.array(np.concatenate([nodes[near], *src])), pa.concat_arrays([pa.nulls(n, pa.int64()), *[pa.array(e) for e in end]]),
            pa.array(np.concatenate([d[near], *size])),
        ]

    return capped(stored_points, k, cap, make, "pid long, dst long, len double")


def _search(points: DataFrame, k: int, size: float, queries: DataFrame | None, product, written: bool = False) -> DataFrame:
    """(pid, product): a product of exactly the k nearest other points of each query (all others, if fewer).

    ``points`` may carry a number ``tag``. What is ``written`` reads a table and is not written again.
    """
    make, made = product
    write = (lambda df, name: df) if written else materialise
    points = write(_placed(points, *([c for c in ("tag",) if c in points.columns])), "points")
    if "tag" not in points.columns:
        points = points.withColumn("tag", F.lit(0).cast("long"))
    asked = None if queries is None else write(_placed(queries), "queries").withColumn("tag", F.lit(0).cast("long"))
    n = points.count()
    one = n <= max(FEW, 2 * k)
    if one:
        tiles = points.withColumn("role", F.lit(3 if asked is None else 1))
        if asked is not None:
            # few points, however many queries: every part of the queries meets all of them
            parts = max(1, asked.count() // MANY + 1)
            tiles = tiles.withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).unionByName(
                asked.select("*", F.lit(2).alias("role"), F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int").alias("bx")))
        else:
            tiles = tiles.withColumn("bx", F.lit(0))
        tiles = tiles.withColumn("by", F.lit(0)).withColumn("bz", F.lit(0))
        length, margin = 0.0, float("inf")
    else:
        most = points if asked is None else points.unionByName(asked)
        length = tile_size(most, size / 8, min(MANY, max(FEW, n // 64)))
        margin = length / 8
        tiles = dealt(points, length, margin, asked is None)
        if asked is not None:
            tiles = tiles.unionByName(asked.select("*", *[_tile(a, length).alias("b" + a) for a in _AXES], F.lit(2).alias("role")))
    schema = f"pid long, x double, y double, z double, far double, {made}"
    fields = _arrow(schema, points.sparkSession)

    def kernel(c):
        xyz, s, q = _tile_points(c)
        a, b, d2 = nearest(c["pid"][s], xyz[s], c["pid"][q], xyz[q], k)
        count = np.bincount(a, minlength=len(q))
        far = np.full(len(q), np.inf)
        full = count >= k
        far[full] = d2[(np.cumsum(count) - 1)[full]]
        # no distance is left where the product is certain
        far = np.where(np.sqrt(far) <= margin * (1 - SLACK), np.nan, np.sqrt(far)) if margin < np.inf else np.full(len(q), np.nan)
        out = make(len(q), a, c["pid"][s[b]], d2, (xyz[s[b]] - xyz[q[a]]).T, c["tag"][s[b]])
        return pa.table([pa.array(c["pid"][q]), *[pa.array(xyz[q, i]) for i in range(3)], pa.array(far), *out], schema=fields)

    first = per_tile(tiles, kernel, schema)
    names = ["pid", *fields.names[5:]]
    if one:
        return first.select(*names)
    first = materialise(first, "knn")
    left = first.where("not isnan(far)").select("pid", *_AXES, "far")
    sure = first.where("isnan(far)").select(*names)
    if left.isEmpty():
        return sure
    return sure.unionByName(_rest(left, points, k, length, product))


def _around(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.explode(F.array(*[F.col(c) + F.lit(o) for o in (-1, 0, 1)])))
    return df


def _rest(left: DataFrame, points: DataFrame, k: int, length: float, product) -> DataFrame:
    """(pid, product) of queries (pid, x, y, z, far) by every tile within ``far``; infinite ones get a bound first."""
    make, made = product
    b = ["b" + a for a in _AXES]
    # merge joins: sizes of packed files understate rows, and the driver would gather what Spark takes for small
    tiles = materialise(points.groupBy(*[_tile(a, length).alias("b" + a) for a in _AXES]).agg(F.count("*").alias("c")), "tiles")
    # all points of 27 tiles around a query's lie within twice their diagonal
    known, lost, level = left.where(F.col("far") < float("inf")), left.where(F.col("far") == float("inf")), 0
    while not lost.isEmpty():
        wide = length * 2**level
        here = _around(lost.select("pid", *[_tile(a, wide).alias("b" + a) for a in _AXES]), b)
        c = tiles.groupBy(*[F.shiftright(x, level).alias(x) for x in b]).agg(F.sum("c").alias("c"))
        enough = here.join(c.hint("merge"), b).groupBy("pid").agg(F.sum("c").alias("c")).where(F.col("c") > k).select("pid").hint("merge")
        bounded = lost.join(enough, "pid", "left_semi").withColumn("far", F.lit(2 * wide * 3**0.5))
        known = materialise(known.unionByName(bounded), "bounded")
        lost = materialise(lost.join(enough, "pid", "left_anti"), "lost")
        level += 1
    known = known.withColumn("far", F.col("far") * (1 + 4 * SLACK)).withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("far") / F.lit(length)))).cast("int"))
    levels = [r.level for r in known.select("level").distinct().collect()]
    # a shift of the tile's number, not a quotient: the same tile for queries and tiles
    ask = _around(known.select("*", *[F.expr(f"shiftright(cast(floor({a} / {length!r}D) as long), level)").alias("c" + a) for a in _AXES]), ["c" + a for a in _AXES])
    coarse = tiles.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).select(
        *b, "level", *[F.expr(f"shiftright(b{a}, level)").alias("c" + a) for a in _AXES])
    gap = [F.greatest(F.lit(0.0), F.col("b" + a) * length - F.col(a), F.col(a) - (F.col("b" + a) + 1) * length) for a in _AXES]
    pairs = ask.join(coarse.hint("merge"), ["level", "cx", "cy", "cz"]).where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= F.col("far") * F.col("far"))
    pairs = materialise(pairs.select("pid", *_AXES, *b), "pairs")
    seeds = points.select("*", *[_tile(a, length).alias("b" + a) for a in _AXES]).join(pairs.select(*b).distinct().hint("merge"), b, "left_semi")
    both = seeds.withColumn("role", F.lit(1)).unionByName(pairs.select("*", F.lit(0).cast("long").alias("tag"), F.lit(2).alias("role")))
    schema = "src long, dst long, d2 double, x double, y double, z double, tag long"
    fields = _arrow(schema, points.sparkSession)

    def kernel(c):
        xyz, s, q = _tile_points(c)
        a, b, d2 = nearest(c["pid"][s], xyz[s], c["pid"][q], xyz[q], k)
        off = xyz[s[b]] - xyz[q[a]]
        return pa.table([pa.array(v) for v in (c["pid"][q[a]], c["pid"][s[b]], d2, *off.T, c["tag"][s[b]])], schema=fields)

    w = Window.partitionBy("src").orderBy("d2", "dst")
    found = per_tile(both, kernel, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rows = found.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "d2", *_AXES, "tag"))).alias("e"))
    end = f"pid long, {made}"
    out = _arrow(end, points.sparkSession)

    def finish(batches):
        for t in batches:
            e = t.column("e")
            q = np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy()))
            v = {x: e.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("dst", "d2", *_AXES, "tag")}
            yield pa.RecordBatch.from_arrays([t.column("src"), *[c.cast(f.type) for c, f in zip(make(len(e), q, v["dst"], v["d2"], [v[a] for a in _AXES], v["tag"]), list(out)[1:])]], schema=out)

    return rows.mapInArrow(finish, end)


def knn(points: DataFrame, k: int = 16, size: float = 1.0, queries: DataFrame | None = None) -> DataFrame:
    """(src, rank, dst, d2): exactly the k nearest other points of each query (all others, if fewer)."""
    rows = _search(points.select("pid", *_AXES), k, size, queries, LISTS)
    return rows.select(F.col("pid").alias("src"), F.posexplode(F.arrays_zip("dst", "d2")).alias("rank", "e")).select("src", (F.col("rank") + 1).alias("rank"), "e.dst", "e.d2")


def nearest_tags(points: DataFrame, k: int, size: float, queries: DataFrame) -> DataFrame:
    """(src, tag): the number ``tag`` of each of the k nearest points of each query."""
    return _search(points, k, size, queries, TAGS).select(F.col("pid").alias("src"), F.explode("tags").alias("tag"))


def nearest_moments(points: DataFrame, k: int, size: float) -> DataFrame:
    """(pid, n, covariances) of the k nearest other points, of the points that have any."""
    return _search(points.select("pid", *_AXES), k, size, None, MOMENTS).where("n > 0")


def moments(edges: DataFrame, points: DataFrame, include_self: bool = False) -> DataFrame:
    """(pid, n, means and population covariances of the neighbours)."""
    e = edges.select("src", "dst")
    if include_self:
        e = e.unionByName(points.select(F.col("pid").alias("src"), F.col("pid").alias("dst")))
    j = e.join(points.select(F.col("pid").alias("dst"), "x", "y", "z"), "dst")
    # around the source point: no cancellation of large coordinates
    o = points.select(F.col("pid").alias("src"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    j = j.join(o, "src").select("src", *[(F.col(a) - F.col("o" + a)).alias(a) for a in "xyz"])
    cov = [F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return j.groupBy(F.col("src").alias("pid")).agg(F.count("*").alias("n"), *cov)


def shapes(moments: DataFrame) -> DataFrame:
    """(pid, e1, e2, e3, nz): normalised eigenvalues of the neighbours' covariance, and the normal's steepness."""
    import pandas as pd

    def kernel(frames):
        for f in frames:
            m = np.zeros((len(f), 3, 3))
            for k, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                m[:, a, b] = m[:, b, a] = f[("xx", "xy", "xz", "yy", "yz", "zz")[k]]
            value, vector = np.linalg.eigh(m)
            e = value[:, ::-1] / np.maximum(value.sum(1), 1e-12)[:, None]
            yield pd.DataFrame({"pid": f["pid"], "e1": e[:, 0], "e2": e[:, 1], "e3": e[:, 2], "nz": np.abs(vector[:, 2, 0])}).astype({c: "float32" for c in ("e1", "e2", "e3", "nz")})

    return moments.mapInPandas(kernel, "pid long, e1 float, e2 float, e3 float, nz float")


def shape_features(edges: DataFrame, points: DataFrame, include_self: bool = False) -> DataFrame:
    """The shapes of each point's neighbours along its edges."""
    return shapes(moments(edges, points, include_self))


def vote(queries: DataFrame, seeds: DataFrame, k: int = 5, size: float = 4.0, written: bool = False) -> DataFrame:
    """(pid, label): most frequent label of the k nearest seeds (pid, x, y, z, label), ties to the lowest label.

    Labels are counted where the neighbours are found. ``written``: both read a written table.
    """
    return _search(seeds.withColumn("tag", F.col("label").cast("long")), k, size, queries, VOTES, written).where("label is not null")
