"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Nearness is the Euclidean distance, which is a maximum inner product: -|x - q|^2 = 2 x.q - |x|^2 - |q|^2, with |x|^2
kept exactly beside each code. Vectors are coded in four bits for every two dimensions. What a code gets wrong along
the direction of its vector changes the inner products with the queries near it, what it gets wrong across does not,
so the parallel part of the error weighs ETA times the rest, both in learning the code words and in choosing a
vector's codes (coordinate descent over the subspaces).

Codes are scanned with per-query tables of the 16 inner products of each subspace. The best REFINE vectors of each
query in a block are ranked again by exact distances in double precision, and so is every other vector of the block
whose distance may still be as small as the last one needed: a vector is no nearer than its code's point less the
length of its coding error. So no answer is lost in groups of near copies, however large.

Plan: equal vectors become one (with as many ids as an answer can need) -> coarse cells around centres (k-means on the
sample, about one for every ``CELL_ROWS`` vectors, ``MAX_CELLS`` at most) -> codes, packed with their vectors into
blocks, a cell with many vectors into several -> each query of the stated set (ids divisible by EVERY) goes to the
blocks of the ``PROBES`` cells whose centres are nearest, and to no other -> the best of each block by exact distance
-> the best of each query. So work and what is moved grow with the rows, not with rows times queries (up to
``MAX_CELLS * CELL_ROWS`` vectors; beyond that take a larger sample and more cells). What a query can miss are
neighbours in cells it does not probe: recall is measured in the tests. Centres and code book are learned on a bounded
sample (SAMPLE rows with the least hashes of their ids) and are broadcast (2 MB at most for 64 dimensions); every row
is coded and placed.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one (the smallest of
several), or hold null or non-finite components take no part, and neither do rows with a null id; rows that repeat an
id are separate candidates (but never answer a query of their own id); ties go to the smaller id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import materialise, ship

SAMPLE = 20_000
EVERY = 100
NEAREST = 10
REFINE = 200
#: Weight of the parallel part of the error over the rest.
ETA = 4.0
WORDS = 16
CODE_BLOCK = 8_192
QUERY_BLOCK = 256
#: Vectors for which there is one coarse cell, cells at most, and cells that a query looks into.
CELL_ROWS = 1_024
MAX_CELLS = 4_096
PROBES = 24


def _eta_loss(r: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (r * r).sum(-1) + (ETA - 1) * (r * u).sum(-1) ** 2


def assign(x: np.ndarray, book: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codes (rows x subspaces) that keep the weighted error small; book: subspaces x WORDS x 2."""
    m = len(book)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = (x / np.where(norm > 0, norm, 1)).reshape(len(x), m, 2)
    xs = x.reshape(len(x), m, 2)
    err = xs[:, :, None, :] - book[None]  # rows x subspaces x words x 2
    plain = (err * err).sum(-1)
    along = (err * u[:, :, None, :]).sum(-1)
    code = plain.argmin(2)
    i = np.arange(len(x))
    s = along[i[:, None], np.arange(m), code].sum(1)
    for _ in range(rounds):
        moved = False
        for d in range(m):
            base = s - along[i, d, code[:, d]]
            loss = plain[:, d] + (ETA - 1) * (base[:, None] + along[:, d]) ** 2
            best = loss.argmin(1)
            moved |= bool((best != code[:, d]).any())
            code[:, d] = best
            s = base + along[i, d, best]
        if not moved:
            break
    return code.astype(np.uint8)


def learn(x: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """A code book from sample rows: codes for fixed words, then words for fixed codes by weighted least squares."""
    n, dim = x.shape
    m = dim // 2
    rng = np.random.default_rng(seed)
    xs = x.reshape(n, m, 2)
    book = np.stack([xs[rng.choice(n, WORDS, replace=n < WORDS), d] for d in range(m)])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = (x / np.where(norm > 0, norm, 1)).reshape(n, m, 2)
    eye = np.eye(2)
    for _ in range(rounds):
        code = np.concatenate([assign(part, book, 2) for part in np.array_split(x, max(1, n // 4000))])
        r = xs - book[np.arange(m), code]
        along = (r * u).sum(-1)
        for d in range(m):
            rest = along.sum(1) - along[:, d]
            ud, xd, cd = u[:, d], xs[:, d], code[:, d]
            # sum over rows of a word: (I + (eta-1) uu') c = (I + (eta-1) uu') x + (eta-1) rest u
            a = eye + (ETA - 1) * ud[:, :, None] * ud[:, None, :]
            b = (a @ xd[:, :, None])[:, :, 0] + (ETA - 1) * rest[:, None] * ud
            for w in range(WORDS):
                of = cd == w
                if of.any():
                    book[d, w] = np.linalg.solve(a[of].sum(0), b[of].sum(0))
            r[:, d] = xs[:, d] - book[d, cd]
            along[:, d] = (r[:, d] * ud).sum(-1)
    return book


def centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Centres of k cells by k-means; begun at sample rows, so that dense regions get many."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = nearest_centres(x, c, 1)[:, 0]
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centres(x: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """The p nearest centres of each row (rows x p), nearest first; a thousand rows at a time."""
    half, out = (c * c).sum(1) / 2, []
    for k in range(0, len(x), 1000):
        value = half - x[k : k + 1000] @ c.T
        out.append(np.argsort(value, axis=1, kind="stable")[:, :p])
    return np.concatenate(out) if out else np.zeros((0, min(p, len(c))), np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2))) if x.shape[1] % 2 else x


def pack(code: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, ::2] | (code[:, 1::2] << 4)


def scan(packed: np.ndarray, half: np.ndarray, queries: np.ndarray, book: np.ndarray) -> np.ndarray:
    """x.q - |x|^2 / 2 of every coded vector (columns) for every query (rows), from tables of 256 sums a byte."""
    m = len(book)
    tables = np.einsum("qdk,dwk->qdw", queries.reshape(len(queries), m, 2), book)
    if m % 2:
        tables = np.concatenate((tables, np.zeros((len(queries), 1, WORDS))), 1)
    pair = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)
    out = np.repeat(-half[None].astype(np.float32), len(queries), 0)
    for q in range(len(queries)):
        for b in range(packed.shape[1]):
            out[q] += pair[q, b][packed[:, b]]
    return out


def nearest_in_block(x: np.ndarray, packed: np.ndarray, own: np.ndarray, queries: np.ndarray, book: np.ndarray, refine: int, take: int):
    """For each query the rows of its ``take`` nearest vectors (at least) and their exact distances.

    ``own`` (queries x rows) are pairs that are no answer; vectors have an even number of components.
    """
    m = len(book)
    code = np.stack((packed & 15, packed >> 4), 2).reshape(len(packed), -1)[:, :m]
    point = book[np.arange(m), code].reshape(len(x), -1)
    error = np.linalg.norm(x - point, axis=1)
    half, size = (x * x).sum(1) / 2, (point * point).sum(1)
    value = scan(packed, half, queries, book)
    for k, q in enumerate(queries):
        able = np.flatnonzero(~own[k])
        top = min(max(refine, take), len(able))
        if not top:
            continue
        first = able[np.argpartition(-value[k, able], top - 1)[:top]]
        done = np.zeros(len(x), bool)
        done[first] = True
        at, far = first, _distances(x[first], q)
        if len(able) > top:
            last = np.partition(far, take - 1)[take - 1]
            # 32-bit sums of the scan: rounding stays far below this share of the lengths
            slack = 1e-5 * (size + half + q @ q)
            low = np.sqrt(np.maximum(size + q @ q - 2 * (value[k] + half) - slack, 0)) - error
            more = able[(low[able] <= last) & ~done[able]]
            at, far = np.concatenate((at, more)), np.concatenate((far, _distances(x[more], q)))
        yield k, at, far


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(len(q)):  # one order of summing, so that ties stay ties
        total += (x[:, d] - q[d]) ** 2
    return np.sqrt(total)


def search(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, nearest: int = NEAREST, refine: int = REFINE,
    probes: int = PROBES, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    # equality of doubles tells 0.0 from -0.0: adding 0 makes them one
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v + F.lit(0.0)).alias("x")).where("id is not null and x is not null")
    rows = rows.where(
        F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists("x", lambda v: v != 0)
    )
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["d"]
    rows = rows.where(F.size("x") == dim).withColumn("hash", F.xxhash64("x"))
    sample = _matrix(rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["x"].combine_chunks())
    book = learn(_pad(sample))
    middle = spark.sparkContext.broadcast(centres(sample, min(MAX_CELLS, -(-lengths[0]["n"] // cell_rows))))

    def place(p: int):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    part = batch.slice(k, 2000)
                    near = nearest_centres(_matrix(part.column(0)), middle.value, p)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, "cells"])

        return kernel

    # equal vectors: one place in the scan, with the ids that can be among the answers (one may be the query's own)
    turn = Window.partitionBy("hash", "x").orderBy("id")
    few = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= nearest + 1)
    joint = few.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sets = joint.mapInArrow(place(1), "x array<double>, ids array<long>, cells array<long>")
    sets = sets.select("x", "ids", F.element_at("ids", 1).alias("place"), F.element_at("cells", 1).alias("cell"))
    sets = materialise(sets.withColumn("number", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("id") % every == 0).select("x", "id").dropDuplicates()
    asked = asked.mapInArrow(place(probes), "x array<double>, id long, cells array<long>").select("id", "x", F.explode("cells").alias("cell"))
    asked = materialise(asked, "queries")
    # counts by cell: MAX_CELLS rows at most
    n_rows, n_asked = ({r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()} for t in (sets, asked))
    n_cells = len(middle.value)
    parts = np.array([-(-n_rows.get(c, 0) // CODE_BLOCK) for c in range(n_cells)], np.int64)
    first = np.cumsum(parts) - parts
    turns = np.array([max(1, -(-n_asked.get(c, 0) // QUERY_BLOCK)) for c in range(n_cells)], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                v = _matrix(part.column(1))
                code = pack(assign(_pad(v), book))
                cell, hashed = (part.column(c).to_numpy() for c in (2, 3))
                block = first[cell] + hashed % parts[cell]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(block), *part.columns[4:], pa.array([r.tobytes() for r in v], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())],
                    ["place", "block", "number", "sole", "vector", "code"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block of its cells."""
        for batch in batches:
            cell, hashed = (batch.column(c).to_numpy() for c in (2, 3))
            at = np.repeat(np.arange(len(cell)), parts[cell])
            step = np.arange(len(at)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(first[cell][at] + step), pa.array((hashed % turns[cell])[at])], ["id", "x", "block", "turn"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block: the rows of a block within a task make one piece
        kept: dict[int, list] = {}
        size = 0
        for batch in batches:
            for k, b in enumerate(batch.column(1).to_pylist()):
                kept.setdefault(b, []).append(tuple(batch.column(c)[k].as_py() for c in (0, 2, 3, 4, 5)))
                size += 1
            if size >= CODE_BLOCK:
                yield _pieces(kept)
                kept, size = {}, 0
        if kept:
            yield _pieces(kept)

    # a set with one id only is no answer to the query of that id
    sole = (F.size(F.array_distinct("ids")) == 1).alias("sole")
    hashed = F.pmod(F.xxhash64("place", "number"), F.lit(1 << 40)).alias("hashed")
    coded = sets.select("place", "x", "cell", hashed, "number", sole).mapInArrow(
        encode, "place long, block long, number long, sole boolean, vector binary, code binary"
    )
    pieces = coded.repartition(max(1, int(parts.sum())), "block").mapInArrow(
        packed, "block long, places binary, numbers binary, soles binary, vectors binary, codes binary"
    )
    there = asked.select("id", "x", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("hashed")).mapInArrow(
        spread, "id long, x array<double>, block long, turn long"
    )
    groups = there.groupBy("block", "turn").agg(F.collect_list(F.struct("id", "x")).alias("qs"))
    pairs = pieces.join(groups, "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                place, number = np.frombuffer(r["places"], np.int64), np.frombuffer(r["numbers"], np.int64)
                code = np.frombuffer(r["codes"], np.uint8).reshape(len(place), -1)
                x = _pad(np.frombuffer(r["vectors"], np.float64).reshape(len(place), -1))
                ids = np.array([q["id"] for q in r["qs"]], np.int64)
                q = _pad(np.array([q["x"] for q in r["qs"]]))
                own = (place[None] == ids[:, None]) & np.frombuffer(r["soles"], bool)[None]
                out = []
                for i, at, far in nearest_in_block(x, code, own, q, book, refine, nearest + 1):
                    best = np.lexsort((number[at], place[at], far))[: nearest + 1]
                    out.append((np.full(len(best), ids[i]), number[at[best]], place[at[best]], far[best]))
                if out:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "number", "place", "score"])

    found = pairs.select("places", "numbers", "soles", "vectors", "codes", "qs").mapInArrow(
        meet, "query_id long, number long, place long, score double"
    )
    best = Window.partitionBy("query_id").orderBy("score", "place", "number")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * (nearest + 1)).select("query_id", "number", "score")
    near = (
        found.join(sets.select("number", "ids"), "number")
        .select("query_id", F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id")
    )
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _pieces(kept: dict[int, list]) -> pa.RecordBatch:
    rows = sorted(kept.items())
    flat = [[np.array([v[c] for v in vs], t).tobytes() for _, vs in rows] for c, t in enumerate((np.int64, np.int64, bool))]
    joint = [[b"".join(v[c] for v in vs) for _, vs in rows] for c in (3, 4)]
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int64()), *(pa.array(c, pa.binary()) for c in flat + joint)],
        ["block", "places", "numbers", "soles", "vectors", "codes"],
    )
