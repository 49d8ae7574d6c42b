"""MinHash near-duplicate grouping with SuperMinHash signatures.

SuperMinHash gives each element a random permutation of the slots; an element's value in a slot is its rank in
that permutation plus a uniform fraction, and a slot keeps the least value. Ranks of one element over the slots are
correlated, so the estimate of the similarity varies less than with independent hashes, and an element can be
dropped as soon as its rank exceeds the largest value left in the signature (early stopping).

Plan: signatures and band keys (one pass over the texts) -> one representative for each distinct shingle set -> band
buckets, of those with equal members one -> every bucket in cells of at most ``CELL`` members and ``CELL_BYTES`` of
sets, each with the bucket's least member -> in each cell, all pairs on full sets, joined by union-find, so that a
cell gives a spanning forest of its links and never all pairs -> components over the links. Where a bucket took
several cells and still holds more than one group, its groups meet in further cells: members of all groups but the
largest meet each other and the largest; nothing else is left to meet. So every pair that shares a bucket is linked,
in one group or refuted. Texts are never shuffled; sets are made again, for members of buckets only.

Cost: a cell's sets travel once for each bucket a member is in (after merging equal buckets). Groups that share
buckets and yet stay apart cost the product of their sizes over ``CELL``, which an exact answer needs.

Defined results: a null text is an empty one; texts without words have an empty set and are linked with nothing;
rows with a null id are grouped with nothing and keep a null component; rows that repeat an id share its group;
other columns are ignored by :func:`group` and kept by :func:`dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._words import U, lower, mix, shingles, slices, word_hashes, words
from plumbline.operators.components import connected_components
from plumbline.session import materialise, ship

#: Slots of a signature are BANDS * ROWS; a pair at similarity 0.8 misses all bands with odds of 5 in a million.
BANDS, ROWS = 40, 6
SIMILARITY_PCT = 80
#: Elements whose permutations are held at once: 16 MB for 240 slots.
PART = 1 << 15
#: Members and bytes of shingle sets of a cell, within which all pairs are tested (about: cells are dealt by hash).
CELL, CELL_BYTES = 1024, 8 << 20

#: Size of the bitmap that picks the texts to be read again: 4 MB.
FILTER_BITS = 25


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m slots a set: rank in the high 16 bits, fraction below.

    Sets are taken in runs of ``PART`` elements; of a larger set, each run starts from what the runs before have left.
    """
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, U)
    ends = np.cumsum([len(s) for s in sets])
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - len(sets[i]) + PART, "right")))
        if j == i + 1:
            for p in range(0, len(sets[i]), PART):
                _lower_to(sig[i:j], [sets[i][p : p + PART]])
        else:
            _lower_to(sig[i:j], sets[i:j])
        i = j
    return sig


def _lower_to(sig: np.ndarray, sets: list[np.ndarray]) -> None:
    """Lower the slots of each signature to the least values of its set's elements."""
    m = sig.shape[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return
    e = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = sig.reshape(-1)

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            r = mix(x + U(j + 1) * U(0x9E3779B97F4A7C15))
        return r >> U(16), j + (((r & U(0xFFFF)) * U(m - j)) >> U(16)).astype(np.int64)

    frac, k0 = draw(e, 0)
    np.minimum.at(flat, row * m + k0, frac)
    perm, own = None, None
    live = sizes > 0
    for j in range(1, m):
        live &= sig.max(axis=1) >= U(j << 48)
        keep = live[row]
        if not keep.any():
            break
        e, row = e[keep], row[keep]
        if j == 1:  # after one swap the permutation is known without its table
            k0 = k0[keep]
            frac, k1 = draw(e, 1)
            slot = np.where(k1 == k0, 0, k1)
            own = (k0, k1)
        else:
            if perm is None:
                k0, k1 = own[0][keep], own[1][keep]
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
                i = np.arange(len(e))
                for at, k in ((0, k0), (1, k1)):
                    perm[i, at], perm[i, k] = perm[i, k], perm[i, at].copy()
            elif not keep.all():
                perm = perm[keep]
            i = np.arange(len(e))
            frac, k = draw(e, j)
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[i, j]
            perm[i, j] = slot
        np.minimum.at(flat, row * m + slot, frac | U(j << 48))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of a signature."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bands + 1, dtype=U) * U(0xA24BAED4963EE407), (len(sig), 1))
        part = sig.reshape(len(sig), bands, rows)
        for r in range(rows):
            key = mix(key * U(0x9FB21C651E98DF25) + part[:, :, r])
    return key.view(np.int64)


def _text_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, buf, off in slices(column):
        low = lower(buf)
        s, e, r = words(low, off)
        yield a, b, shingles(word_hashes(low, s, e), r, b - a, k)


def _sketch(k: int, bands: int, rows: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _text_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                sig = signatures(sets, bands * rows)
                keys = band_keys(sig, bands, rows)
                with np.errstate(over="ignore"):
                    f1 = np.array([mix(s).sum(dtype=U) if len(s) else U(0) for s in sets], U).view(np.int64)
                    f2 = np.array([mix(s ^ U(0xD1B54A32D192ED03)).sum(dtype=U) if len(s) else U(0) for s in sets], U)
                lens = np.where(n > 0, bands, 0)
                offs = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n),
                        pa.array(f1),
                        pa.array(f2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[n > 0].reshape(-1))),
                    ],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )

    return kernel


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) >> U(64 - FILTER_BITS)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids: 2^FILTER_BITS bits whatever the number of ids, so that it may be broadcast.

    It lets through every id of the table, and others at the rate at which it is filled.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["w", "m"])

    t = ids.mapInArrow(bits, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[t["w"].to_numpy()] = t["m"].to_numpy()
    return out


def _passes(ids: pa.Array, bitmap: np.ndarray) -> pa.Array:
    at = _bit(ids.to_numpy(zero_copy_only=False))
    return pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)


def _sets(k: int, only):
    """Shingle sets of the texts whose ids pass a broadcast bitmap: no shuffle of texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_passes(batch.column(0), only.value))
            for a, b, sets in _text_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "shingles"],
                )

    return kernel


def cell_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Links that join what is not joined yet among the members of a cell: all pairs are tested or in one group."""
    root = np.unique(comps, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if size.sum() else np.zeros(0, np.int32)
    ends = np.cumsum(size)
    begin = ends - size
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    out = []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        near = rest[(root[rest] != root[i]) & (np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * pct) & (size[rest] > 0)]
        if not len(near):
            continue
        own = flat[begin[i] : ends[i]]
        mark[own] = True
        if len(near) > len(rest) // 4:  # most of the rest: one pass over their elements
            hits = np.concatenate(([0], np.cumsum(mark[flat[ends[i] :]])))
            both = hits[ends[near] - ends[i]] - hits[begin[near] - ends[i]]
        else:
            both = np.array([np.count_nonzero(mark[flat[begin[j] : ends[j]]]) for j in near])
        mark[own] = False
        for j in near[100 * both >= pct * (size[i] + size[near] - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return out


def _cells(pct: int):
    """Links of every cell; rows (cell columns, doc_id, comp, shingles) come sorted by cell."""

    def settle(rows: list) -> tuple[list, list]:
        links = cell_links(
            np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [np.frombuffer(r[2], U) for r in rows], pct
        )
        return [x for x, _ in links], [y for _, y in links]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            src, dst = [], []
            for key, a, b, doc, comp, shingles in zip(*batch.columns, strict=True):
                cell = (key.as_py(), a.as_py(), b.as_py())
                if cell != at:
                    if len(rows) > 1:
                        x, y = settle(rows)
                        src += x
                        dst += y
                    at, rows = cell, []
                rows.append((doc.as_py(), comp.as_py(), shingles.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
        if len(rows) > 1:
            x, y = settle(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["src", "dst"])

    return kernel


def _links(texts: DataFrame, places: DataFrame, k: int, pct: int) -> DataFrame:
    """Links found in cells; ``places`` (key, a, b, doc_id, comp) says which documents meet where."""
    only = texts.sparkSession.sparkContext.broadcast(_filter(places.select("doc_id").distinct()))
    sets = texts.where("doc_id is not null").mapInArrow(_sets(k, only), "doc_id long, shingles binary").where("length(shingles) > 0")
    rows = places.join(sets, "doc_id").select("key", "a", "b", "doc_id", "comp", "shingles")
    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "doc_id")
    found = materialise(dealt.mapInArrow(_cells(pct), "src long, dst long"), "links")
    only.unpersist()
    return found


def _parts(n: F.Column, size: F.Column, cell: int) -> F.Column:
    """How many cells n members with so many shingles in all take."""
    return F.greatest(F.ceil(n / F.lit(cell)), F.ceil(size * 8 / F.lit(CELL_BYTES)), F.lit(1)).cast("long")


def group(docs: DataFrame, k: int = 5, pct: int = SIMILARITY_PCT, bands: int = BANDS, rows: int = ROWS, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(texts.mapInArrow(_sketch(k, bands, rows), "doc_id long, n long, f1 long, f2 long, keys array<long>"), "sketch")
    full = sketch.where("doc_id is not null and n > 0")
    # one representative for each distinct set; partial aggregation takes hot copies down to a row a task
    firsts = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    members = materialise(
        full.select("doc_id", "n", "f1", "f2").join(firsts, ["n", "f1", "f2"]).select("doc_id", "n", "rep"), "members"
    )
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    # an id with different texts keeps the buckets of all of them: the id is one vertex
    sets = full.join(reps, "doc_id", "left_semi").groupBy("doc_id", "n", "f1", "f2").agg(F.first("keys").alias("keys"))
    banded = sets.select("doc_id", "n", "f1", F.explode("keys").alias("key"))
    per = banded.groupBy("key").agg(
        F.count("*").alias("c"), F.sum("n").alias("size"), F.min("doc_id").alias("lead"), F.max("doc_id").alias("other"), F.bit_xor(F.xxhash64("doc_id", "f1")).alias("who")
    )
    # buckets with the same members are one
    one = per.where("lead < other").groupBy("c", "size", "lead", "who").agg(F.min("key").alias("key"))
    buckets = materialise(banded.join(one.withColumn("parts", _parts(F.col("c"), F.col("size"), cell)).select("key", "lead", "parts"), "key"), "buckets")

    part = F.pmod(F.xxhash64("doc_id", "key"), F.col("parts"))
    own = buckets.select("key", part.alias("a"), F.lit(0).cast("long").alias("b"), "doc_id", F.col("doc_id").alias("comp"))
    # the least member stands in every cell of its bucket
    lead = buckets.where("doc_id = lead and parts > 1").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    lead = lead.where(F.col("p") != part).select("key", F.col("p").alias("a"), F.lit(0).cast("long").alias("b"), "doc_id", F.col("doc_id").alias("comp"))
    links = _links(texts, own.unionByName(lead), k, pct)
    # an id whose rows have different sets joins the groups of all of them
    odd = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id")
    odd_links = members.join(odd, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    labels = connected_components(links.unionByName(odd_links))

    large = buckets.where("parts > 1")
    if not large.isEmpty():
        meet = materialise(_meetings(large, labels, cell), "meetings")
        if not meet.isEmpty():
            labels = _updated(labels, _links(texts, meet, k, pct))

    of_rep = labels.select(F.col("node").alias("rep"), "component")
    found = members.join(of_rep, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        sketch.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _meetings(large: DataFrame, labels: DataFrame, cell: int) -> DataFrame:
    """Cells (key, a, b, doc_id, comp) in which the groups of a bucket that took several cells meet.

    Members of the bucket's largest group stand on the far side, where they need not meet each other.
    """
    lab = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    sums = lab.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = sums.groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max(F.struct("c", "comp", "s")).alias("m"), F.count("*").alias("groups"),
        F.sum("c").alias("c"), F.sum("s").alias("s"),
    ).where("groups > 1")
    near = _parts(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"), max(cell // 2, 1))
    mixed = mixed.select("key", "main", near.alias("near"), _parts(F.col("m.c"), F.col("m.s"), max(cell // 2, 1)).alias("far"))
    lab = lab.select("key", "doc_id", "comp").join(mixed, "key")
    zero = F.lit(0).cast("long")
    # near side: block i meets block j (a <= b) and, as (i, -1 - j), block j of the far side
    i = F.pmod(F.xxhash64("doc_id", "key"), F.col("near"))
    among = F.transform(F.sequence(zero, F.col("near") - 1), lambda j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b")))
    across = F.transform(F.sequence(zero, F.col("far") - 1), lambda j: F.struct(i.alias("a"), (-1 - j).alias("b")))
    j = F.pmod(F.xxhash64("doc_id", "key"), F.col("far"))
    facing = F.transform(F.sequence(zero, F.col("near") - 1), lambda k: F.struct(k.alias("a"), (-1 - j).alias("b")))
    spots = F.when(F.col("comp") == F.col("main"), facing).otherwise(F.concat(among, across))
    return lab.withColumn("spot", F.explode(spots)).select("key", "spot.a", "spot.b", "doc_id", "comp")


def _updated(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the old components, so that settled ones are not worked on again."""
    if links.isEmpty():
        return labels
    of = labels.select("node", F.col("component").alias("c"))
    ends = links.join(of.withColumnRenamed("c", "x").withColumnRenamed("node", "src"), "src", "left").join(
        of.withColumnRenamed("c", "y").withColumnRenamed("node", "dst"), "dst", "left"
    )
    joined = connected_components(ends.select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst")))
    known = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )
    new = joined.join(labels.select("node"), "node", "left_anti")
    return materialise(known.unionByName(new), "labels")


def dedup(docs: DataFrame, k: int = 5, pct: int = SIMILARITY_PCT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id, once.

    Where ids repeat, rows are grouped by a hash of id and text instead, so that rows of one id with unlike texts do
    not stand for each other.
    """
    some = docs.where("doc_id is not null")
    row = "_row"
    while row.lower() in map(str.lower, docs.columns):
        row += "_"
    if some.groupBy("doc_id").count().where("count > 1").isEmpty():
        keep = materialise(group(some, k, pct).where("kept").select(F.col("doc_id").alias(row)), "kept")
        out = some.join(keep, some["doc_id"].cast("long") == F.col(row), "left_semi")
    else:
        rows = some.withColumn(row, F.xxhash64("doc_id", "text"))
        found = group(rows.select(F.col(row).alias("doc_id"), "text"), k, pct).select(F.col("doc_id").alias(row), "component_id").distinct()
        least = found.join(rows.select(F.col(row), F.col("doc_id").alias("d")).distinct(), row).groupBy("component_id").agg(F.min(F.struct("d", row)).alias("m"))
        keep = materialise(least.select(F.col(f"m.{row}").alias(row)), "kept")
        out = rows.join(keep, row, "left_semi").dropDuplicates([row]).drop(row)
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
