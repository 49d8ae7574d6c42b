"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (texts labelled good) and one of the raw corpus (all
texts), give every text the importance weight sum(log p_target - log p_raw) over its n-grams. Adding Gumbel noise to
the log weights and keeping the k largest draws k texts without replacement in proportion to their weights. k is the
number of texts whose weight is at or above the cut that best parts good from bad on labelled texts held out from
the target model.

n-grams: three bytes in a row, three word shapes in a row (capitals, digits, marks at the end, length, same as the
word before). Counts run over all texts. Only the labelled rows are bounded: ``LABELLED`` of them, spread by a hash
of the id, half for the target model and half for the cut.

Defined results: a null text is an empty one; a text without n-grams has weight 0; rows with a null id are weighed
like others with the noise of id 0; rows that repeat an id and a text share their fate; without labelled rows of both
kinds every text is kept. Other columns are ignored by :func:`weigh` and kept by :func:`select`; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._words import SLICE_BYTES, U, mix, slices, word_hashes, words
from plumbline.session import materialise, ship

#: Labelled rows that fitting looks at, at most.
LABELLED = 20_000
BUCKETS = 1 << 14

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 3 digit, 4 mark, 5 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


def grams(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram of the rows' texts, in parts of bounded size however long a text is."""
    half = BUCKETS // 2
    for o in range(0, len(buf) - 2, SLICE_BYTES):
        x = buf[o : o + SLICE_BYTES + 2].astype(np.uint32)
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        tri = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)  # the top 13 bits
        row = np.searchsorted(off, np.arange(o, o + len(x)), "right") - 1 if len(off) > 2 else np.zeros(len(x), np.int64)
        inside = row[:-2] == row[2:]
        yield tri[inside], row[:-2][inside]
    s, e, row = words(buf, off)
    h = word_hashes(buf, s, e)
    at = lambda k: np.minimum(k, len(buf) - 1)
    step = SLICE_BYTES // 8
    for o in range(0, len(s), step):
        # two words more, for the n-grams that begin here, and the word before, for sameness
        ps, pe, pr, ph = (x[o : o + step + 2] for x in (s, e, row, h))
        before = slice(max(o - 1, 0), o - 1 + len(ps))
        same = np.zeros(len(ps), np.int64)
        skip = int(o == 0)
        same[skip:] = (ph[skip:] == h[before]) & (pr[skip:] == row[before])
        shape = (
            _CLASS[buf[ps]].astype(np.int64) + 6 * _CLASS[buf[at((ps + pe) // 2)]] + 36 * _CLASS[buf[pe - 1]]
            + 216 * np.minimum(np.log2(pe - ps).astype(np.int64), 5) + 1296 * same + 2592 * (buf[pe - 1] == 46) + 5184 * (buf[at(pe)] == 10)
        )
        for n in (1, 3):
            m = min(step, len(shape) - n + 1)
            if m <= 0:
                continue
            with np.errstate(over="ignore"):
                c = np.full(m, U(n))
                for j in range(n):
                    c = c * U(0x9E3779B97F4A7C15) + mix(shape[j : m + j].astype(U))
            ok = pr[:m] == pr[n - 1 : m + n - 1]
            yield (mix(c)[ok] % U(half)).astype(np.int64) + half, pr[:m][ok]


def gumbel(ids: np.ndarray) -> np.ndarray:
    """Gumbel noise fixed by the id."""
    u = (mix(ids.astype(np.int64).view(U) ^ U(0x5DEECE66D1CE4E5B)) >> U(11)).astype(float) / 2.0**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


@dataclass
class Model:
    """log p_target - log p_raw of every bucket, and the least noisy weight that is kept (None: keep all)."""

    ratio: np.ndarray
    least: float | None


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _weights(batch: pa.RecordBatch, id_at: int, text_at: int, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
    for a, b, buf, off in slices(batch.column(text_at)):
        for g, row in grams(buf, off):
            n[a:b] += np.bincount(row, minlength=b - a)
            w[a:b] += np.bincount(row, ratio[g], b - a)
    w /= np.sqrt(np.maximum(n, 1))
    return w, n


def _count(docs: DataFrame, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts and of the target's: a fixed number of buckets, summed before they leave a task."""
    ids = docs.sparkSession.sparkContext.broadcast(target)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            hit = np.isin(_ids(batch.column(0)), ids.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in slices(batch.column(1)):
                for g, row in grams(buf, off):
                    raw += np.bincount(g, minlength=BUCKETS)
                    good += np.bincount(g[hit[a:b][row]], minlength=BUCKETS)
        live = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(raw[live]), pa.array(good[live])], ["g", "raw", "good"])

    t = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(kernel, "g long, raw long, good long")
        .groupBy("g").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    )
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[t["g"]], good[t["g"]] = t["raw"], t["good"]
    return raw, good


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight, noisy) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = _weights(batch, 0, 1, ratio)
            noisy = w + gumbel(_ids(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(w), pa.array(noisy)], ["doc_id", "n_grams", "log_weight", "noisy"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        kernel, "doc_id long, n_grams long, log_weight double, noisy double"
    )


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the most labelled texts on their right side (good ones at or above it)."""
    order = np.argsort(weight, kind="stable")
    w, y = weight[order], good[order].astype(int)
    right = np.concatenate(([0], np.cumsum(1 - y))) + y.sum() - np.concatenate(([0], np.cumsum(y)))
    ok = np.concatenate(([True], w[1:] > w[:-1], [True]))
    k = int(np.argmax(np.where(ok, right, -1)))
    if k == 0:
        return -np.inf
    return np.inf if k == len(w) else (w[k - 1] + w[k]) / 2


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value of a double column: four passes over histograms of 16 bits each; None if k is 0."""
    if k <= 0:
        return None
    bits, keyed = F.col("_key"), df.select(col).mapInArrow(_sortable, "_key long")
    prefix = 0
    for shift in (48, 32, 16, 0):
        part = keyed if shift == 48 else keyed.where(F.shiftright(bits, shift + 16) == prefix)
        part = part.select(F.shiftright(bits, shift).alias("b")).groupBy("b").count().toPandas().sort_values("b", ascending=False)
        run = part["count"].cumsum().to_numpy()
        at = int(np.searchsorted(run, k))
        if at == len(run):
            at = len(run) - 1
        prefix = int(part["b"].iloc[at])
        k -= int(run[at - 1]) if at else 0
    return float(_unsort(np.array([prefix], np.int64))[0])


def _sortable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).astype(float).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(x >= 0, x, x ^ np.int64(0x7FFFFFFFFFFFFFFF)))], ["_key"])


def _unsort(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, x, x ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(float)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Model, DataFrame]:
    """The model, and the table of :func:`score` for all rows."""
    spark = docs.sparkSession
    ship(spark)
    pick = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toPandas()
    )
    ids, good = pick["doc_id"].to_numpy(np.int64), pick["quality"].to_numpy() > 0
    half = (mix(ids.view(U)) & U(1)).astype(bool) if len(ids) else np.zeros(0, bool)
    raw, hit = _count(docs, np.sort(ids[half & good]))
    if not hit.sum() or good.all():
        return Model(np.zeros(BUCKETS), None), materialise(score(docs, np.zeros(BUCKETS)), "scores")
    ratio = np.log((hit + 0.5) / (hit.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    scores = materialise(score(docs, ratio), "scores")
    # as an Arrow table: a list of rows would start Python workers of another kind, which stay idle beside the others
    held = spark.createDataFrame(pa.table({"doc_id": ids[~half], "good": good[~half]}))
    seen = scores.join(F.broadcast(held), "doc_id").groupBy("doc_id").agg(F.max("log_weight").alias("w"), F.first("good").alias("good")).toPandas()
    cut = best_cut(seen["w"].to_numpy(), seen["good"].to_numpy()) if len(seen) else -np.inf
    k = scores.where(F.col("log_weight") >= F.lit(float(cut))).count()
    least = kth_largest(scores.select("noisy"), "noisy", k)
    return Model(ratio, np.inf if least is None else least), scores


def weigh(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, n_grams, log_weight, noisy, kept) of every row of ``docs``."""
    model, scores = fit(docs, labels, labelled)
    kept = F.lit(True) if model.least is None else F.col("noisy") >= F.lit(float(model.least))
    return scores.withColumn("kept", kept)


def select(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, all columns as they are; no shuffle of texts."""
    model, _ = fit(docs, labels, labelled)
    if model.least is None:
        return docs
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    ratio, least = model.ratio, model.least

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = _weights(batch, id_at, text_at, ratio)
            mask = pa.array(w + gumbel(_ids(batch.column(id_at))) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], batch.schema.names)

    return docs.mapInArrow(kernel, StructType(docs.schema.fields))
