"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source x language x topic. Raking scales the cells until their sums by source, by
language and by topic meet the target marginals. A cell's raked weight over its tokens gives the probability with
which its texts are kept: the probabilities keep the raked proportions, are cut at 1, and are scaled (by bisection)
so that the expected number of kept tokens is the budget. Each text is then kept or not by a hash of its id.

Every category is raked by itself. Where targets are given, categories that they do not name share the target of
``OTHER``, 0 if there is none. The cell table on the driver, which is broadcast, has a row for each source,
language and topic that occur together: it grows with the categories, not with the rows. Nothing else leaves the
executors. Targets need not be reachable (a source may occur in one language only): :func:`marginals` says of every
category what was asked and what the raked weights give, and how far the worst one is off.

Tokens are words, unless a column of token counts is given (``tokens_col``, say from the token counting operator). A
text's topic, where no topic column is given, is the group (by hash) of its most frequent word of five bytes or more,
ties going to the least hash; texts without such words have topic -1.

Defined results: a null source or language is a category; a null text is an empty one (no tokens, topic -1); rows
with a null id draw like id 0; rows that repeat an id draw alike; other columns are ignored by :func:`weigh` and kept
by :func:`sample`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._words import U, lower, mix, slices, word_hashes, words
from plumbline.session import materialise, ship

TOPICS = 8
#: Target shares, where none are given: the corpus' own shares to this power, so that large categories shrink.
TEMPER = 0.7
#: Share of all tokens that is kept.
BUDGET = 0.9
OTHER = "\0other"
DIMENSIONS = ("source", "lang", "topic")


def topics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Topic and number of words of every text."""
    topic, n = np.full(len(column), -1, np.int64), np.zeros(len(column), np.int64)
    for a, b, buf, off in slices(column):
        low = lower(buf)
        s, e, row = words(low, off)
        n[a:b] = np.bincount(row, minlength=b - a)
        long = np.flatnonzero(e - s >= 5)
        if not len(long):
            continue
        h, r = word_hashes(low, s[long], e[long]), row[long]
        _, first, count = np.unique(mix(h ^ mix(r.astype(U))), return_index=True, return_counts=True)
        h, r = h[first], r[first]
        order = np.lexsort((h, -count, r))
        top = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
        topic[a:b][r[top]] = (h[top] % U(TOPICS)).astype(np.int64)
    return topic, n


def rake(cells: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tol: float = 1e-10):
    """Weights of cells (rows of codes, one column a dimension) whose sums meet the target shares."""
    w = cells.astype(float).copy()
    total = w.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, t in enumerate(targets):
            have = np.bincount(codes[:, d], w, len(t))
            live = have > 0
            want = np.where(live, t, 0)
            want = want / want.sum() * total
            f = np.where(live, want / np.where(live, have, 1), 0)
            worst = max(worst, float(np.abs(f[live] - 1).max()))
            w *= f[codes[:, d]]
        if worst < tol:
            break
    return w


def probabilities(cells: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Keeping probabilities in proportion to weight over tokens, cut at 1, that keep ``budget`` of the tokens."""
    r = weights / np.maximum(cells, 1)
    lo, hi = 0.0, 1.0 / max(r[r > 0].min(), 1e-12) if (r > 0).any() else 1.0
    for _ in range(200):
        c = (lo + hi) / 2
        if (cells * np.minimum(1, c * r)).sum() < budget * cells.sum():
            lo = c
        else:
            hi = c
    return np.minimum(1, hi * r)


def _draw(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U) ^ U(0xA0761D6478BD642F)) >> U(11)).astype(float) / 2.0**53


def _facts(docs: DataFrame, topic_col: str | None, tokens_col: str | None) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic, n = topics(batch.column(3)) if not (topic_col and tokens_col) else (None, None)
            own = batch.column(4) if topic_col else pa.array(topic.astype(str), pa.string())
            count = batch.column(5) if tokens_col else pa.array(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own, count], ["doc_id", "source", "lang", "topic", "n_tokens"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.col("text"),
            (F.col(topic_col).cast("string") if topic_col else F.lit("")).alias("_topic"),
            (F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)) if tokens_col else F.lit(0)).cast("long").alias("_tokens")]
    return docs.select(*cols).mapInArrow(kernel, "doc_id long, source string, lang string, topic string, n_tokens long")


@dataclass
class Mix:
    """What raking gives: (source, language, topic) -> (weight per token, probability), and its marginals."""

    cells: dict
    facts: DataFrame
    marginals: list[tuple[str, str | None, float, float]]  # dimension, category, share asked for, share of the weights


def fit(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, topic_col: str | None = None, tokens_col: str | None = None
) -> Mix:
    ship(docs.sparkSession)
    facts = materialise(_facts(docs, topic_col, tokens_col), "facts")
    sums = facts.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("t")).toArrow()
    rows = sorted(zip(*(sums[c].to_pylist() for c in (*DIMENSIONS, "t")), strict=True), key=lambda r: [(x is not None, x or "") for x in r[:3]])
    if not rows:
        return Mix({}, facts, [])
    t = np.array([r[3] for r in rows], float)
    codes = np.zeros((len(rows), 3), np.int64)
    shares: list[np.ndarray] = []
    labels: list[list] = []
    barred = np.zeros(len(rows), bool)
    for k, d in enumerate(DIMENSIONS):
        given = targets.get(d) if targets else None
        names = [x for x in (given if given is not None else dict.fromkeys(r[k] for r in rows)) if x != OTHER or given is None]
        place = {x: i for i, x in enumerate(names)}
        codes[:, k] = [place.get(r[k], len(names)) for r in rows]
        if given is not None:
            share = np.array([given[x] for x in names] + [given.get(OTHER, 0.0)], float)
            barred |= share[codes[:, k]] == 0
        else:
            have = np.bincount(codes[:, k], t, len(names) + 1)
            share = (have / max(have.sum(), 1)) ** TEMPER * (have > 0)
        shares.append(share / max(share.sum(), 1e-300))
        labels.append([*names, OTHER])
    w = rake(t, codes, shares)
    p = np.where(t > 0, probabilities(t, w, budget), np.where(barred, 0.0, 1.0))
    got = [np.bincount(codes[:, k], w, len(labels[k])) / max(w.sum(), 1e-300) for k in range(3)]
    met = [(d, x, float(a), float(b)) for k, d in enumerate(DIMENSIONS) for x, a, b in zip(labels[k], shares[k], got[k], strict=True) if x != OTHER or a or b]
    return Mix(dict(zip((r[:3] for r in rows), zip((w / np.maximum(t, 1)).tolist(), p.tolist(), strict=True), strict=True)), facts, met)


def marginals(mix: Mix, spark: SparkSession) -> DataFrame:
    """(dimension, category, target, share, off): what was asked of each category, what the weights give, the difference."""
    return spark.createDataFrame([(*r, abs(r[2] - r[3])) for r in mix.marginals], "dimension string, category string, target double, share double, off double")


def _lookup(cells: dict, source: pa.Array, lang: pa.Array, topic: list) -> np.ndarray:
    """Weight and probability of each row, looked up once for each combination that the batch holds."""
    seen: dict = {}
    at = [seen.setdefault(c, len(seen)) for c in zip(source.to_pylist(), lang.to_pylist(), topic, strict=True)]
    return np.array([cells[c] for c in seen], float).reshape(-1, 2)[at]


def weigh(
    docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, topic_col: str | None = None, tokens_col: str | None = None
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) of every row."""
    mix = fit(docs, targets, budget, topic_col, tokens_col)
    cells = docs.sparkSession.sparkContext.broadcast(mix.cells)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lookup(cells.value, batch.column(1), batch.column(2), batch.column(3).to_pylist())
            u = _draw(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(u < x[:, 1])],
                [*batch.schema.names, "weight", "probability", "kept"],
            )

    return mix.facts.mapInArrow(
        kernel, "doc_id long, source string, lang string, topic string, n_tokens long, weight double, probability double, kept boolean"
    )


def sample(
    docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, topic_col: str | None = None, tokens_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; no shuffle of texts."""
    cells = docs.sparkSession.sparkContext.broadcast(fit(docs, targets, budget, topic_col, tokens_col).cells)
    at = {c: docs.columns.index(c) for c in ("doc_id", "source", "lang", "text")}
    topic_at = docs.columns.index(topic_col) if topic_col else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if topic_at is None:
                topic = topics(batch.column(at["text"]))[0].astype(str).tolist()
            else:
                topic = batch.column(topic_at).cast(pa.string()).to_pylist()
            source, lang = (batch.column(at[c]).cast(pa.string()) for c in ("source", "lang"))
            p = _lookup(cells.value, source, lang, topic)[:, 1]
            ids = batch.column(at["doc_id"]).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            mask = pa.array(_draw(ids) < p)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], batch.schema.names)

    return docs.mapInArrow(kernel, StructType(docs.schema.fields))
