"""Recall and exact distances against brute force; hot copies; rows that take no part."""

import numpy as np

from plumbline.llm import ann


def brute(ids, x, every=100, k=10):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
        out[int(ids[q])] = order[:k]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p["embedding"]).astype(np.float64)
    want = brute(p["vec_id"].to_numpy(), x)
    got = ann.search(df).collect()
    assert len(got) == sum(map(len, want.values()))
    hits = sum(any(i == r.vec_id for _, i in want[r.query_id]) for r in got)
    assert hits >= 0.95 * len(got)
    place = {int(v): k for k, v in enumerate(p["vec_id"])}
    for r in got[:200]:
        assert abs(r.score - np.sqrt(((x[place[r.query_id]] - x[place[r.vec_id]]) ** 2).sum())) < 1e-12


def test_copies_ties_and_bad_rows(spark):
    hot = [1.0, 0.0, 0.5]
    rows = [(k, hot, 1) for k in range(1, 300)] + [(0, [1.0, 0.1, 0.5], 1), (400, [1.0, 0.1, 0.4], 1), (500, None, 1), (600, [0.0, 0.0, 0.0], 1)]
    rows += [(700, [1.0, None, 0.0], 1), (800, [float("nan"), 1.0, 0.0], 1), (900, [1.0], 1), (None, hot, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(got) == {0, 100, 200, 400}
    assert [got[100][k] for k in range(1, 11)] == list(range(1, 11))
    assert got[0][1] == 400 or got[0][1] == 1
    ids = np.array([r[0] for r in rows[:301]])
    want = brute(ids, np.array([r[1] for r in rows[:301]]))
    for q, best in want.items():
        assert [got[q][k + 1] for k in range(10)] == [int(i) for _, i in best]
    assert ann.search(df.where("false")).count() == 0
    few = spark.createDataFrame([(100, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few).collect()] == [(100, 1, 7)]


def test_recall_among_near_copies(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 16))
    x[::3] = x[0] + r.normal(size=(2000, 16)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    want = brute(ids, x)
    got = ann.search(spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = [any(i == g.vec_id for _, i in want[g.query_id]) for g in got]
    dense = [h for h, g in zip(hits, got, strict=True) if g.query_id % 3 == 0]
    print("recall", np.mean(hits), "in the group", np.mean(dense))
    assert len(got) == 600 and all(hits)


def test_recall_on_fifty_thousand(spark):
    r = np.random.default_rng(12)
    n, dim = 50_000, 32
    # a mixture of clusters of very different sizes, a third in one dense group, a tenth without any structure
    middles = r.normal(size=(200, dim))
    x = middles[r.integers(0, 200, n) * (r.random(n) < 0.67)] + r.normal(size=(n, dim)) * r.choice([0.1, 0.4, 0.8], n)[:, None]
    x[::10] = r.normal(size=(n // 10, dim))
    ids = np.arange(n)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    for probes, cell_rows, least in ((ann.PROBES, ann.CELL_ROWS, 0.95), (16, 512, 0.8)):
        got: dict[int, set] = {}
        for g in ann.search(df, probes=probes, cell_rows=cell_rows).collect():
            got.setdefault(g.query_id, set()).add(g.vec_id)
        hits = []
        for q in ids[::100]:
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits.append(len(got[q] & set(np.argpartition(d, 10)[:10].tolist())) / 10)
        print("recall with", probes, "of", -(-n // cell_rows), "cells:", np.mean(hits))
        assert len(got) == 500 and np.mean(hits) >= least


def test_the_most_frequent_length_counts(spark):
    rows = [(k, [float(k % 7) + 1, 2.0, float(k)]) for k in range(1, 60)] + [(100, [1.0, 2.0, 3.0]), (200, [1.0, 2.0]), (300, [4.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {g.query_id for g in got} == {100} and len(got) == 10
