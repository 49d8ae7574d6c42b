"""Draws, marginals and the pipeline against plain computations."""

import re

import numpy as np

from plumbline.llm import mixing, resample


def test_held_out_accuracy_and_same_fate_in_both_forms(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit_on, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = resample.weigh(docs, fit_on)
    out = got.join(held, "doc_id").toPandas()
    assert ((out["quality"] == 1) == out["kept"]).mean() > 0.93
    assert out[out["quality"] == 1]["kept"].mean() > 0.97
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert kept == {r.doc_id for r in resample.select(docs, fit_on).collect()}
    assert resample.weigh(docs, labels.where("false")).where("not kept").count() == 0


def plain_grams(text):
    """Buckets of a text's n-grams, one by one."""
    from plumbline.llm._words import mix

    raw, half, out = text.encode(), resample.BUCKETS // 2, []
    for k in range(len(raw) - 2):
        out.append((int.from_bytes(raw[k : k + 3], "big") * 2654435761 % 2**32) >> 19)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    kind = resample._CLASS
    shape = []
    for i, (s, e) in enumerate(spans):
        same = int(i > 0 and raw[s:e] == raw[slice(*spans[i - 1])])
        last = len(raw) - 1
        shape.append(
            int(kind[raw[s]]) + 6 * int(kind[raw[min((s + e) // 2, last)]]) + 36 * int(kind[raw[e - 1]]) + 216 * min(int(np.log2(e - s)), 5) + 1296 * same
            + 2592 * (raw[e - 1] == 46) + 5184 * (raw[min(e, last)] == 10)
        )
    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    for n in (1, 3):
        for k in range(len(shape) - n + 1):
            c = n
            for x in shape[k : k + n]:
                c = (c * 0x9E3779B97F4A7C15 + one(x)) % 2**64
            out.append(one(c) % half + half)
    return out


def test_weights_and_draw_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: plain_grams(r.text or "") for r in docs.collect()}
    good = {r.doc_id: r.quality > 0 for r in labels.collect()}
    fit_on = {i for i in good if int(resample.mix(np.array([i], np.uint64))[0]) & 1}
    raw, hit = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for i, g in rows.items():
        np.add.at(raw, g, 1)
        if i in fit_on and good[i]:
            np.add.at(hit, g, 1)
    ratio = np.log((hit + 0.5) / (hit.sum() + 0.5 * len(hit))) - np.log((raw + 0.5) / (raw.sum() + 0.5 * len(raw)))
    want = {i: sum(ratio[x] for x in g) / max(len(g), 1) ** 0.5 for i, g in rows.items()}
    got = {r.doc_id: r for r in resample.weigh(docs, labels).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.n_grams == len(rows[i]) and abs(r.log_weight - want[i]) < 1e-6 and abs(r.noisy - want[i] - resample.gumbel(np.array([i]))[0]) < 1e-6
    held = sorted(i for i in good if i not in fit_on and i in rows)
    # the cut with the most held-out texts on their right side, then as many as lie above it, by noisy weight
    cuts = [-np.inf, *(want[i] for i in held), np.inf]
    best = max(sum((want[i] >= c) == good[i] for i in held) for c in cuts)
    k = sum(r.kept for r in got.values())
    cut = sorted(want.values())[-k] if k else np.inf
    assert sum((want[i] >= cut - 1e-9) == good[i] for i in held) == best
    order = sorted(got, key=lambda i: -got[i].noisy)
    assert {i for i, r in got.items() if r.kept} == set(order[:k])


def test_draw_follows_the_gumbel_law():
    ids = np.arange(200_000)
    g = resample.gumbel(ids)
    for d in (0.0, 0.5, 1.0, 2.0, 4.0):
        ahead = (g[::2] + d > g[1::2]).mean()
        assert abs(ahead - 1 / (1 + np.exp(-d))) < 0.005
    # near the cut verdicts differ from the plain top k as the law says: half of the weights 1 above, half 1 below
    w = np.where(ids % 4 < 2, 0.5, -0.5)
    noisy = w + g
    kept = noisy >= np.sort(noisy)[len(ids) // 2]
    # the share x of kept ones solves 1/2 = mean over both kinds of P(kept): P = 1 - exp(-exp(w - t))
    lo, hi = -5.0, 5.0
    for _ in range(80):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if np.mean([1 - np.exp(-np.exp(x - t)) for x in (0.5, -0.5)]) > 0.5 else (lo, t)
    assert abs(kept[w < 0].mean() - (1 - np.exp(-np.exp(-0.5 - t)))) < 0.005 and kept[w < 0].mean() > 0.3


def test_kth_largest(spark):
    r = np.random.default_rng(3)
    v = np.concatenate((r.normal(size=200) * 100, [0.0, -0.0, 5.5, 5.5, -7.25]))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for k in (1, 2, 7, 100, len(v)):
        assert resample.kth_largest(df, "v", k) == sorted(v)[-k]
    assert resample.kth_largest(df, "v", 0) is None


def test_odd_rows(spark):
    rows = [(1, "good words here and there " * 3, "a", "x"), (2, None, None, None), (None, "t", "a", None), (2, None, None, None), (3, "", "b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as kept", "2 as topic", "3 as weight")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample.weigh(df, labels).count() == 5
    assert resample.select(df, labels).columns == df.columns
    assert mixing.weigh(df).count() == 5 and mixing.sample(df).columns == df.columns
    empty = df.where("false")
    assert resample.weigh(empty, labels).count() == mixing.weigh(empty).count() == mixing.sample(empty).count() == 0


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    cells = rng.integers(1, 1000, len(codes)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in (4, 3, 2)]
    w = mixing.rake(cells, codes, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], w) / w.sum(), t, atol=1e-8)
    p = mixing.probabilities(cells, w, 0.3)
    assert abs((cells * p).sum() / cells.sum() - 0.3) < 1e-6 and (p <= 1).all()
    free = p < 1
    assert np.allclose((p * cells / w)[free], (p * cells / w)[free][0])


def test_mixing_keeps_the_budget_and_agrees_in_both_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.weigh(docs, budget=0.5).toPandas()
    share = out[out["kept"]]["n_tokens"].sum() / out["n_tokens"].sum()
    assert 0.4 < share < 0.6
    assert set(out[out["kept"]]["doc_id"]) == {r.doc_id for r in mixing.sample(docs, budget=0.5).collect()}
    to = {"lang": {"en": 0.5, "fr": 0.5}}
    two = mixing.weigh(docs, to, budget=0.1).toPandas()
    assert two[~two["lang"].isin(["en", "fr"])]["kept"].sum() == 0


def test_mixing_keeps_every_category(spark):
    rows = [(k * 10 + j, "word " * (5 + k % 17), f"s{k:03d}", "en") for k in range(300) for j in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.weigh(df).toPandas()
    have = out.groupby("source")["n_tokens"].sum().astype(float)
    got = (out["weight"] * out["n_tokens"]).groupby(out["source"]).sum()
    want = (have / have.sum()) ** mixing.TEMPER
    assert len(got) == 300 and np.allclose(got / got.sum(), want / want.sum(), atol=1e-8)
    to = {f"s{k:03d}": 1.0 + k for k in range(300)}
    out = mixing.weigh(df, {"source": to}, budget=0.01).toPandas()
    got = (out["weight"] * out["n_tokens"]).groupby(out["source"]).sum()
    assert np.allclose((got / got.sum()).to_numpy(), np.arange(1, 301) / sum(range(1, 301)), atol=1e-8)
    assert (out["probability"] > 0).all()
    empty = spark.createDataFrame([(1, "word", "a", "en"), (2, "", "b", "en"), (3, "", "a", None)], "doc_id long, text string, source string, lang string")
    p = {r.doc_id: r.probability for r in mixing.weigh(empty, {"source": {"a": 1.0}}).collect()}
    assert p[1] > 0 and p[2] == 0 and p[3] == 1


def test_mixing_reports_marginals_and_takes_token_counts(spark):
    rows = [(k, "word " * 9, "ab"[k % 2], ("en", "fr")[k % 2], 10 + k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tok long")
    mix = mixing.fit(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "fr": 0.8}}, tokens_col="tok")
    rep = {(r.dimension, r.category): r for r in mixing.marginals(mix, spark).collect()}
    # source a occurs in English only: both targets cannot hold, and the report says so
    assert rep["source", "a"].target == 0.9 and max(r.off for r in rep.values()) > 0.3
    ok = mixing.marginals(mixing.fit(df, tokens_col="tok"), spark).agg({"off": "max"}).first()[0]
    assert ok < 1e-8
    assert mixing.weigh(df, tokens_col="tok").agg({"n_tokens": "sum"}).first()[0] == sum(10 + k for k in range(40))


def test_whole_mixing_query_by_brute_force(spark):
    from collections import Counter, defaultdict

    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in mixing.weigh(docs).collect()}
    cells, facts = defaultdict(int), {}
    for r in docs.collect():
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        long = Counter(x for x in w if len(x.encode()) >= 5)
        # the group of the commonest longer word; which group a word is in, the operator says of that word alone
        top = {int(mixing.topics(pa.array([x]))[0][0]) for x, c in long.items() if c == max(long.values())} or {-1}
        facts[r.doc_id] = (r.source, r.lang, len(w))
        assert int(got[r.doc_id].topic) in top and got[r.doc_id].n_tokens == len(w)
        cells[r.source, r.lang, got[r.doc_id].topic] += len(w)
    names = [sorted({c[d] for c in cells}) for d in range(3)]
    t = np.zeros([len(x) for x in names])
    for c, n in cells.items():
        t[tuple(names[d].index(c[d]) for d in range(3))] = n
    w = t.copy()
    want = []
    for d in range(3):
        have = t.sum(axis=tuple(x for x in range(3) if x != d)) ** mixing.TEMPER
        want.append(have / have.sum() * t.sum())
    for _ in range(500):
        for d in range(3):
            rest = tuple(x for x in range(3) if x != d)
            w *= np.expand_dims(want[d] / w.sum(axis=rest), rest)
    rate = np.where(t > 0, w / np.maximum(t, 1), 0)
    lo, hi = 0.0, 1 / rate[rate > 0].min()
    for _ in range(100):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (t * np.minimum(1, c * rate)).sum() < mixing.BUDGET * t.sum() else (lo, c)
    for i, (source, lang, n) in facts.items():
        at = tuple(names[d].index(x) for d, x in enumerate((source, lang, got[i].topic)))
        if t[at]:
            assert abs(got[i].weight - rate[at]) < 1e-6 and abs(got[i].probability - min(1, hi * rate[at])) < 1e-6
        assert got[i].kept == (mixing._draw(np.array([i]))[0] < got[i].probability)


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kinds = dict(docs.dtypes)
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", None, 0), (2, "one text of two rows with one id " * 9, "en", "s", 9),
            (2, "quite another text under the same id " * 9, None, "s", 9), (2, "one text of two rows with one id " * 9, "en", "s", 9)]
    odd = spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "text", "lang", "source", "n_chars")))
    odd = odd.selectExpr("*", "1 as kept", "2 as _row", "3 as n", "4 as key", "5 as component_id", "6 as quality")
    for start in (odd, odd.where("false")):
        x = start
        for name, stage in cp.STAGES:
            x = stage(spark, x, "/root/testdata/sf0.001")
            if name != "sentencepiece":
                assert x.columns == odd.columns, name
        assert x.count() <= 6


def test_pipeline_by_its_stages(spark):
    import corpus_pipeline as cp
    from plumbline.llm import pii
    from tests.llm.test_minhash import brute

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    a = resample.select(docs, labels).toPandas()
    firsts = {i for i, _, c in brute(list(zip(a["doc_id"].tolist(), a["text"], strict=True)), 5) if i == c}
    b = a[a["doc_id"].astype(str).isin(firsts)]
    c = [(r.doc_id, pii.masked(r.text), r.lang, r.source) for r in b.itertuples()]
    masked = spark.createDataFrame(c, "doc_id long, text string, lang string, source string")
    want = {r.doc_id for r in mixing.sample(masked).collect()}
    got = cp.run(spark, d)
    assert {r.doc_id for r in got.collect()} == want
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "minhash near-dedup", "pii", "mixing", "sentencepiece"]
