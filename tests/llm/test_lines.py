"""Counts against a plain reading of the rules; decoding against all labellings; verdicts on held-out texts."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import lines
from plumbline.llm._words import slices


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_counts():
    r = random.Random(4)
    texts = ["", "\n", " \n \n", "a\na\n a", "é ü\né ü", "x " * 30]
    texts += ["".join(r.choice(["a", "b ", "\n", "c", " ", "#", "é"]) for _ in range(r.randint(0, 120))) for _ in range(500)]
    texts += [" ".join(r.choice(["p", "q"]) for _ in range(40)) for _ in range(100)]
    for a, b, buf, off in slices(pa.array(texts), 500):
        s = lines.Scan(buf, off)
        got = list(zip(s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, strict=True))
        assert [tuple(map(int, x)) for x in got] == [brute(t) for t in texts[a:b]]


def test_viterbi_is_the_best_of_all():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 1, 1, 5, 12])
    score, trans = rng.normal(size=(12, 2)), rng.normal(size=(2, 2))
    got = lines.viterbi(score, bounds, trans)
    for a, b in itertools.pairwise(bounds):
        value = lambda y: sum(score[a + k, s] for k, s in enumerate(y)) + sum(trans[p, q] for p, q in itertools.pairwise(y))  # noqa: B023, E731
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=value)


def test_held_out_verdicts(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = lines.fit(docs, labels.where("doc_id % 2 = 0"))
    out = lines.judge(docs, weights).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert ((out["quality"] == 1) == out["kept"]).mean() > 0.95
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 5000, None)], "doc_id long, text string, kept string")
    rows = lines.judge(odd, weights).collect()
    assert len(rows) == 4 and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    none = lines.fit(docs.where("false"), labels)
    assert lines.judge(docs.where("doc_id < 20"), none).where("kept = base_failed").count() == 0
    assert lines.judge(docs.where("false"), weights).count() == 0


def likelihood(w, tr, codes, bounds, label):
    """Penalised log likelihood as training states it, by summing over all labellings."""
    total = 0.0
    for a, b in itertools.pairwise(bounds):
        score = w[codes[a:b]].sum(1)
        value = lambda y: sum(score[k, s] for k, s in enumerate(y)) + sum(tr[p, q] for p, q in itertools.pairwise(y))  # noqa: B023, E731
        if b > a:
            total += value(label[a:b]) - np.logaddexp.reduce([value(y) for y in itertools.product((0, 1), repeat=b - a)])
    return total / len(codes) - 0.5e-4 * ((w**2).sum() + (tr**2).sum())


def test_gradient():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, lines.FIRST[-1], (14, 3))
    bounds, label = np.array([0, 1, 6, 6, 14]), rng.integers(0, 2, 14)
    w, tr = rng.normal(size=(lines.FIRST[-1], 2)), rng.normal(size=(2, 2))
    gw, gt = lines.gradient(w, tr, codes, list(lines._grid(bounds)), label)
    for x, g in ((w, gw), (tr, gt)):
        for at in np.ndindex(x.shape):
            keep = x[at]
            x[at] = keep + 1e-5
            up = likelihood(w, tr, codes, bounds, label)
            x[at] = keep - 1e-5
            down = likelihood(w, tr, codes, bounds, label)
            x[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7


def test_lines_that_many_documents_share_decide_their_labels():
    codes = [np.zeros((2, 3), int) + k for k in range(4)]
    hashes = [np.array(x, np.uint64) for x in ([1, 2], [2, 3], [2, 4], [1, 5])]
    got, bounds, label = lines.sequences(codes, hashes, np.array([True, False, False, True]))
    # line 2 stands in two bad documents and one good one, line 1 in two good ones
    assert bounds.tolist() == [0, 4, 8] and sorted(map(tuple, zip(got[:, 0].tolist(), label.tolist(), strict=True))) == [
        (0, 0), (0, 1), (1, 0), (1, 0), (2, 0), (2, 0), (3, 1), (3, 1)
    ]


def test_marks_change_at_the_seam(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = lines.fit(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").where("text like '%\n%'").select("text", "quality").orderBy("doc_id").limit(3000).toPandas()
    good, bad = held[held["quality"] == 1]["text"].tolist(), held[held["quality"] == 0]["text"].tolist()
    right = total = both = 0
    for k, (g, b) in enumerate(zip(good, bad, strict=False)):
        first, second = (g, b) if k % 2 else (b, g)
        for _, _, buf, off in slices(pa.array([first + "\n" + second])):
            s = lines.Scan(buf, off)
            mark = lines.viterbi(weights[0][s.codes].sum(1), s.bounds, weights[1])
        seam = first.count("\n") + 1
        want = np.repeat([k % 2, 1 - k % 2], [seam, len(mark) - seam])
        right += (mark == want).sum()
        total += len(mark)
        both += 0 < mark.sum() < len(mark)
    print("lines right", right / total, "texts with both marks", both / min(len(good), len(bad)))
    assert right > 0.85 * total and both > 0.8 * min(len(good), len(bad))


def test_verdicts_of_the_whole_query_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = lines.fit(docs, labels)
    got = {r.doc_id: r for r in lines.judge(docs, weights).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, rep = brute(r.text or "")
        failed = n < 20 or 100 * rep > 30 * n
        for _, _, buf, off in slices(pa.array([r.text])):
            s = lines.Scan(buf, off)
        score = weights[0][s.codes].sum(1) + np.array([0.0, 1e-9])
        best = [score[0]] if len(score) else []
        back = []
        for k in range(1, len(score)):  # one line after another, in plain terms
            step = best[-1][:, None] + weights[1]
            back.append(step.argmax(0))
            best.append(step.max(0) + score[k])
        y = [int(best[-1].argmax())] if best else []
        for p in reversed(back):
            y.insert(0, int(p[y[0]]))
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (r.text or "").split("\n")]
        content = sum(w for w, m in zip(words, y, strict=False) if m)
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (n, chars, symbols, dup, rep, failed)
        assert x.content_words == content and x.kept == (not failed and content >= 0.5 * n)
