"""Groups against brute force on exact sets."""

import random
import re

import numpy as np

from plumbline.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            i = len(sets[a] & sets[b])
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return sorted((str(i), len(s), str(None if i is None else root(i))) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    rows += ["", None, " \n\t ", "One", "one", "two words", "Two words", "é É", "x " * 400, "x x"]
    r.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[0]), (None, None), (5, rows[5]), (7, "another text with the same id as seven")]


def test_groups_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    for k in (2, 5):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in minhash.group(df, k).collect())
        assert got == brute(rows, k)


def test_bucket_with_many_groups_takes_further_rounds(spark):
    # one long common part: texts share buckets often, yet most pairs stay below the similarity
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(9):
            w[r.randrange(100)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (3, 16, 1024):
        got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in minhash.group(df, 2, cell=cell).collect())
        assert got == brute(rows, 2)


def test_dedup_keeps_one_and_all_columns(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "a b c d e f g", "y"), (None, "q", None), (4, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = minhash.dedup(df)
    assert out.columns == df.columns
    assert sorted(str(tuple(x)) for x in out.collect()) == sorted(["(1, 'a b c d e f g', 'x')", "(None, 'q', None)", "(4, None, None)"])
    assert minhash.dedup(df.where("false")).count() == 0
    assert minhash.group(df.where("false")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        u = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.sort(u[:200]), np.sort(u[40:240])
        sig = minhash.signatures([a, b], 240)
        errors.append((sig[0] == sig[1]).mean() - 160 / 240)
        assert (np.sort(sig >> np.uint64(48), axis=1) < 240).all()
    assert abs(np.mean(errors)) < 0.02


def test_dedup_keeps_unlike_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, b + " more"), (4, c), (4, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in minhash.dedup(df).collect()]
    assert sorted((i or 0, t) for i, t in got) == sorted([(1, a), (1, b), (4, c), (0, a)])
