"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate: emission weights on
bucketed features of the line, transition weights between neighbours, Viterbi decoding. A text is retained if lines
marked as content hold at least half of its words. Plain rules (very short texts, much repetition) come first.

The field is trained here, from document labels. A line takes the label of its document, unless the same line stands
in more of the other kind of documents: then it takes theirs. Training sequences join documents of both kinds end to
end, so labels change within a sequence and the transition weights learn that neighbours tend to agree and where they
do not. Training takes a bounded sample of labelled rows (``TRAIN_DOCS``, spread by a hash of the id) and of each at
most ``TRAIN_LINES`` lines in a row; all else runs on all rows and whole texts.

Defined results: a null text is an empty one (no words, failed by the rules); ids may be null or repeat, each row is
handled by itself; other columns are ignored; an empty table gives an empty result; without any labelled rows every
line counts as content, and the plain rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._words import SLICE_BYTES, U, count_before, mix, slices, word_hashes, words
from plumbline.session import ship

#: Labelled documents that training looks at, at most.
TRAIN_DOCS = 3000
#: Lines of one document that training looks at, at most: a run of lines, from a place fixed by the document.
TRAIN_LINES = 400
#: Share of words in content lines that keeps a text.
CONTENT_SHARE = 0.5
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_BAR = np.arange(256) == 124
_LEAD = (np.arange(256) & 0xC0) != 0x80
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"'")] = True

# Upper bounds of the buckets of each feature: words, symbols, capitals, digits, bars, exclamation marks (shares of
# characters, bars and marks per word), share of repeated words, characters per word; then three yes-or-no features.
BUCKETS = (
    (0, 2, 5, 15, 40), (0, 0.01, 0.03, 0.08, 0.2), (0.02, 0.1, 0.3, 0.6), (0, 0.05, 0.15, 0.4), (0, 0.1, 0.3),
    (0, 0.1, 0.3), (0, 0.3, 0.7), (3, 4.5, 6, 9),
)
LEVELS = (*(len(b) + 1 for b in BUCKETS), 2, 2, 2)
FIRST = np.concatenate(([0], np.cumsum(LEVELS)))


class Scan:
    """Counts of texts, and features of their lines, for one run of rows."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        s, e, row = words(buf, off)
        self.n_words = np.bincount(row, minlength=n)
        chars = _sums(_LEAD, buf, s, e)
        self.word_chars = np.bincount(row, chars, n).astype(np.int64)
        self.n_symbols = _sums(_SYMBOL, buf, off[:-1], off[1:])
        h = word_hashes(buf, s, e)
        repeated = _repeated(h, row)
        self.n_repeat_words = np.bincount(row, repeated, n).astype(np.int64)

        breaks = [np.flatnonzero(buf[o : o + SLICE_BYTES] == 10) + o + 1 for o in range(0, len(buf), SLICE_BYTES)]
        ls = np.unique(np.concatenate((*breaks, off[:-1])))
        ls = ls[ls < len(buf)]
        le = np.append(ls[1:], len(buf))[: len(ls)]
        self.line_row = np.searchsorted(off, ls, "right") - 1
        le = le - ((le > ls) & (buf[np.maximum(le - 1, 0)] == 10) if len(ls) else 0)
        at = np.searchsorted(s, np.append(ls, len(buf)))
        self.words = np.diff(at)
        has = self.words > 0
        self.line_hash = word_hashes(buf, ls, le)
        lh = mix(self.line_hash ^ (self.line_row.astype(U) * U(0x9E3779B97F4A7C15)))
        dup = np.zeros(len(ls), bool)
        cand = np.flatnonzero(has)
        _, firsts = np.unique(lh[cand], return_index=True)
        dup[cand] = True
        dup[cand[firsts]] = False
        self.n_dup_lines = np.bincount(self.line_row[dup], minlength=n)

        size = np.maximum(_sums(_LEAD, buf, ls, le), 1)
        count = np.maximum(self.words, 1)
        rep = np.concatenate(([0], np.cumsum(repeated)))
        values = (
            self.words, _sums(_SYMBOL, buf, ls, le) / size, _sums(_UPPER, buf, ls, le) / size,
            _sums(_DIGIT, buf, ls, le) / size, _sums(_BAR, buf, ls, le) / count, _sums(_BANG, buf, ls, le) / count,
            (rep[at[1:]] - rep[at[:-1]]) / count, size / count,
        )
        codes = [np.searchsorted(b, v, "left") for b, v in zip(BUCKETS, values, strict=True)]
        edge = np.zeros(len(ls), bool)
        if len(ls):
            edge[np.flatnonzero(np.diff(self.line_row, prepend=-1))] = True
        stop = _STOP[buf[np.maximum(le - 1, 0)]] & (le > ls) if len(ls) else edge
        codes += [dup.astype(int), edge.astype(int), stop.astype(int)]
        self.codes = np.stack(codes, 1) + FIRST[:-1] if len(ls) else np.zeros((0, len(LEVELS)), np.int64)
        self.bounds = np.searchsorted(self.line_row, np.arange(n + 1))


def _sums(flags: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """How many bytes of a class stand in each stretch; stretches in order."""
    return count_before(flags, buf, e) - count_before(flags, buf, s)


def _repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words lie in a window of eight words that its text holds twice or more."""
    n = len(h)
    out = np.zeros(n, bool)
    if n < WINDOW:
        return out
    with np.errstate(over="ignore"):
        w = np.zeros(n - WINDOW + 1, U)
        for j in range(WINDOW):
            w = w * U(0xC2B2AE3D27D4EB4F) + h[j : n - WINDOW + 1 + j]
        w = mix(w ^ mix(row[: len(w)].astype(U)))
    at = np.flatnonzero(row[: len(w)] == row[WINDOW - 1 :])
    at = at[np.argsort(w[at], kind="stable")]
    same = w[at[1:]] == w[at[:-1]]
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[hit], 1)
    np.add.at(step, at[hit] + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def _grid(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of like numbers of lines together: (lines of each as a table, which places hold a line)."""
    sizes = np.diff(bounds)
    live = np.flatnonzero(sizes)
    for power in np.unique(np.ceil(np.log2(sizes[live])).astype(int)) if len(live) else ():
        part = live[np.ceil(np.log2(sizes[live])).astype(int) == power]
        t = sizes[part].max()
        place = bounds[part][:, None] + np.arange(t)
        yield np.minimum(place, bounds[-1] - 1), np.arange(t) < sizes[part][:, None]


def viterbi(score: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels (0 boilerplate, 1 content) of all lines; score: lines by labels."""
    out = np.zeros(len(score), np.int8)
    for place, there in _grid(bounds):
        n, t = place.shape
        back = np.zeros((n, t, 2), np.int8)
        best = score[place[:, 0]]
        for k in range(1, t):
            step = best[:, :, None] + trans
            back[:, k] = step.argmax(1)
            new = step.max(1) + score[place[:, k]]
            best = np.where(there[:, k, None], new, best)
        lab = best.argmax(1)
        last = there.sum(1) - 1
        for k in range(t - 1, -1, -1):
            on = k <= last
            out[place[on, k]] = lab[on]
            if k:
                lab = np.where(on, back[np.arange(n), k, lab], lab)
    return out


def gradient(w: np.ndarray, tr: np.ndarray, codes: np.ndarray, grids: list, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the penalised mean log likelihood in both weights, by forward-backward."""
    score = w[codes].sum(1)
    gw, gt = np.zeros_like(w), np.zeros_like(tr)
    for place, there in grids:
        n, t = place.shape
        sc = np.where(there[:, :, None], score[place], 0.0)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = sc[:, 0]
        for k in range(1, t):
            a[:, k] = np.where(there[:, k, None], np.logaddexp.reduce(a[:, k - 1, :, None] + tr, axis=1) + sc[:, k], a[:, k - 1])
        for k in range(t - 2, -1, -1):
            nxt = np.logaddexp.reduce(tr + (sc[:, k + 1] + b[:, k + 1])[:, None, :], axis=2)
            b[:, k] = np.where(there[:, k + 1, None], nxt, 0.0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(a + b - z[:, None, None])
        y = label[place]
        diff = np.stack((y == 0, y == 1), 2) - p
        for s in (0, 1):
            gw[:, s] += np.bincount(codes[place[there]].ravel(), np.repeat(diff[there][:, s], codes.shape[1]), len(w))
        pair = there[:, 1:]
        q = np.exp(a[:, :-1, :, None] + tr + (sc[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gt -= q[pair].sum(0)
        np.add.at(gt, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    return tuple(g / max(1, len(codes)) - 1e-4 * x for g, x in ((gw, w), (gt, tr)))


def train(codes: np.ndarray, bounds: np.ndarray, label: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights that maximise the penalised likelihood of the labels."""
    w, tr = np.zeros((FIRST[-1], 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(tr)], [np.zeros_like(w), np.zeros_like(tr)]
    grids = list(_grid(bounds))
    for it in range(1, rounds + 1):
        for k, (x, g) in enumerate(zip((w, tr), gradient(w, tr, codes, grids, label), strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += 0.15 * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.99**it)) + 1e-8)
    return w, tr


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most ``max_docs`` labelled documents, those with the least hashes of their ids.

    What reaches the driver is bounded: ``max_docs`` times ``max_lines`` lines of 19 bytes, never a text.
    """
    ship(docs.sparkSession)
    pick = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                scan = Scan(buf, off)
                codes, hashes = [], []
                for p, q in zip(scan.bounds[:-1].tolist(), scan.bounds[1:].tolist(), strict=True):
                    if q - p > max_lines:
                        p += int(mix(scan.line_hash[p : p + 1])[0] % U(q - p - max_lines + 1))
                        q = p + max_lines
                    codes.append(scan.codes[p:q].astype(np.uint8).tobytes())
                    hashes.append(scan.line_hash[p:q].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(codes, pa.binary()), pa.array(hashes, pa.binary()), batch.column(2).slice(a, b - a)],
                    ["doc_id", "codes", "hashes", "quality"],
                )

    seen = texts.join(F.broadcast(pick), "doc_id").mapInArrow(kernel, "doc_id long, codes binary, hashes binary, quality int")
    # rows that repeat an id count once
    one = seen.groupBy("doc_id").agg(F.min(F.struct("hashes", "codes", "quality")).alias("r")).select("doc_id", "r.*")
    rows = one.toArrow().sort_by("doc_id")
    of = [np.frombuffer(x, np.uint8).reshape(-1, len(LEVELS)).astype(np.int64) for x in rows["codes"].to_pylist()]
    if not sum(map(len, of)):
        return np.zeros((FIRST[-1], 2)), np.zeros((2, 2))
    return train(*sequences(of, [np.frombuffer(x, U) for x in rows["hashes"].to_pylist()], rows["quality"].to_numpy() > 0))


def sequences(codes: list[np.ndarray], hashes: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, bounds and labels of training sequences: good and bad documents joined in turn, the rest alone."""
    sizes = np.array([len(c) for c in codes])
    label = np.repeat(good, sizes).astype(np.int64)
    doc = np.repeat(np.arange(len(codes)), sizes)
    # each document votes once for a line
    _, line = np.unique(np.concatenate(hashes), return_inverse=True)
    _, first = np.unique(line * len(codes) + doc, return_index=True)
    votes = np.bincount(line[first], np.where(label[first] > 0, 1, -1))[line]
    label = np.where(votes > 0, 1, np.where(votes < 0, 0, label))
    begin = np.cumsum(sizes) - sizes
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = [(x, y) if k % 2 else (y, x) for k, (x, y) in enumerate(zip(g, b, strict=False))]
    rest = [(x,) for x in (*g[len(b) :], *b[len(g) :])]
    order = np.concatenate([np.arange(begin[x], begin[x] + sizes[x]) for p in (*pairs, *rest) for x in p])
    ends = np.cumsum([sum(sizes[x] for x in p) for p in (*pairs, *rest)])
    return np.concatenate(codes)[order], np.concatenate(([0], ends)), label[order]


def verdicts(scan: Scan, weights: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE):
    """(rules failed, words in content lines, kept) of each text; ties of the two labels go to content."""
    w, tr = weights
    n = len(scan.n_words)
    score = w[scan.codes].sum(1) if len(scan.codes) else np.zeros((0, 2))
    score = score + np.array([0.0, 1e-9])
    mark = viterbi(score, scan.bounds, tr)
    content = np.bincount(scan.line_row, scan.words * mark, n).astype(np.int64) if len(mark) else np.zeros(n, np.int64)
    failed = (scan.n_words < 20) | (100 * scan.n_repeat_words > 30 * scan.n_words)
    return failed, content, ~failed & (content >= share * scan.n_words)


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, rule and verdict for every document; content_words are the words of lines marked as content."""
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                scan = Scan(buf, off)
                failed, content, kept = verdicts(scan, weights, share)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(getattr(scan, k), pa.int64()) for k in names),
                     pa.array(failed), pa.array(content), pa.array(kept)],
                    ["doc_id", *names, "base_failed", "content_words", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ", ".join(f"{k} long" for k in names)
    return docs.select("doc_id", "text").mapInArrow(
        kernel, f"doc_id {kind}, {cols}, base_failed boolean, content_words long, kept boolean"
    )
