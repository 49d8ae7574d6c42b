"""A piece vocabulary and a dynamic program over prefixes, vectorised over equal-length segments.

The model files at hand hold merge-ordered pieces (best piece first, leftmost on ties). For such a vocabulary:

* the encoding of a text cut between two of its tokens is the encodings of the two parts, so every prefix of a text
  has one last token, and what stands before it is the encoding of a shorter prefix;
* a row of tokens is the encoding of its text exactly if each token encodes to itself and no two neighbours would
  merge across their border.

So the program keeps, for every prefix of a segment, its last token and its token count. A candidate last token is a
piece that ends there (found by probing the sorted hashes of all pieces with the hash of the substring); it is valid
if its border to the last token of the shorter prefix holds; exactly one is. The border test undoes the later of the
two tokens step by step and asks whether the parts at the border would have merged first. Segments of equal length
advance together as matrix columns.

Segments are cut before a space that follows another character and beside control characters, but only where the two
characters at the cut stand side by side in no piece of the vocabulary (by their bytes at the border): every merge
across a cut would make a piece that holds them, so none can cross. Characters that are in no piece become byte
pieces, one for each byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm._words import U, slices, word_hashes

SPACE = "▁"
_B = U(0x9E3779B97F4A7C15 | 1)
#: Segments above this length take the scalar form of the same program.
LONG = 512
#: Text bytes that one look into the table takes: each look that finds new segments copies the table's keys.
RUN_BYTES = 2 << 20


def _char_code(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (c.astype(U) + U(0x632BE59BD9B4E019)) * U(0xBF58476D1CE4E5B9)
        return x ^ (x >> U(29))


@dataclass
class Pieces:
    """Arrays over token ids; ids from ``n_pieces`` on stand for single characters that are no pieces."""

    keys: np.ndarray  # sorted hashes of all pieces
    key_ids: np.ndarray
    hashes: np.ndarray
    lens: np.ndarray  # in characters
    rank: np.ndarray  # merge order; -1 for single characters
    left: np.ndarray
    right: np.ndarray
    whole: np.ndarray  # encodes to itself
    single: dict[int, int]  # code point -> id
    n_pieces: int
    byte0: int  # id of the piece of byte 0
    texts: list[bytes]  # bytes of each piece; byte pieces give their byte
    max_len: int
    seen: np.ndarray  # whether any key has these top 20 bits
    joined: np.ndarray  # whether some piece holds these two bytes side by side, the space sign as one space

    def unknown(self) -> int:
        return len(self.hashes) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1; a bit table turns most others away first."""
        out = np.full(len(h), -1, np.int32)
        may = np.flatnonzero(self.seen[h >> U(44)])
        if len(may):
            x = h[may]
            at = np.searchsorted(self.keys, x)
            at[at == len(self.keys)] = 0
            out[may] = np.where(self.keys[at] == x, self.key_ids[at], -1)
        return out

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when they stand side by side."""
        ok = np.ones(len(a), bool)
        i = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        with np.errstate(over="ignore"):
            while len(i):
                joint = self.find(self.hashes[a] * _POW[self.lens[b]] + self.hashes[b])
                crossed = (joint >= 0) & (2 * self.rank[joint] < limit)
                ok[i[crossed]] = False
                ra, rb = self.rank[a], self.rank[b]
                go = ~crossed & ((ra >= 0) | (rb >= 0))
                i, a, b, ra, rb = i[go], a[go], b[go], ra[go], rb[go]
                first = ra > rb  # the left token was made last
                limit = np.where(first, 2 * ra, 2 * rb + 1)
                a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token and token count of every prefix; codes: segments of one length, a row each."""
        n, m = codes.shape
        last = np.full((n, m + 1), -1, np.int32)
        count = np.zeros((n, m + 1), np.int32)
        with np.errstate(over="ignore"):
            cc = _char_code(codes)
            ph = np.zeros((n, m + 1), U)
            for j in range(m):
                ph[:, j + 1] = ph[:, j] * _B + cc[:, j]
            atoms, inverse = np.unique(codes, return_inverse=True)
            atom = np.array([self.single.get(int(c), self.unknown()) for c in atoms], np.int32)[inverse.reshape(n, m)]
            wide = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int32)
            for j in range(1, m + 1):
                left = np.arange(n)
                for size in range(min(j, self.max_len), 0, -1):
                    i = j - size
                    if size == 1:
                        ids = atom[left, i]
                        rows = left
                    else:
                        ids = self.find(ph[left, j] - ph[left, i] * _POW[size])
                        ids[(ids >= 0) & ~self.whole[ids]] = -1
                        hit = ids >= 0
                        rows, ids = left[hit], ids[hit]
                    if not len(rows):
                        continue
                    good = np.ones(len(rows), bool) if i == 0 else self.holds(last[rows, i], ids)
                    rows, ids = rows[good], ids[good]
                    last[rows, j] = ids
                    count[rows, j] = count[rows, i] + (np.where(ids < self.n_pieces, 1, wide[rows, i]) if size == 1 else 1)
                    left = left[last[left, j] < 0]
                    if not len(left):
                        break
                if len(left):
                    raise ValueError("a prefix without a valid last token")
        return last, count

    def advance_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same program for one long segment, with remembered border tests."""
        m = len(text)
        last, count = np.full((1, m + 1), -1, np.int32), np.zeros((1, m + 1), np.int32)
        by_text, seen = _by_text(self), {}
        ends, n_tok = [-1] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            for size in range(min(j, self.max_len), 0, -1):
                i = j - size
                t = by_text.get(text[i:j]) if size > 1 else self.single.get(ord(text[i]), self.unknown())
                if t is None:
                    continue
                if i:
                    pair = (ends[i], t)
                    if pair not in seen:
                        seen[pair] = bool(self.holds(np.array([pair[0]]), np.array([t]))[0])
                    if not seen[pair]:
                        continue
                ends[j] = t
                n_tok[j] = n_tok[i] + (1 if t < self.n_pieces else len(text[i].encode()))
                break
        last[0], count[0] = ends, n_tok
        return last, count

    def tokens(self, last: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows end to end and their number in each row, along the stored last tokens."""
        n, m = codes.shape
        at = np.full(n, m)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.arange(n)
        while len(rows):
            ids = last[rows, at[rows]]
            at[rows] -= self.lens[ids]
            taken.append((rows, at[rows].copy(), ids))
            rows = rows[at[rows] > 0]
        r, p, t = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.lexsort((p, r))
        r, p, t = r[order], p[order], t[order]
        odd = t >= self.n_pieces
        if odd.any():
            reps = np.ones(len(t), np.int64)
            raw = [chr(codes[a, b]).encode() for a, b in zip(r[odd], p[odd], strict=True)]
            reps[odd] = [len(x) for x in raw]
            t, r = np.repeat(t, reps), np.repeat(r, reps)
            t[t >= self.n_pieces] = np.frombuffer(b"".join(raw), np.uint8).astype(t.dtype) + self.byte0
        return t, np.bincount(r, minlength=n)


with np.errstate(over="ignore"):
    _POW = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(255, _B, U))))

_texts: dict[int, dict[str, int]] = {}


def _by_text(p: Pieces) -> dict[str, int]:
    if id(p) not in _texts:
        _texts.clear()
        _texts[id(p)] = {t.decode(): i for i, t in enumerate(p.texts) if p.whole[i] and p.lens[i] > 1}
    return _texts[id(p)]


def _merge(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    parts, pair = list(text), None
    while len(parts) > 1:
        best = min((rank[x], k) if (x := parts[k] + parts[k + 1]) in rank else (1 << 60, k) for k in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        k = best[1]
        pair = parts[k], parts[k + 1]
        parts[k : k + 2] = ["".join(pair)]
    return parts, pair


def _joined(texts: list[str]) -> np.ndarray:
    out = np.zeros((256, 256), bool)
    for t in texts:
        b = np.frombuffer(t.replace(SPACE, " ").encode(), np.uint8)
        out[b[:-1], b[1:]] = True
    return out


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """Read a sentencepiece model with merge-ordered pieces, byte fallback and no text normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    if (
        proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap
        or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces
    ):
        raise ValueError("only merge-ordered models with byte fallback, a leading space and no normalisation")
    normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
    order = {s: k for k, s in enumerate(sorted({-s for _, _, s in normal}))}
    rank = {t: order[-s] for _, t, s in normal}
    ids = {t: i for i, t, _ in normal}
    n = len(proto.pieces)
    chars = sorted({c for t in ids for c in t})
    extra = [c for c in chars if c not in ids]
    total = n + len(extra) + 1  # the last id: any character that is in no piece
    single = {ord(c): ids[c] for c in chars if c in ids} | {ord(c): n + k for k, c in enumerate(extra)}
    of = lambda t: single[ord(t)] if len(t) == 1 else ids[t]
    h, lens = np.zeros(total, U), np.ones(total, np.int64)
    rk, left, right = np.full(total, -1, np.int64), np.zeros(total, np.int32), np.zeros(total, np.int32)
    whole = np.zeros(total, bool)
    with np.errstate(over="ignore"):
        for t, i in [*ids.items(), *((c, single[ord(c)]) for c in extra)]:
            x = U(0)
            for c in _char_code(np.array([ord(c) for c in t])):
                x = x * _B + c
            h[i], lens[i] = x, len(t)
            if len(t) == 1:
                whole[i] = True
                continue
            rk[i] = rank[t]
            parts, pair = _merge(t, rank)
            if len(parts) == 1:
                whole[i] = True
                left[i], right[i] = of(pair[0]), of(pair[1])
        h[total - 1] = U(0x5851F42D4C957F2D)
    multi = np.array([i for t, i in ids.items() if len(t) > 1])
    by = np.argsort(h[multi])
    seen = np.zeros(1 << 20, bool)
    seen[h[multi] >> U(44)] = True
    byte0 = next(i for i, p in enumerate(proto.pieces) if p.type == 6)
    texts = [bytes([i - byte0]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for i, p in enumerate(proto.pieces)]
    keys, key_ids = h[multi][by], multi[by].astype(np.int32)
    longest = int(lens.max())
    return Pieces(keys, key_ids, h, lens, rk, left, right, whole, single, n, byte0, texts, longest, seen, _joined(list(ids)))


def segments(buf: np.ndarray, off: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with a space before every text that is not empty; starts, ends and texts of its segments."""
    n = np.diff(off)
    lead = n > 0
    new = np.concatenate(([0], np.cumsum(n + lead)))
    out = np.full(new[-1], 0x20, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.cumsum(lead), n)] = buf
    if not len(out):
        z = np.zeros(0, np.int64)
        return out, z, z, z
    space, ctl = out == 0x20, out < 0x20
    start = np.zeros(len(out), bool)
    start[new[:-1][lead]] = True
    cut = np.flatnonzero((space[1:] & ~space[:-1]) | ctl[1:] | ctl[:-1])
    start[cut[~joined[out[cut], out[cut + 1]]] + 1] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(out))
    return out, starts, ends, np.searchsorted(new, starts, "right") - 1


#: Distinct segments that a worker remembers before it starts afresh.
REMEMBERED = 600_000


class Table:
    """Counts at every prefix, and tokens, of the distinct segments seen so far, kept flat."""

    def __init__(self, p: Pieces):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.total = self.chars = self.bytes_ = self.c_at = self.t_at = np.zeros(0, np.int64)
        self.counts, self.tokens = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def look(self, h: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slot of each segment; segments not seen before are worked out first."""
        uniq, first, word = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(buf, s[first[new]], e[first[new]])
            fresh = np.arange(len(self.total) - len(new), len(self.total))
            self.keys = np.insert(self.keys, at[new], uniq[new])
            self.slots = np.insert(self.slots, at[new], fresh)
            at = np.searchsorted(self.keys, uniq)
        return self.slots[at][word]

    def _add(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        data = buf.tobytes()
        text = [data[x:y].replace(b" ", SPACE.encode()).decode() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        n = len(text)
        chars = np.array([len(x) for x in text], np.int64)
        per = np.zeros(n, np.int64)
        total = np.zeros(n, np.int64)
        c_at = np.concatenate(([0], np.cumsum(chars)))
        counts = np.zeros(c_at[-1], np.int32)
        toks, owners = [], []
        for size in np.unique(chars).tolist():
            group = np.flatnonzero(chars == size)
            for part in np.array_split(group, max(1, len(group) * size // 2_000_000)):
                codes = np.frombuffer("".join(text[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                if size > LONG:
                    done = [self.p.advance_long(text[k]) for k in part]
                    last, count = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
                else:
                    last, count = self.p.advance(codes)
                counts[c_at[part][:, None] + np.arange(size)] = count[:, 1:]
                total[part] = count[:, -1]
                tok, each = self.p.tokens(last, codes)
                per[part] = each
                toks.append(tok)
                owners.append(np.repeat(part, each))
        owner = np.concatenate(owners)
        flat = np.concatenate(toks)[np.argsort(owner, kind="stable")]
        self.c_at = np.concatenate((self.c_at, c_at[:-1] + len(self.counts)))
        self.t_at = np.concatenate((self.t_at, np.cumsum(per) - per + len(self.tokens)))
        self.counts = np.concatenate((self.counts, counts))
        self.tokens = np.concatenate((self.tokens, flat.astype(np.int32)))
        self.total = np.concatenate((self.total, total))
        self.chars = np.concatenate((self.chars, chars))
        self.bytes_ = np.concatenate((self.bytes_, e - s))


@dataclass
class Run:
    """The texts of rows ``a`` to ``b``: the slots of their segments end to end, and the first segment of each."""

    a: int
    b: int
    table: Table
    slot: np.ndarray
    bounds: np.ndarray

    def totals(self) -> np.ndarray:
        """Tokens of each text."""
        c = np.concatenate(([0], np.cumsum(self.table.total[self.slot])))
        return c[self.bounds[1:]] - c[self.bounds[:-1]]

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at prefixes of 1, 2, ... characters of each text end to end, and where each text begins.

        The leading space that the model adds is left out: an empty prefix has no tokens.
        """
        t, n = self.table, self.table.chars[self.slot]
        before = np.cumsum(t.total[self.slot]) - t.total[self.slot]
        base = np.concatenate((before, [0]))[np.minimum(self.bounds[:-1], len(before))]
        before = before - np.repeat(base, np.diff(self.bounds))
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(t.c_at[self.slot] - (end - n), n)
        out = t.counts[at] + np.repeat(before, n)
        begin = np.concatenate(([0], end))[self.bounds]
        keep = np.ones(len(out), bool)
        filled = begin[:-1] < begin[1:]
        keep[begin[:-1][filled]] = False
        return out[keep], begin - np.concatenate(([0], np.cumsum(filled)))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts end to end, and where each text begins."""
        t = self.table
        n = np.append(t.t_at[1:], len(t.tokens))[self.slot] - t.t_at[self.slot]
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(t.t_at[self.slot] - (end - n), n)
        return t.tokens[at], np.concatenate(([0], end))[self.bounds]


def runs(table: Table, column: pa.Array):
    """A :class:`Run` for each stretch of rows of a string column; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, SPACE, " ")
    for a, b, raw, off in slices(column, RUN_BYTES):
        buf, s, e, rows = segments(raw, off, table.p.joined)
        slot = table.look(word_hashes(buf, s, e), buf, s, e)
        yield Run(a, b, table, slot, np.searchsorted(rows, np.arange(b - a + 1)))


_tables: dict[int, Table] = {}


def table_for(model: bytes) -> Table:
    """The table of this worker process for a model."""
    p = load(model)
    if id(p) not in _tables:
        _tables.clear()
        _tables[id(p)] = Table(p)
    return _tables[id(p)]
