"""Vectorised word scanning of Arrow string batches, shared by the operators on words and shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised pass takes; a longer single text comes alone, and the helpers here take it in blocks.
SLICE_BYTES = 256 << 10

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, enough for one block of bytes."""
    inv = U(pow(int(_P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(SLICE_BYTES + 1, _P, U), np.full(SLICE_BYTES + 1, inv, U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, off_buf, data = column.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: runs of bytes other than space and 0x09-0x0D, never across rows."""
    n = len(buf)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(0, n, SLICE_BYTES):
        end = min(o + SLICE_BYTES, n)
        # the block with a byte on either side; rows begin at the marked bytes
        wide = np.zeros(end - o + 2, bool)
        lo, hi = max(o - 1, 0), min(end + 1, n)
        wide[lo - o + 1 : hi - o + 1] = ~_SPACE[buf[lo:hi]]
        first = np.zeros(end - o + 1, bool)
        a, b = np.searchsorted(off, (o, end + 1))
        first[off[a:b] - o] = True
        inside = wide[1:-1]
        starts.append(np.flatnonzero(inside & (~wide[:-2] | first[:-1])) + o)
        ends.append(np.flatnonzero(inside & (~wide[2:] | first[1:])) + o + 1)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.searchsorted(off, s, "right") - 1


def count_before(flags: np.ndarray, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of a class (256 flags) stand before each place; places in rising order."""
    out, base = np.zeros(len(at), np.int64), 0
    for o in range(0, len(buf) + 1, SLICE_BYTES):
        a, b = np.searchsorted(at, (o, o + SLICE_BYTES))
        part = flags[buf[o : o + SLICE_BYTES]]
        if b > a:
            out[a:b] = base + np.concatenate(([0], np.cumsum(part)))[at[a:b] - o]
        base += int(np.count_nonzero(part))
    return out


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial with an invertible base."""
    up, down = powers()
    out = np.empty(len(starts), U)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            o = int(starts[k])
            # the words that end within a block from here (words come in order and do not overlap)
            end = int(np.searchsorted(ends, o + SLICE_BYTES, "right"))
            if end <= k:  # one word above a block: its sum block by block
                total, scale = U(0), U(1)
                for q in range(o, int(ends[k]), SLICE_BYTES):
                    part = buf[q : min(q + SLICE_BYTES, int(ends[k]))]
                    total += scale * (_BYTE[part] * up[: len(part)]).sum(dtype=U)
                    scale *= up[len(part)]
                out[k] = total
                k += 1
                continue
            s, e = starts[k:end] - o, ends[k:end] - o
            part = buf[o : o + int(e.max())]
            pre = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE[part] * up[: len(part)], out=pre[1:])
            out[k:end] = (pre[e] - pre[s]) * down[s]
            k = end
        out += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
        for q in range(0, len(out), SLICE_BYTES):
            out[q : q + SLICE_BYTES] = mix(out[q : q + SLICE_BYTES])
    return out


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; fewer words make one; no words, none."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    joint = np.zeros(len(h), U)
    with np.errstate(over="ignore"):
        for o in range(0, len(h), SLICE_BYTES):
            part = joint[o : o + SLICE_BYTES]
            for j in range(min(k, len(h) - o)):
                n = min(len(part), len(h) - o - j)
                part[:n] = part[:n] * U(0xC2B2AE3D27D4EB4F) + h[o + j : o + j + n]
            part[:] = mix(part)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(joint[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            x = U(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * U(0x9FB21C651E98DF25) + w
            s = mix(np.array([x], U))
        else:
            s = np.zeros(0, U)
        out.append(s)
    return out
