"""One very long text through the kernels: memory stays within a small multiple of the text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import lines, minhash, mixing, resample
from plumbline.llm._words import slices

#: Bytes of the text; and of memory beside it, for each byte, that a kernel may take (a 50 MB text: about 1 GB).
SIZE, TIMES = 50 << 20, 20


@pytest.fixture(scope="module")
def column():
    r = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in r.integers(0, 10**6, 20_000)])
    part = " ".join(words[r.integers(0, len(words), 400_000)])
    part = "\n".join(part[k : k + 400] for k in range(0, len(part), 400))
    text = (part * (SIZE // len(part) + 1))[:SIZE]
    return pa.array([text + "x" * 1_000_000, "a short text", None], pa.large_string())


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def sets(column):
    for _, _, s in minhash._text_sets(column, 2):
        minhash.signatures(s, 240)


def counts(column):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), column], ["doc_id", "text"])
    resample._weights(batch, 0, 1, np.ones(resample.BUCKETS))


def marks(column):
    for _, _, buf, off in slices(column):
        lines.verdicts(lines.Scan(buf, off), (np.zeros((lines.FIRST[-1], 2)), np.zeros((2, 2))))


@pytest.mark.parametrize("work", [sets, counts, mixing.topics, marks])
def test_memory_beside_a_long_text(column, work):
    used = peak(lambda: work(column))
    print(work.__name__, round(used / 2**20), "MB")
    assert used < TIMES * SIZE
