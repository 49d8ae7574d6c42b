"""Token counts from a prefix dynamic program, and encoding and decoding with the same vocabulary.

``prefix_counts`` gives the exact token count of every character prefix of every text: the program of
:mod:`plumbline.llm.pieces` stores, for each prefix, its last token and its count. Truncation ("how much of this text
fits into 4,096 tokens?") and budget questions are lookups in that array; nothing is encoded again.

``encode`` follows the stored last tokens back through each segment (batched numpy Viterbi: segments of equal length
advance together, substring hashes probe the sorted piece keys, and the one admissible piece is stored as back
pointer); ``decode`` looks the pieces up.

Defined results: a null text is an empty one with no tokens; null token lists decode to an empty text; ids may be null
or repeat, each row is handled by itself; other columns are ignored; an empty table gives an empty result. As the
library does, the sign for a visible space (U+2581) counts as a space, and decoding gives a space for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm import pieces
from plumbline.session import ship


def _model(df: DataFrame, path: str):
    """The model file's bytes, broadcast: one file of fixed size (0.5 MB), whatever the input."""
    spark = df.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.astype(np.int32)))


def prefix_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): counts[k] is the number of tokens of the first k + 1 characters."""
    model = _model(df, model_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.table_for(model.value)
        for batch in batches:
            for run in pieces.runs(table, batch.column(1)):
                ids = batch.column(0).slice(run.a, run.b - run.a)
                yield pa.RecordBatch.from_arrays([ids, _lists(*run.prefixes())], [id_col, "counts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, counts array<int>")


def token_counts(
    df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the longest prefix of at most ``limit`` tokens."""
    model = _model(df, model_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.table_for(model.value)
        for batch in batches:
            for run in pieces.runs(table, batch.column(1)):
                text = batch.column(1).slice(run.a, run.b - run.a)
                counts, begin = run.prefixes()
                n, fit = np.zeros(run.b - run.a, np.int64), np.zeros(run.b - run.a, np.int64)
                filled = np.flatnonzero(begin[1:] > begin[:-1])
                if len(filled):
                    n[filled] = counts[begin[1:][filled] - 1]
                    place = np.arange(len(counts)) - np.repeat(begin[:-1], np.diff(begin)) + 1
                    fit[filled] = np.maximum.reduceat(np.where(counts <= limit, place, 0), begin[:-1][filled])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(run.a, run.b - run.a),
                        pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                        pa.array(n), pa.array(n > limit), pa.array(fit),
                    ],
                    [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        kernel, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, text, ids): the token ids of every whole text; without the text, if it is not to be kept."""
    model = _model(df, model_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.table_for(model.value)
        for batch in batches:
            for run in pieces.runs(table, batch.column(1)):
                cut = [c.slice(run.a, run.b - run.a) for c in batch.columns[: 1 + keep_text]]
                yield pa.RecordBatch.from_arrays([*cut, _lists(*run.ids())], [id_col, *[text_col] * keep_text, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    text = f"`{text_col}` string, " if keep_text else ""
    return df.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, {text}ids array<int>")


class Decoder:
    """Texts of lists of token ids, by gathering the bytes of all pieces at once."""

    def __init__(self, table: list[bytes]):
        plain = [t.replace(pieces.SPACE.encode(), b" ") for t in table]
        self.size = np.array([len(t) for t in plain], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes_ = np.frombuffer(b"".join(plain), np.uint8)

    def texts(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """Bytes of each text, without the space that stands before the first piece."""
        n = self.size[ids]
        end = np.cumsum(n)
        out = self.bytes_[np.arange(end[-1] if len(end) else 0) + np.repeat(self.at[ids] - (end - n), n)].tobytes()
        cut = np.concatenate(([0], end))[begin].tolist()
        return [out[a + (out[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def _decoder(model: bytes) -> Decoder:
    return Decoder(pieces.load(model).texts)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, round_trip): encode and decode every whole text; the digest is of 32-bit ids."""
    model = _model(df, model_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decoder = pieces.table_for(model.value), _decoder(model.value)
        for batch in batches:
            for run in pieces.runs(table, batch.column(1)):
                ids, begin = run.ids()
                source = pc.replace_substring(pc.fill_null(batch.column(1).slice(run.a, run.b - run.a), ""), pieces.SPACE, " ").to_pylist()
                same = [x.encode() == y for x, y in zip(source, decoder.texts(ids, begin), strict=True)]
                raw = ids.astype("<i4").tobytes()
                marks = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(run.a, run.b - run.a), pa.array(np.diff(begin)), pa.array(marks, pa.string()), pa.array(same, pa.bool_())],
                    [id_col, "n_tokens", "ids_sha256", "round_trip"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, round_trip boolean")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of ``ids_col`` in ``out_col``."""
    model = _model(df, model_path)
    at = df.columns.index(ids_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model.value)
        for batch in batches:
            step = 500
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                lists = pc.fill_null(part.column(at), pa.scalar([], part.column(at).type))
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                raw = decoder.texts(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
                # bytes that are no UTF-8 become U+FFFD, as in the library
                text = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(kernel, StructType([*df.schema.fields, StructField(out_col, StringType())]))
