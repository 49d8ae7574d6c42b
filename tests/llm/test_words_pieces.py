"""Tokens against the library, at every prefix; decoding; edge rows."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from plumbline.llm import pieces, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "   ", "a    b", "\n\n x", " " * 37, "a" + " " * 21 + "b", "日本語のテキスト梦", "naïve café", "\x00\x01", "😀😀 hi", "x" * 1500, "<s> </s>"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def table():
    with open(MODEL, "rb") as f:
        return pieces.table_for(f.read())


def texts():
    r = random.Random(5)
    return ODD + ["".join(r.choice(" aeinrst lóé\n.,019") for _ in range(r.randint(0, 50))) for _ in range(400)]


def test_ids_and_totals_are_the_librarys(lib, table):
    t = texts()
    got = []
    for run in pieces.runs(table, pa.array(t)):
        ids, o = run.ids()
        got += [ids[o[k] : o[k + 1]].tolist() for k in range(run.b - run.a)]
        assert run.totals().tolist() == [len(x) for x in got[run.a : run.b]]
    assert got == lib.encode(t)


def test_every_prefix(lib, table):
    for t in texts()[:120]:
        if len(t) > 200:
            continue
        for run in pieces.runs(table, pa.array([t])):
            assert run.prefixes()[0].tolist() == [len(lib.encode(t[:k])) for k in range(1, len(t) + 1)]


def test_operators(spark, lib):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, None, "x"), (3, "a", "y"), (3, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tokens.token_counts(df, MODEL, limit=5).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((r[0] or -1, len(lib.encode(r[1] or ""))) for r in rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < len(ODD) and not r.doc_id == 3:
            t = ODD[r.doc_id]
            assert r.fit_chars == max(k for k in range(len(t) + 1) if len(lib.encode(t[:k])) <= 5 or k == 0)
    coded = tokens.decode(tokens.encode(df, MODEL), MODEL).collect()
    assert all(r.decoded == (r.text or "") for r in coded)
    counts = tokens.prefix_counts(df.where("doc_id = 4"), MODEL).first().counts
    assert counts == [len(lib.encode("a    b"[:k])) for k in range(1, 7)]
    none = df.where("false")
    assert tokens.token_counts(none, MODEL).count() == tokens.encode(none, MODEL).count() == 0


def test_control_characters_inside_pieces(lib, table):
    r = random.Random(11)
    held = [p for k in range(lib.get_piece_size()) if len(p := lib.id_to_piece(k)) > 1 and any(c < " " for c in p)]
    assert any("\r" in p for p in held)
    t = ["foo();\r\nbar", "\r\r\r\n {\r\n}\r", "\r" * 700, *(f"a{p}\nb" for p in held)]
    t += ["".join(r.choice([*"ab ;(){.,\r\r\n\t\x00é", "();\r\n", *held]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    t = [x.replace(pieces.SPACE, " ") for x in t]
    got = []
    for run in pieces.runs(table, pa.array(t)):
        ids, o = run.ids()
        got += [ids[o[k] : o[k + 1]].tolist() for k in range(run.b - run.a)]
    assert got == lib.encode(t)
    for x in t[:60]:
        if len(x) > 200:
            continue
        for run in pieces.runs(table, pa.array([x])):
            assert run.prefixes()[0].tolist() == [len(lib.encode(x[:k])) for k in range(1, len(x) + 1)]
