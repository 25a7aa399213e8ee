"""SentencePiece ids by distinct chunks against the library itself."""

from __future__ import annotations

import hashlib
import random

import pytest

from souk.llm import pieces
from souk.llm.tokens import vocabulary_file


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    parts = [*"ab  ▁▁\n\t.,éß　\xa0\x00\x1c\U0001f600​﻿漢字́ ", "the", "ing", "<s>", "</s>", "<0x0A>", "<unk>", "   "]
    odd = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    odd += [(None, "null id"), (None, None), (9001, None), (9002, ""), (9003, " "), (9004, "▁"), (9005, " " * 3000), (9006, "x" * 50_000)]
    odd += [(-5, "a negative id"), (9007, "long " * 100_000), (9008, "again"), (9008, "again"), (9008, "another of that id")]
    return odd


def test_ids_and_text(spark, rows, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_DISTINCT", 500)  # several blocks a task
    docs = spark.createDataFrame([(i, t, "c", 1, "i") for i, t in rows], "doc_id long, text string, block string, no int, ids string")

    def key(x):
        return x[0] is not None, x[0] or 0, *x[1:]

    want = sorted(((i, len(ids := library.encode(t or "")), ids, library.decode(ids)) for i, t in rows), key=key)
    got = pieces.encode(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got.collect()), key=key) == want
    digests = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode(docs, digests=True).collect()), key=key)
    assert digests == sorted(((i, n, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, n, ids, t in want), key=key)
    assert pieces.encode(docs.limit(0)).collect() == []


def test_a_model_that_does_not_fit(library, monkeypatch):
    own = pieces.Segmenter(vocabulary_file("piece_bpe_32k.model"))
    assert own.by_chunk and own.chunks("a  b ▁c ") == [" a", "  b", "  c", " "]
    own.by_chunk = False
    for text in ("a  b", "", " ", "x "):
        assert [i for ids in own.segment(own.chunks(text)) for i in ids] == library.encode(text)
