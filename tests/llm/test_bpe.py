import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tests.llm.helpers import ODD_TEXTS, SCHEMA, frame, odd_rows, tables
from tidemark.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
HARD = ["a" * 3000, "abc" * 700, " " * 900 + "x", "\n\n\n \t  ", "é" * 800, "<|endoftext|>", "don't I'LL we've", "0123456789" * 120, "﻿​ 　z"]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, P.PATTERN)


def test_ids_are_those_of_the_library(plain, encoder):
    (documents,) = tables("0.001", "documents")
    texts = [r[1] for r in documents] + HARD + [t or "" for t in ODD_TEXTS]
    assert [x.tolist() for x in encoder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_matrix_and_list_merges_agree(encoder):
    rng = np.random.default_rng(2)
    for n in (2, 3, 17, 200, 512):
        raw = [bytes(rng.integers(97, 104, n, dtype=np.uint8)) for _ in range(20)]
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.merge_rows(raw)] == [encoder._merge_long(r) for r in raw]


def test_forgetting_changes_nothing(monkeypatch, plain):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(RANKS, P.PATTERN)
    for text in ("one two three four", "five six one two", "seven"):
        assert small.encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_round_trip_and_odd_rows(spark, plain):
    rows = odd_rows()
    decoded = bpe.decode(bpe.encode(frame(spark, rows), RANKS, P.PATTERN), RANKS)
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(decoded).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = plain.encode_ordinary(r[1] or "")
        want.append((repr(r[0]), len(ids), digest(" ".join(map(str, ids)).encode()), digest((r[1] or "").encode())))
    assert got == sorted(want)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().decoded == b""


def test_lists_are_joined_without_python_objects():
    """Empty and null lists, slices and ids outside the vocabulary."""
    import pyarrow as pa

    vocabulary = pa.array([b"a", b"bc", None, b""], pa.binary())
    ids = pa.array([[9], [1, 0, 3, 1], None, [], [0]], pa.list_(pa.int32()))
    assert bpe._joined(ids.slice(1), vocabulary).to_pylist() == [b"bcabc", b"", b"", b"a"]
    for bad in (2, 9):
        with pytest.raises((ValueError, IndexError)):
            bpe._joined(pa.array([[0, bad]], pa.list_(pa.int32())), vocabulary)
