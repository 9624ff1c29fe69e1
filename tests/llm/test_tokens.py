from __future__ import annotations

import os

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no vocabulary files here")

TEXTS = [
    "",
    None,
    " ",
    "\n\n\r\n \t",
    "plain text, isn't it?  Two  spaces\n\n\nlines",
    "<|endoftext|> is ordinary",
    "x" * 3000,
    " " * 3000 + "y",
    "naïve Straße 数据データ 👨‍👩‍👧 ‮﻿\x00",
    "word " * 1500,
    ("a\n\n" * 40 + "b  \n") * 20,
    "12345678901234567890" * 50,
]


def want(text):
    return tokens._encoding(tokens.RANKS, tokens.PATTERN)[0].encode_ordinary(text or "")


@pytest.mark.parametrize(("chunk", "overlap"), [(8192, 512), (100, 20), (64, 8), (10, 3)])
def test_chunks_give_the_ids_of_the_whole(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "id bigint, text string, ids int")
    got = {r.id: list(r.ids) for r in tokens.encode_corpus(df, "id", "text", chunk_chars=chunk, overlap=overlap).collect()}
    assert got == {i: want(t) for i, t in enumerate(TEXTS)}


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "long text " * 30), (1, "long text " * 30), (None, "b"), (None, None)], "id bigint, text string")
    got = sorted((r.id or 0, len(r.ids)) for r in tokens.encode_corpus(df, "id", "text", chunk_chars=50, overlap=20).collect())
    n = len(want("long text " * 30))
    assert got == [(0, 0), (0, 1), (1, n), (1, n)]


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    back = {r.id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df, "id", "text", chunk_chars=200, overlap=30), "id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1'\n\ts!é漢"), max_size=120), st.integers(5, 30), st.integers(2, 12))
def test_seams_are_true_boundaries(text, chunk, overlap):
    """What the two neighbours of a seam agree on is a boundary of the whole text's pre-tokens."""
    true = {m.end() for m in regex.finditer(tokens.PATTERN, text)}
    starts = range(0, len(text), chunk)
    pieces = [text[s : s + chunk + overlap] for s in starts]
    if not pieces:
        return
    table = pa.RecordBatch.from_arrays([pa.array([1] * len(pieces)), pa.array([0] * len(pieces)), pa.array(range(len(pieces))), pa.array([i == len(pieces) - 1 for i in range(len(pieces))]), pa.array(pieces)], names=["doc", "row", "chunk_no", "last", "piece"])
    out = next(iter(tokens._boundaries(chunk, overlap, tokens.PATTERN)([table])))
    heads, tails = out.column(5).to_pylist(), out.column(6).to_pylist()
    prefix_true = True
    for i in range(len(pieces) - 1):
        common = sorted(set(tails[i]) & set(heads[i + 1]))
        if not common:
            prefix_true = False  # this text would be encoded whole
        elif prefix_true:
            assert starts[i + 1] + common[0] in true
