from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidemark.operators import compaction
from tidemark.session import work_path

SCHEMA = "file_id string, journal string, begin_offset bigint, content binary, frag_sum binary, bin string"


def file(i, journal, begin, content, damaged=False):
    return (str(i), journal, begin, content, b"\0" * 20 if damaged else hashlib.sha1(content or b"").digest(), "x")


def run(spark, rows, **kw):
    got = compaction.consolidate(spark.createDataFrame(rows, SCHEMA), work_path(spark, "out"), **kw)
    return sorted((r[0], r[1], bytes(r[2])) for r in got.collect())


def test_overlaps_repeats_damage_and_equal_records(spark):
    rows = [
        file(1, "a", 0, b"one\ntwo\n"),
        file(2, "a", 0, b"one\ntwo\n"),
        file(3, "a", 4, b"two\none\n"),
        file(4, "a", 100, b"x\n\ny"),
        file(5, "a", 50, b"lost\n", damaged=True),
        file(6, "a", 60, b""),
        file(7, "b", 2**60, "ü\r\n\v\f\n".encode()),
        (None, "a", 200, b"z\n", hashlib.sha1(b"z\n").digest(), "x"),
        ("9", None, 200, b"z\n", hashlib.sha1(b"z\n").digest(), "x"),
        ("10", "a", None, b"z\n", hashlib.sha1(b"z\n").digest(), "x"),
        ("11", "a", 200, None, None, "x"),
    ]
    assert run(spark, rows) == [("a", 0, b"one\n"), ("a", 4, b"two\n"), ("a", 8, b"one\n"), ("a", 100, b"x\n"), ("a", 102, b"\n"), ("a", 103, b"y"), ("b", 2**60, "ü\r\n".encode()), ("b", 2**60 + 4, b"\v\f\n")]


def test_records_that_files_disagree_on_are_not_lost(spark):
    rows = [file(1, "a", 0, b"aaaa\nbbbb\n"), file(2, "a", 5, b"b\nc\nd\n" + b"e" * 20 + b"\n")]
    got = {(b, r) for _, b, r in run(spark, rows)}
    assert {(0, b"aaaa\n"), (5, b"bbbb\n"), (7, b"c\n"), (9, b"d\n"), (11, b"e" * 20 + b"\n")} == got


def test_bins_are_bounded_and_files_few(spark):
    rows, at = [], 0
    for i in range(60):
        c = b"r%d\n" % i * 5
        rows.append(file(i, "a", at, c))
        at += len(c)
    out = work_path(spark, "out")
    got = compaction.consolidate(spark.createDataFrame(rows, SCHEMA), out, target_bytes=200, group_files=20)
    assert got.count() == 300
    assert 6 <= len({r[0] for r in spark.read.parquet(out).select("store_key").collect()}) <= 16


def test_empty(spark):
    assert run(spark, []) == []


def test_nothing_is_published_if_sums_differ(spark, monkeypatch):
    real = compaction._sums
    calls = []

    def wrong(df):
        calls.append(1)
        out = real(df)
        return out.withColumn("records", out.records + len(calls))

    monkeypatch.setattr(compaction, "_sums", wrong)
    with pytest.raises(ValueError, match="nothing was published"):
        run(spark, [file(1, "a", 0, b"x\n")])


def test_first_fit_decreasing():
    sizes = np.array([5, 7, 5, 2, 4, 2, 5, 1, 6, 30])
    bins = compaction.first_fit_decreasing(sizes, 10)
    used = {b: int(sizes[bins == b].sum()) for b in set(bins)}
    assert all(v <= 10 or v == 30 for v in used.values())
    assert len(used) == 5  # 37 in four bins of ten, and the large one
