from __future__ import annotations

import pytest

from tidemark.operators.dedup import deduplicate, surplus_copies

SCHEMA = "id bigint, log string, author bigint, seq_no bigint, first_offset bigint, kept string"
ROWS = [
    (1, "a", 1, 1, 50, "x"),
    (2, "a", 1, 1, 40, "x"),  # smallest offset stays
    (3, "a", 1, 1, 40, "y"),  # tie: the larger id goes
    (4, "a", 2, 1, None, "x"),
    (5, "a", 2, 1, 9, "x"),  # a null offset comes last
    (6, "a", None, 1, 1, "x"),  # identifies nothing
    (7, "a", None, 1, 1, "x"),
    (8, None, 1, 1, 1, "x"),
    (9, "b", 3, 3, None, "x"),
    (10, "b", 3, 3, None, "x"),
    (11, "c", 1, 1, -5, "x"),
    (12, "c", 1, 1, 2**62, "x"),
]


@pytest.mark.parametrize("packed", [True, False])
def test_surplus(spark, packed):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = surplus_copies(df, ["log", "author", "seq_no"], "first_offset", "id", packed)
    assert sorted(r[0] for r in got.collect()) == [1, 3, 4, 10, 12]


def test_rows_and_extra_columns_stay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = deduplicate(df, ["log", "author", "seq_no"], "first_offset", "id")
    assert got.columns == df.columns
    assert sorted(r[0] for r in got.collect()) == [2, 5, 6, 7, 8, 9, 11]


def test_negative_ids_need_the_unpacked_order(spark):
    df = spark.createDataFrame([(-1, "a", 1, 1, 5, ""), (2, "a", 1, 1, 5, "")], SCHEMA)
    with pytest.raises(Exception, match="packed=False"):
        surplus_copies(df, ["log", "author", "seq_no"], "first_offset", "id").collect()
    assert [r[0] for r in surplus_copies(df, ["log", "author", "seq_no"], "first_offset", "id", packed=False).collect()] == [2]


@pytest.mark.parametrize("packed", [True, False])
def test_null_offset_comes_after_the_largest(spark, packed):
    df = spark.createDataFrame([(1, "a", 1, 1, None, ""), (2, "a", 1, 1, 2**63 - 1, "")], SCHEMA)
    assert [r[0] for r in surplus_copies(df, ["log", "author", "seq_no"], "first_offset", "id", packed).collect()] == [1]


def test_empty(spark):
    assert surplus_copies(spark.createDataFrame([], SCHEMA), ["log", "author", "seq_no"], "first_offset", "id").count() == 0


def test_aggregates_by_hash_on_the_map_side(spark):
    plan = surplus_copies(spark.createDataFrame(ROWS, SCHEMA), ["log", "author", "seq_no"], "first_offset", "id")._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan
