"""Every query of the core against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(f"{v:.9g}")
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert got
        return
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_dealt_queries_leave_the_subpackage_out():
    assert {f"p{i}_found" for i in range(1, 6)} <= set(registry.QUERIES)
    assert not [n for n in registry.QUERIES if n.startswith(("p6", "p7", "p8"))]


def test_walks_end_at_gaps_and_are_of_any_number(spark, tmp_path):
    """Gaps, repeats, lines from 0 or 2 on, nulls; and more lines than Spark's recursion may give (1,000,000)."""
    odd = [(1, 1, 5), (1, 2, 9), (1, 4, 99), (2, 2, 5), (3, 0, 7), (3, 1, 2), (3, 1, 3), (3, 2, None), (3, 2, 1), (3, 3, 1), (None, 1, 4), (None, 1, 6), (None, 2, 8), (4, 1, None), (5, None, 3), (5, 1, 1)]
    many = spark.range(1_000_100).selectExpr("id div 2 + 100 as l_orderkey", "cast(id % 2 + 1 as int) as l_linenumber", "id as l_partkey")
    spark.createDataFrame(odd, "l_orderkey bigint, l_linenumber int, l_partkey bigint").unionByName(many).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["recursive_walk"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(registry.SQL["recursive_walk"]).fetchall()))
