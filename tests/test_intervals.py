from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidemark.operators.intervals import coverage, quantile_shards, ranks, running_max_before

SCHEMA = "journal string, b bigint, e bigint, s bigint"


def brute(rows):
    out, by = [], defaultdict(list)
    for j, b, e, _ in rows:
        if j is not None and b is not None and e is not None and e > b:
            by[j].append((b, e))
    for j, xs in by.items():
        spans = []
        for b, e in sorted(xs):
            if spans and b <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([b, e])
        out += [(j, "span", b, e) for b, e in spans]
        out += [(j, "gap", x[1], y[0]) for x, y in zip(spans, spans[1:])]
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in coverage(spark.createDataFrame(rows, SCHEMA), "journal", "b", "e", **kw).collect())


@pytest.mark.parametrize("per_shard", [1, 3, 20_000])
def test_against_brute_force(spark, per_shard):
    rnd = random.Random(per_shard)
    rows = []
    for j in ("a", "b", "huge"):
        for _ in range(120 if j == "huge" else 25):
            b = rnd.randrange(0, 2000) * rnd.choice((1, 1, 10))
            rows.append((j, b, b + rnd.choice((0, 1, 5, 16, 64, 700)), 1))
    assert run(spark, rows, rows_per_shard=per_shard) == brute(rows)


def test_long_interval_over_many_shards(spark):
    rows = [("a", i * 10, i * 10 + 3, 1) for i in range(100)] + [("a", 155, 801, 1)]
    assert run(spark, rows, rows_per_shard=2) == brute(rows)


def test_shards_hold_like_numbers_of_rows_wherever_offsets_lie(spark):
    """One far jump, and offsets that crowd: no shard holds more than twice its share."""
    rows = [("a", i, i + 1, 1) for i in range(4000)] + [("a", 2**60, 2**60 + 5, 1)] + [("a", 10**9 + (i * i) % 7919 * 1000, 10**9 + (i * i) % 7919 * 1000 + 7, 1) for i in range(3999)] + [("small", 5, 6, 1)]
    got = quantile_shards(spark.createDataFrame(rows, SCHEMA), "journal", "b", per_shard=400, name="shard").where("journal = 'a'")
    counts = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert len(counts) == 20 and max(counts.values()) <= 2 * 400
    last, upto = {}, []
    for r in got.collect():
        lo, hi = last.get(r.shard, (r.b, r.b))
        last[r.shard] = (min(lo, r.b), max(hi, r.b))
    upto = [last[k] for k in sorted(last)]
    assert all(x[1] < y[0] for x, y in zip(upto, upto[1:]))
    assert run(spark, rows, rows_per_shard=400) == brute(rows)


def test_extremes_nulls_and_repeats(spark):
    big = 2**63 - 1
    rows = [("a", 0, big, 1), ("a", 0, big, 1), ("a", -(2**63), -5, 1), ("a", None, 5, 1), ("a", 5, None, 1), ("a", 9, 3, 1), ("a", 3, 3, 1), (None, 1, 2, 1), ("b", 2**53 + 1, 2**53 + 3, 1), ("b", 2**53 + 3, 2**53 + 4, 1)]
    assert run(spark, rows, rows_per_shard=1) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_running_max(spark):
    rows = [("a", i, i + (i * 7) % 31, 1) for i in range(60)]
    df = running_max_before(spark.createDataFrame(rows, SCHEMA), "journal", "b", "e", "m", __import__("pyspark.sql.functions", fromlist=["x"]).expr("shiftright(b, 3)"))
    top, want = None, []
    for _, b, e, _ in sorted(rows, key=lambda r: (r[1], -r[2])):
        want.append((b, top))
        top = e if top is None else max(top, e)
    assert sorted((r["b"], r["m"]) for r in df.collect()) == want


def test_ranks_of_a_hot_group(spark):
    rows = [(j, b, 0, 0) for j, n in (("hot", 3000), ("b", 5), (None, 7)) for b in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert all(r.n == r.b + 1 for r in ranks(df, ["journal"], ["b"], "n").collect())
    assert sorted(r.n for r in ranks(df, [], ["journal", "b"], "n").collect()) == list(range(1, len(rows) + 1))
    assert ranks(df.limit(0), ["journal"], ["b"], "n").count() == 0
