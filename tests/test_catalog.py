from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import apps, catalog, fragments, publish

CAT = "name string, revision bigint, spec string"
UPD = "name string, expect_revision bigint, spec string"
FRAG = "journal string, begin_offset bigint, end_offset bigint, mod_time bigint, store string, frag_sum binary"


def test_apply(spark):
    cat = spark.createDataFrame([("a", 5, "x"), ("b", 6, "y"), ("c", 7, "z")], CAT)
    ok = spark.createDataFrame([("a", 5, "x2"), ("b", -1, None), ("d", 0, "new")], UPD)
    assert sorted(map(tuple, catalog.apply_changes(cat, ok).collect())) == [("a", 8, "x2"), ("c", 7, "z"), ("d", 8, "new")]
    for bad in ([("a", 4, "x")], [("a", 0, "x")], [("d", 3, "x")], [("a", -1, "x"), ("a", -1, "y")], [("a", 4, None)]):
        with pytest.raises(Exception, match="conflict"):
            catalog.apply_changes(cat, spark.createDataFrame(bad, UPD)).collect()


def frag(spark, rows):
    return spark.createDataFrame([("j", b, e, m, s, None) for b, e, m, s in rows], FRAG)


def test_cover_set(spark):
    f = frag(spark, [(100, 200, 1, "s"), (200, 300, 1, "s"), (300, 400, 1, "s"), (400, 500, 1, "s"), (150, 500, 1, "s"), (7, 7, 1, "s")])
    assert sorted((r.begin_offset, r.end_offset, r.own_from) for r in fragments.cover_set(f).collect()) == [(100, 200, 100), (150, 500, 200)]


def test_cover_difference(spark):
    a = frag(spark, [(x, y, 1, "s") for x, y in [(99, 105), (100, 110), (110, 120), (130, 210), (150, 225), (151, 300), (152, 301), (300, 350), (301, 360), (360, 401), (400, 450)]])
    b = frag(spark, [(x, y, 1, "s") for x, y in [(100, 200), (150, 225), (225, 250), (250, 300), (301, 400)]])
    got = fragments.cover_difference(a, b)
    assert sorted((r.begin_offset, r.end_offset) for r in got.collect()) == [(99, 105), (152, 301), (300, 350), (360, 401), (400, 450)]


def test_query_jumps(spark):
    f = frag(spark, [(100, 200, 1000, "s"), (150, 250, 1000, "s"), (300, 400, 1000, "s"), (500, 600, 99_000, "s"), (600, 700, 0, None)])
    reqs = [(0, 0), (160, 0), (260, 0), (420, 0), (-1, 0), (650, 50_000), (160, 50_000)]
    r = spark.createDataFrame([("j", o, m) for o, m in reqs], "journal string, read_offset bigint, begin_mod_time bigint")
    got = {(x.read_offset, x.begin_offset, x.end_offset, x.jumped) for x in fragments.query(f, r.where("begin_mod_time = 0"), now=100_000).collect()}
    assert got == {(0, 100, 200, True), (160, 150, 250, False), (260, 300, 400, True), (420, None, None, False), (-1, None, None, False)}
    got = {(x.read_offset, x.begin_offset) for x in fragments.query(f, r.where("begin_mod_time > 0"), now=200_000).collect()}
    assert got == {(650, 600), (160, 500)}


def test_pages_and_pruning(spark):
    f = frag(spark, [(i * 10, i * 10 + 10, 100 + i * 20, "s") for i in range(6)] + [(60, 70, 0, None)])
    assert [r.begin_offset for r in fragments.page(f, 120, 180, limit=3).orderBy("begin_offset").collect()] == [10, 20, 30]
    assert [r.begin_offset for r in fragments.page(f, 120, 180, after=31, limit=3).collect()] == [40]
    assert [r.begin_offset for r in fragments.page(f, 0, 0, after=50).orderBy("begin_offset").collect()] == [50, 60]
    with pytest.raises(ValueError):
        fragments.page(f, limit=0)
    assert fragments.aged_out(f, 100, 220).count() == 2 and fragments.aged_out(f, 0, 10**9).count() == 0
    live = spark.createDataFrame([("j", 15, 25)], "journal string, first_offset bigint, last_offset bigint")
    assert sorted(r.begin_offset for r in fragments.prunable(f, live).collect()) == [0, 30, 40, 50]
    none = spark.createDataFrame([], "journal string")
    assert fragments.prunable(f, live, none).count() == 0


def test_publish(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "id int, key string")
    sent = publish.publish_transaction(df, "key", ["p/0", "p/1"], "01aabbccddee", 1600, ["id"])
    by = {}
    for r in sent.orderBy("journal", "id").collect():
        by.setdefault(r.journal, []).append(r.clock)
    assert all(c == [1600 + 160 * (i + 1) for i in range(len(c))] for c in by.values())
    acks = {r.journal: (r.clock, r.flags) for r in publish.ack_intents(sent, "01aabbccddee").collect()}
    assert acks == {j: (c[-1] + 160, 2) for j, c in by.items()}
    ok, bad = publish.reject_invalid(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), F.col("x") > 0)
    assert (ok.count(), bad.count()) == (1, 2)


def test_bike_cycle(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    ride = lambda bike, i, a, b: (bike, i, t(i * 2), t(i * 2 + 1), a, b)
    rows = [ride(1, 0, 9, 1), ride(1, 1, 1, 2), ride(1, 2, 2, 3), ride(1, 3, 3, 1)]  # 1 2 3 1
    rows += [ride(2, 0, 1, 2), ride(2, 1, 5, 3), ride(2, 2, 3, 1)]  # relocated
    rows += [ride(3, 0, 1, 1)]
    df = spark.createDataFrame(rows, "bike_id int, uuid int, start_time timestamp, end_time timestamp, start_id int, end_id int")
    got = {r.bike_id: [s.station for s in r.steps] for r in apps.bike_cycles(df, 20, 0).collect()}
    assert got == {1: [1, 2, 3, 1], 3: [1, 1]}
    assert [r.bike_id for r in apps.bike_cycles(df, 20, 2).collect()] == [1]


def test_stream_sums(spark):
    rows = [("a", 2, b" horse"), ("a", 1, b"battery"), ("a", 1, b"battery"), ("a", 3, b""), ("b", 1, b"x"), ("b", 3, None), ("c", 1, b"x"), (None, 1, b"x")]
    got = {r.id: (r.seq_no, r.value, r.state) for r in apps.stream_sums(spark.createDataFrame(rows, "id string, seq_no int, data binary")).collect()}
    assert got["a"] == (3, "ae763109c1192ed6", "complete")
    assert got["b"][2] == "out of order" and got["c"][2] == "incomplete" and len(got) == 3


def test_segments(spark):
    rows = [("l", 1, 1, 5, 10, 50), ("l", 1, 6, 8, 60, 90), ("l", 1, 3, 4, 20, 30), ("l", 1, 1, 2, 12, 0), ("l", 2, 9, 9, 95, 99), ("l", 1, 20, 22, 200, 0), ("l", None, 1, 1, 1, 1), ("l", 1, 9, 3, 1, 1)]
    df = spark.createDataFrame(rows, "log string, author bigint, first_seq_no bigint, last_seq_no bigint, first_offset bigint, last_offset bigint")
    assert sorted(map(tuple, apps.reduce_segments(df).select("log", "author", "first_seq_no", "last_seq_no", "first_offset", "last_offset").collect())) == [("l", 1, 1, 8, 12, 90), ("l", 1, 20, 22, 200, 0), ("l", 2, 9, 9, 95, 99)]
