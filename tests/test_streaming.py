from __future__ import annotations

import random

import pytest

from tidemark.operators.sequencer import committed
from tidemark.streaming import consumer

SCHEMA = "journal string, producer string, begin_offset bigint, clock bigint, flags int, payload string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", consumer.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_sequencer_over_restarts_equals_batch(spark, tmp_path, rocksdb):
    rnd = random.Random(2)
    ms = [("j", rnd.choice("AB"), i * 10, rnd.randrange(1, 20) + i // 3, rnd.choice((0, 1, 1, 1, 2)), str(i)) for i in range(90)]
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for k in range(3):
        spark.createDataFrame(ms[k * 30 : k * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = consumer.committed_stream(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    cols = ["producer", "begin_offset", "commit_begin"]
    want = committed(spark.createDataFrame(ms, SCHEMA)).select(*cols)
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_batch_commits_once_and_fence_holds(spark, tmp_path):
    t = consumer.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "seq")
    first = t.take_over()
    row = lambda *r: spark.createDataFrame(list(r), "k string, seq bigint, v string")
    assert t.live() is None
    assert t.commit(first, "q", 0, row(("a", 1, "x"), ("b", 1, "y")))
    assert not t.commit(first, "q", 0, row(("a", 9, "again")))
    assert t.commit(first, "q", 1, row(("a", 3, "z"), ("b", 2, "gone")), "v = 'gone'")
    assert t.commit(first, "q", 2, row(("b", 1, "late")))  # a late change does not bring it back
    assert [tuple(r) for r in t.live().select("k", "seq", "v").collect()] == [("a", 3, "z")]
    second = t.take_over()
    with pytest.raises(consumer.FencedError):
        t.commit(first, "q", 3, row(("a", 4, "zombie")))
    assert t.commit(second, "q", 3, row(("a", 5, "new")))


def test_failed_batch_is_repeated_without_effect_twice(spark, tmp_path):
    src, check = str(tmp_path / "src"), str(tmp_path / "check")
    spark.range(10).selectExpr("id % 3 as k", "id as seq").coalesce(1).write.parquet(src)
    t = consumer.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "seq")
    owner = t.take_over()
    broken = [True]

    def txn(rows, batch):
        t.commit(owner, "q", batch, rows)
        if broken[0]:
            broken[0] = False
            raise RuntimeError("after the commit")

    stream = spark.readStream.schema("k bigint, seq bigint").parquet(src)
    with pytest.raises(Exception, match="after the commit"):
        consumer.run_consumer(stream, "q1", check, txn).awaitTermination()
    version = t._head()
    q = consumer.run_consumer(stream, "q1", check, txn)
    q.awaitTermination()
    assert t._head() == version
    assert sorted(map(tuple, t.live().collect())) == [(0, 9), (1, 7), (2, 8)]
    assert consumer.progress(q)["last_batch"] >= 0


def test_only_touched_buckets_are_rewritten_and_old_ones_deleted(spark, tmp_path):
    t = consumer.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "seq", buckets=8)
    owner = t.take_over()
    row = lambda *r: spark.createDataFrame(list(r), "k bigint, seq bigint")
    t.commit(owner, "q", 0, row(*[(k, 1) for k in range(40)]))
    before = t._head()[1]["folders"]
    t.commit(owner, "q", 1, row((3, 2)))
    after = t._head()[1]["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    t.commit(owner, "q", 2, row((3, 3), (77, 1)))
    kept = set(t._head()[1]["folders"].values()) | set(t._head()[1]["stale"])
    have = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").glob("v*/_bucket=*")}
    assert have == kept
    assert sorted(map(tuple, t.live().select("k", "seq").collect())) == sorted([(k, 3 if k == 3 else 1) for k in range(40)] + [(77, 1)])


def test_a_writer_fenced_off_during_its_commit_publishes_nothing(spark, tmp_path, monkeypatch):
    t = consumer.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "seq")
    first = t.take_over()
    rows = spark.createDataFrame([("a", 1)], "k string, seq bigint")
    real = t._heads.replace

    def late(seen, text):
        monkeypatch.setattr(t._heads, "replace", real)
        t.take_over()
        return real(seen, text)

    monkeypatch.setattr(t._heads, "replace", late)
    with pytest.raises(consumer.FencedError):
        t.commit(first, "q", 0, rows)
    assert t.live() is None and not list((tmp_path / "t").glob("v*"))


def test_hooks_and_deferred_rows(spark, tmp_path):
    """Odd rows are put off once; a failed transaction is told to the hook and sees the same rows again."""
    src, check = str(tmp_path / "src"), str(tmp_path / "check")
    schema = spark.createDataFrame([], "id bigint, tries int").schema
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema("id bigint, tries int").parquet(src)
    calls, done, fail = [], [], [True]

    def txn(rows, batch):
        have = sorted(tuple(r) for r in rows.collect())
        if fail[0] and batch == 1:
            fail[0] = False
            raise RuntimeError("once")
        done.append([i for i, tries in have if i % 2 == 0 or tries])
        later = [(i, tries + 1) for i, tries in have if i % 2 and not tries]
        return spark.createDataFrame(later, schema)

    def go():
        q = consumer.run_consumer(stream, "d", check, consumer.with_deferred(f"file://{tmp_path}/later", schema, txn), begin=lambda b: calls.append(("begin", b)), finished=lambda b, e: calls.append(("end", b, e is None)))
        q.awaitTermination()

    for k in range(3):
        spark.range(k * 4, k * 4 + 4).selectExpr("id", "0 as tries").coalesce(1).write.mode("append").parquet(src)
        if k == 1:
            with pytest.raises(Exception, match="once"):
                go()
        go()
    assert done == [[0, 2], [1, 3, 4, 6], [5, 7, 8, 10]]
    assert calls == [("begin", 0), ("end", 0, True), ("begin", 1), ("end", 1, False), ("begin", 1), ("end", 1, True), ("begin", 2), ("end", 2, True)]


def test_json_store(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    a = consumer.JsonStore(spark, path)
    assert a.state is None
    a.commit({"n": 1}, {"j": 10})
    b = consumer.JsonStore(spark, path)
    assert (b.state, b.checkpoint) == ({"n": 1}, {"j": 10})
    with pytest.raises(consumer.FencedError):
        a.commit({"n": 2}, {"j": 20})
    b.commit({"n": 3}, {"j": 30})
    assert consumer.JsonStore(spark, path).state == {"n": 3}


def test_counters(spark):
    from pyspark.sql import functions as F

    df, seen = consumer.counted(spark.range(100), "c", rows=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "odd": 50}
