from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import uuids
from tidemark.functions.labels import LABELS
from tidemark.sources import journal
from tidemark.sources.messages import Registers, read_committed, read_uncommitted, register_type, select_journals


def written(spark, root, messages):
    """messages: journal, producer, clock, flags, body"""
    journal.register(spark)
    df = spark.createDataFrame(messages, "journal string, p string, c bigint, f int, body string").withColumn("uuid", uuids.build(F.col("p"), F.col("c"), F.col("f")))
    df.coalesce(1).select("journal", F.to_json(F.struct("uuid", "body", F.lit("ignored").alias("other"))).cast("binary").alias("payload")).write.format("journal").option("path", root).mode("append").save()


A, B = "0" * 11 + "1", "0" * 11 + "2"
MESSAGES = [("t/1", A, 10, 1, "a1"), ("t/1", B, 10, 1, "b1"), ("t/1", A, 20, 1, "a2"), ("t/1", B, 20, 1, "b2"), ("t/1", B, 30, 2, None), ("t/2", A, 40, 0, "o"), ("t/2", A, 40, 0, "o")]


def test_isolation_levels(spark, tmp_path):
    root = str(tmp_path)
    written(spark, root, MESSAGES)
    register_type("test.Message", "uuid string, body string")
    assert read_uncommitted(spark, root, "test.Message").count() == 7
    got = read_committed(spark, root, "uuid string, body string").orderBy("journal", "commit_begin", "begin_offset").collect()
    assert [r.body for r in got] == ["b1", "b2", None, "o"]
    assert read_committed(spark, root, "test.Message", drop_acks=True, journals=["t/1"]).count() == 2
    first = got[1].begin_offset
    assert [r.body for r in read_committed(spark, root, "test.Message", drop_acks=True, journals=["t/1"], min_offsets={"t/1": first}).collect()] == ["b2"]


def test_select_journals(spark):
    rows = [("a/1", [("env", "prod")], "NONE", 0), ("a/2", [("env", "prod")], "FULL", 0), ("a/3", [("env", "dev")], None, 4), ("a/4", [("env", "prod")], "PARTIAL", 2), ("b/1", [("env", "prod")], None, None)]
    specs = spark.createDataFrame(rows, f"name string, labels {LABELS}, suspend string, flags int")
    assert select_journals(specs, "env=prod") == ["a/1", "b/1"]
    assert select_journals(specs, "prefix:prefix=a/, env in (dev, prod)") == ["a/1", "a/3"]


def test_registers(spark, tmp_path):
    r = Registers(spark, f"file://{tmp_path}/registers")
    assert r.append("author=x", union={"author": "me"})  # empty registers match anything
    assert not r.append("author=you", union={"author": "you"})
    assert r.append("author=me", subtract=["author"], union={"author": "you", "term": "2"})
    assert r.read() == {"author": "you", "term": "2"} and json.dumps(r.read())
