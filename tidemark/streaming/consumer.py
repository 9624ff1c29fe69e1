"""Stateful, exactly-once consumption of message streams on Structured Streaming.

A micro-batch is a transaction: its rows, the state they change and what they publish commit
together under the batch id. A batch that runs again after a failure finds its id recorded and
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.sequencer import Automaton
from tidemark.session import Versions, exists, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FencedError(Exception):
    """Another writer has taken the table over."""


class SequencerProcessor(StatefulProcessor):
    """Read-committed sequencing of one (journal, producer): the automaton's numbers, and the pending messages.

    Messages of a batch are taken in offset order. States that lag their journal's clock may be
    dropped with prune_states() between runs; there is no timer, as clocks are event time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "low bigint, high bigint, open boolean")
        self.pending = handle.getListState("pending", "begin_offset bigint, clock bigint, flags int, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("begin_offset", kind="stable")
        old = self.numbers.get() if self.numbers.exists() else None
        a = Automaton(*old) if old else Automaton()
        added: list[tuple] = []  # pending messages of this batch; those of earlier ones stay in the state until they are settled
        out = []
        for m in zip(frame["begin_offset"], frame["clock"], frame["flags"], frame["payload"], strict=True):
            begin, clock, flags, payload = int(m[0]), int(m[1]), int(m[2]), m[3]
            outcome, low = a.step(clock, flags)
            if outcome.startswith("continue") and outcome.endswith("span"):
                added.append((begin, clock, flags, payload))
            elif outcome in ("outside_commit", "ack_empty", "ack_commit", "ack_rollback"):
                if outcome == "ack_commit":
                    held = [tuple(p) for p in self.pending.get()] if self.pending.exists() else []
                    out += [(*p, begin) for p in (*held, *added) if low < p[1] <= clock]
                if clock != 0:
                    self.pending.clear()
                    added = []
                if outcome != "ack_rollback":
                    out.append((begin, clock, flags, payload, begin))
        if a.min is not None:
            self.numbers.update((a.min, a.max, a.open))
        if added:
            self.pending.appendList(added)
        if out:
            yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["journal", "producer", "begin_offset", "clock", "flags", "payload", "commit_begin"])

    def close(self) -> None:
        pass


def committed_stream(messages: DataFrame) -> DataFrame:
    """Committed messages of a stream of journal, producer, begin_offset, clock, flags, payload. Needs the RocksDB state store."""
    rows = messages.select("journal", "producer", F.col("begin_offset").cast("long"), F.col("clock").cast("long"), F.col("flags").cast("int"), F.col("payload").cast("string"))
    return rows.groupBy("journal", "producer").transformWithStateInPandas(
        statefulProcessor=SequencerProcessor(),
        outputStructType="journal string, producer string, begin_offset bigint, clock bigint, flags int, payload string, commit_begin bigint",
        outputMode="append",
        timeMode="none",
    )


class KeyedTable:
    """A table of the latest row of each key, written once per transaction, with a fence.

    Keys are hashed to buckets, and a transaction rewrites only buckets it touches. A small head names
    the folder of each bucket, the owner and the last batch of each query; it is replaced by
    compare-and-swap, so that readers see whole versions only and a writer that was
    fenced off between its look at the head and its commit cannot publish. Folders no head names
    any more are deleted one commit later, when readers of the head before are done.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._heads = Versions(spark, f"{self.path}/HEAD")

    def _head(self) -> tuple[int, dict]:
        n, text = self._heads.read()
        return n, json.loads(text) if text else {"owner": None, "batches": {}, "folders": {}, "schema": None, "stale": []}

    def take_over(self) -> str:
        """Become the owner; whoever was it before can commit no more."""
        owner = uuid.uuid4().hex
        while True:
            n, head = self._head()
            if self._heads.replace(n, json.dumps(head | {"owner": owner})):
                return owner

    def _read(self, head: dict, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/{head['folders'][b]}" for b in (sorted(head["folders"]) if buckets is None else map(str, buckets)) if b in head["folders"]]
        return self.spark.read.schema(StructType.fromJson(head["schema"])).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._read(self._head()[1])

    def commit(self, owner: str, query: str, batch_id: int, rows: DataFrame, deleted: str = "false") -> bool:
        """Upsert rows (the largest `order` of a key wins; rows where `deleted` holds remove it). False if the batch is in already."""
        seen, head = self._head()
        if head["owner"] != owner:
            raise FencedError(self.path)
        if head["batches"].get(query, -1) >= batch_id:
            return False
        fresh = rows.withColumn("_deleted", F.expr(deleted))
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
        old = self._read(head, touched)
        if old is not None:
            fresh = fresh.unionByName(old, allowMissingColumns=True)
        cols = [c for c in fresh.columns if c not in self.key]
        latest = fresh.groupBy(*self.key).agg(F.max_by(F.struct(*cols), self.order).alias("_r")).select(*self.key, "_r.*")
        version = f"v{batch_id}-{uuid.uuid4().hex}"
        # Deleted keys stay as tombstones: late changes must not bring them back.
        latest.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        replaced = [head["folders"][str(b)] for b in touched if str(b) in head["folders"]]
        folders = head["folders"] | {str(b): f"{version}/_bucket={b}" for b in touched}
        new = head | {"folders": folders, "batches": head["batches"] | {query: batch_id}, "schema": json.loads(latest.schema.json()), "stale": replaced}
        if not self._heads.replace(seen, json.dumps(new)):
            remove(self.spark, f"{self.path}/{version}")
            if self._head()[1]["owner"] != owner:
                raise FencedError(self.path)
            return self.commit(owner, query, batch_id, rows, deleted)  # another query of the same owner came first
        for folder in head["stale"]:
            remove(self.spark, f"{self.path}/{folder}")
        return True

    def live(self) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.where("not coalesce(_deleted, false)").drop("_deleted")


def run_consumer(
    stream: DataFrame,
    name: str,
    checkpoint: str,
    transaction: Callable[[DataFrame, int], None],
    available_now: bool = True,
    begin: Callable[[int], None] | None = None,
    finished: Callable[[int, Exception | None], None] | None = None,
    min_interval: str | None = None,
) -> StreamingQuery:
    """Call transaction(rows, batch_id) once per micro-batch; it commits under batch_id. With available_now it drains and ends.

    begin(batch_id) is called before it, finished(batch_id, error or None) after it, whether it failed
    or not. min_interval ('5 seconds') lets a transaction gather at least so long; how much it may
    take at most is an option of the source, such as maxFilesPerTrigger.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        if begin:
            begin(batch_id)
        try:
            transaction(rows, batch_id)
        except Exception as e:
            if finished:
                finished(batch_id, e)
            raise
        if finished:
            finished(batch_id, None)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return (writer.trigger(processingTime=min_interval) if min_interval else writer).start()


def with_deferred(path: str, schema: StructType, transaction: Callable[[DataFrame, int], DataFrame | None]) -> Callable[[DataFrame, int], None]:
    """A transaction for run_consumer() that may put rows off: what it returns comes again at the head of the next batch.

    Put-off rows are written under the batch that put them off; a batch that runs again reads the same
    ones and writes its own anew. `order` of rows is not kept.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = f"{path.rstrip('/')}/deferred-{batch_id - 1}"
        if exists(spark, before):
            rows = rows.select(*schema.fieldNames()).unionByName(spark.read.schema(schema).parquet(before))
        later = transaction(rows, batch_id)
        if later is not None:
            later.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{path.rstrip('/')}/deferred-{batch_id}")
        # What was put off two batches ago has been taken up by a batch that committed.
        remove(spark, f"{path.rstrip('/')}/deferred-{batch_id - 2}")

    return run


class JsonStore:
    """A small state as one JSON document, committed together with the checkpoint it belongs to, by compare-and-swap.

    Who opens it last owns it: a commit of an owner before is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._versions, self._owner = Versions(spark, path), uuid.uuid4().hex
        while True:
            self._seen, text = self._versions.read()
            doc = json.loads(text) if text else {"state": None, "checkpoint": None}
            if self._versions.replace(self._seen, json.dumps(doc | {"owner": self._owner})):
                self._seen += 1
                break
        self.state, self.checkpoint = doc["state"], doc["checkpoint"]

    def commit(self, state: object, checkpoint: object) -> None:
        if not self._versions.replace(self._seen, json.dumps({"state": state, "checkpoint": checkpoint, "owner": self._owner})):
            raise FencedError(self._versions.path)
        self._seen += 1
        self.state, self.checkpoint = state, checkpoint


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation whose get holds the counters (aggregates over df's rows) once df has been read to its end."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches and rows a query has read, and how far: what a caller compares to read its own writes."""
    got = query.recentProgress
    return {"batches": len(got), "rows": sum(p["numInputRows"] for p in got), "last_batch": max((p["batchId"] for p in got), default=-1)}


def running_sums(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running sum and count per key, for update or complete mode."""
    return stream.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("count"))


class KeepLastProcessor(StatefulProcessor):
    """The last n rows of a key by (ts, id); emits the window's size and newest row after each batch."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "ts bigint, id bigint")

    def handleInputRows(self, key, rows, timerValues):
        have = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for f in rows:
            have += [(int(t), int(i)) for t, i in zip(f["ts"], f["id"], strict=True)]
        have = sorted(set(have))[-self.n :]
        self.rows.put(have)
        yield pd.DataFrame({"key": [key[0]], "kept": [len(have)], "newest": [have[-1][1]], "oldest": [have[0][1]]})

    def close(self) -> None:
        pass


def keep_last_stream(stream: DataFrame, n: int) -> DataFrame:
    """key, kept, newest, oldest per key of a stream of key, ts, id (longs)."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=KeepLastProcessor(n), outputStructType="key bigint, kept bigint, newest bigint, oldest bigint", outputMode="update", timeMode="none")
