"""Apply a change feed of creates, links, writes and unlinks to rebuild the files live at its end.

1. *Order.* The feed of a log is a chain: an operation fits at a seq_no if its checksum is the one
   arrived at so far. Each log is cut into shards of 2**shard_bits seq_nos. One backward pass over
   a shard tells, for each checksum it may be entered with, the checksum it is left with; a walk
   over those few summary rows (one task a log, one row a shard) finds how each replay enters each
   shard; a forward pass then emits the operations each replay applies. No task follows more than
   a shard, however long its log is.
2. *Apply.* The applied operations are upserted, bucket by bucket, into a table of an embedded
   DuckDB, in whatever order they arrive: a conflicting row replaces the stored one only if its
   sequence number is higher, and unlinked paths stay as tombstones, so that repeated and
   out-of-order changes end in the same state. Each bucket exports its live rows to a staging
   folder, which is published with one rename once all are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import coverage
from tidemark.session import materialize, rename, width, work_path

#: Kinds of a change: what a path's row becomes.
LINK, UNLINK, WRITE = 1, 2, 3


def _candidates(ops: DataFrame, shard_bits: int) -> DataFrame:
    """The one operation that may apply for each (log, seq_no, checksum): smallest first_offset, then delivery_id."""
    kind = F.when(F.col("op_create").isNotNull() | F.col("op_link").isNotNull(), LINK).when(F.col("op_unlink").isNotNull(), UNLINK).when(F.col("op_write").isNotNull(), WRITE).otherwise(0)
    fnode = F.when(F.col("op_create").isNotNull(), F.col("seq_no")).otherwise(F.coalesce("op_link.fnode", "op_unlink.fnode", "op_write.fnode"))
    path = F.coalesce("op_create.path", "op_link.path", "op_unlink.path")
    first = F.struct(F.col("first_offset").isNull(), "first_offset", "delivery_id")
    rows = ops.where("log is not null and seq_no is not null and checksum is not null")
    best = rows.groupBy("log", "seq_no", "checksum").agg(F.min_by(F.struct("next_checksum", kind.alias("kind"), fnode.alias("fnode"), path.alias("path")), first).alias("op"))
    return best.select("log", F.expr(f"shiftright(seq_no, {shard_bits})").alias("shard"), "seq_no", "checksum", "op.*")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of equal first `by` columns; a group is consumed row by row."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    yield from groupby(rows(), key=lambda r: r[:by])


def _summaries(shard_bits: int):
    """Rows (log, shard, seq_no desc, checksum, next_checksum, is_start) -> entry to exit of each shard."""
    schema = pa.schema([("log", pa.string()), ("shard", pa.int64()), ("seq_no", pa.int64()), ("checksum", pa.int64()), ("exit_checksum", pa.int64())])

    def run(batches):
        out: list[tuple] = []
        for (log, shard), rows in _groups(batches, 2):
            top = ((shard + 1) << shard_bits) - 1
            # leaves[c]: the checksum with which the shard is left from checksum c at the seq_no above; None: it ends here.
            above, at, leaves, here, starts = {}, None, {}, {}, []
            for _, _, seq, checksum, nxt, start in rows:
                if seq != at:
                    above = here if at is not None and at == seq + 1 else {}
                    at, here = seq, {}
                if start:  # sorts after the operations of its seq_no
                    starts.append((seq, checksum, here.get(checksum)))
                else:
                    here[checksum] = nxt if seq == top else above.get(nxt)
            leaves = here if at == shard << shard_bits else {}
            out += [(log, shard, shard << shard_bits, c, x) for c, x in leaves.items() if x is not None]
            out += [(log, shard, s, c, x) for s, c, x in starts if x is not None and s != shard << shard_bits]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _entries(shard_bits: int):
    """Walk each replay of a log over the summaries: which checksum it enters each shard with."""

    def run(batches):
        out: list[tuple] = []
        schema = pa.schema([("log", pa.string()), ("shard", pa.int64()), ("seq_no", pa.int64()), ("checksum", pa.int64()), ("replay", pa.int64())])
        for (log,), rows in _groups(batches, 1):
            exits, starts = {}, []
            for _, seq, checksum, exit_checksum, replay in rows:
                if replay is None:
                    exits[seq, checksum] = exit_checksum
                else:
                    starts.append((seq, checksum, replay))
            for seq, checksum, replay in starts:
                while checksum is not None:
                    out.append((log, seq >> shard_bits, seq, checksum, replay))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out = []
                    checksum = exits.get((seq, checksum))
                    seq = ((seq >> shard_bits) + 1) << shard_bits
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _applied():
    """Rows sorted by (log, shard, seq_no, is_op, checksum): entering replays and operations -> applied changes."""
    schema = pa.schema([("replay", pa.int64()), ("fnode", pa.int64()), ("path", pa.string()), ("seq_no", pa.int64()), ("kind", pa.int32())])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        out: list[tuple] = []
        for _, rows in _groups(batches, 2):
            at, here, ahead = None, {}, {}  # checksum arrived at -> replays
            for _, _, seq, is_op, checksum, nxt, kind, fnode, path, replay in rows:
                if seq != at:
                    here = ahead if at is not None and at + 1 == seq else {}
                    at, ahead = seq, {}
                if not is_op:
                    here.setdefault(checksum, []).append(replay)
                elif checksum in here:
                    for r in here[checksum]:
                        if kind:
                            out.append((r, fnode, path, seq, kind))
                        if nxt is not None:
                            ahead.setdefault(nxt, []).append(r)
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return run


def applied_operations(ops: DataFrame, starts: DataFrame, shard_bits: int = 12) -> DataFrame:
    """replay, fnode, path, seq_no, kind of each operation a replay applies. starts: replay, log, seq_no, checksum."""
    n = width(ops.sparkSession)
    cand = materialize(_candidates(ops, shard_bits), "feed-candidates")
    starts = starts.withColumn("shard", F.expr(f"shiftright(seq_no, {shard_bits})"))
    marks = starts.select("log", "shard", "seq_no", "checksum", F.lit(None).cast("long").alias("next_checksum"), F.lit(True).alias("is_start")).dropDuplicates()
    nodes = cand.select("log", "shard", "seq_no", "checksum", "next_checksum", F.lit(False).alias("is_start")).unionByName(marks)
    nodes = nodes.repartition(n, "log", "shard").sortWithinPartitions("log", "shard", F.col("seq_no").desc(), "is_start")
    exits = nodes.mapInArrow(_summaries(shard_bits), "log string, shard bigint, seq_no bigint, checksum bigint, exit_checksum bigint")
    walk = exits.select("log", "seq_no", "checksum", "exit_checksum", F.lit(None).cast("long").alias("replay")).unionByName(starts.select("log", "seq_no", "checksum", F.lit(None).cast("long").alias("exit_checksum"), "replay"))
    entries = walk.repartition(n, "log").sortWithinPartitions("log").mapInArrow(_entries(shard_bits), "log string, shard bigint, seq_no bigint, checksum bigint, replay bigint")
    none = lambda t: F.lit(None).cast(t)
    enter = entries.select("log", "shard", "seq_no", F.lit(False).alias("is_op"), "checksum", none("long").alias("next_checksum"), none("int").alias("kind"), none("long").alias("fnode"), none("string").alias("path"), "replay")
    oper = cand.select("log", "shard", "seq_no", F.lit(True).alias("is_op"), "checksum", "next_checksum", "kind", "fnode", "path", none("long").alias("replay"))
    # Only shards that a replay enters are walked again.
    both = enter.unionByName(oper).repartition(n, "log", "shard").sortWithinPartitions("log", "shard", "seq_no", "is_op")
    return both.mapInArrow(_applied(), "replay bigint, fnode bigint, path string, seq_no bigint, kind int")


_UPSERT = """
insert into state select fnode, path, replay, max(seq_no), arg_max(kind, seq_no) from feed group by all
on conflict (replay, fnode, path) do update set seq_no = excluded.seq_no, kind = excluded.kind where excluded.seq_no > state.seq_no
"""


def _duck_upsert(memory_mb: int):
    """Rows (fnode, path, replay, seq_no, kind), in any order -> live (replay, fnode, path) of the bucket."""

    def run(batches):
        import duckdb

        # No spilling: a bucket is of bounded size, and executors have no folder of their own to rely on.
        con = duckdb.connect(":memory:", config={"memory_limit": f"{memory_mb}MB", "threads": 1, "temp_directory": ""})
        con.execute("create table state (fnode bigint, path varchar, replay bigint, seq_no bigint, kind integer, primary key (replay, fnode, path))")
        for b in batches:
            if b.num_rows:
                con.register("feed", pa.Table.from_batches([b]))
                con.execute(_UPSERT)
                con.unregister("feed")
        live = con.execute(f"select replay, fnode, path from state where kind = {LINK}")
        while rows := live.fetchmany(20_000):
            r, f, p = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(f, pa.int64()), pa.array(p, pa.string())], names=["replay", "fnode", "path"])
        con.close()

    return run


def _starts(hints: DataFrame) -> DataFrame:
    starts = hints.select("log", F.col("first_seq_no").alias("seq_no"), F.col("first_checksum").alias("checksum")).dropna().dropDuplicates()
    # The id is a hash of the start itself: stable if a lost task runs again.
    return starts.withColumn("replay", F.xxhash64("log", "seq_no", "checksum"))


def live_segments(ops: DataFrame, hints: DataFrame, shard_bits: int = 12) -> DataFrame:
    """log, fnode, first_seq_no, last_seq_no: what must be read again to restore each live fnode of each replay.

    A segment is a run of operations that follow each other and name a live fnode; runs are the
    coverage of its sequence numbers, so that a hot fnode is cut into shards. In as for live_files().
    """
    starts = _starts(hints)
    feed = materialize(applied_operations(ops, starts.select("replay", "log", "seq_no", "checksum"), shard_bits).where("fnode is not null"), "feed-applied")
    state = feed.where(f"kind in ({LINK}, {UNLINK}) and path is not null").groupBy("replay", "fnode", "path").agg(F.max_by("kind", "seq_no").alias("kind"))
    live = state.where(f"kind = {LINK}").select("replay", "fnode").distinct()
    named = feed.join(live, ["replay", "fnode"], "left_semi").select(F.struct("replay", "fnode").alias("who"), F.col("seq_no").alias("first_seq_no"), (F.col("seq_no") + 1).alias("stop"))
    spans = coverage(named, "who", "first_seq_no", "stop").where("kind = 'span'").select("who.*", "first_seq_no", (F.col("stop") - 1).alias("last_seq_no"))
    return spans.join(starts.select("replay", "log"), "replay").select("log", "fnode", "first_seq_no", "last_seq_no")


def live_files(ops: DataFrame, hints: DataFrame, shard_bits: int = 12, rows_per_bucket: int = 200_000, bucket_memory_mb: int = 512) -> DataFrame:
    """log, path, fnode, last_seq_no: one row per path linked to a live fnode at the end of each replay.

    In: ops like recorded_ops, hints (log, first_seq_no, first_checksum). A replay begins at each
    row of hints; at each seq_no the operation applied is the one whose checksum was arrived at,
    of several the one of smallest first_offset (null last), then smallest delivery_id; it ends
    where nothing fits or next_checksum is null. Operations with a null log, seq_no or checksum
    never fit; a null author does not matter. Hints with a null are no starting points, repeated
    rows of hints are one. A path or fnode that is null is touched by nothing. An fnode is live
    while it has a path; an unlink of what was not linked changes nothing.
    """
    spark = ops.sparkSession
    starts = _starts(hints)
    feed = materialize(applied_operations(ops, starts.select("replay", "log", "seq_no", "checksum"), shard_bits).where("fnode is not null"), "feed-applied")
    links = feed.where(f"kind in ({LINK}, {UNLINK}) and path is not null")
    buckets = max(width(spark), links.count() // rows_per_bucket + 1)
    bucketed = links.select("fnode", "path", "replay", "seq_no", "kind").repartition(buckets, "replay", "fnode", "path")
    staging, final = work_path(spark, "live-staging"), work_path(spark, "live")
    bucketed.mapInArrow(_duck_upsert(bucket_memory_mb), "replay bigint, fnode bigint, path string").write.parquet(staging)
    rename(spark, staging, final)
    live = spark.read.schema("replay bigint, fnode bigint, path string").parquet(final)
    # Every applied operation that named the fnode counts; pre-aggregated on the map side, so hot fnodes are cheap.
    last = feed.groupBy("replay", "fnode").agg(F.max("seq_no").alias("last_seq_no"))
    return live.join(last, ["replay", "fnode"]).join(starts.select("replay", "log"), "replay").select("log", "path", "fnode", "last_seq_no")
