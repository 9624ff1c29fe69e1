"""Queries through the journal source and Structured Streaming. Each drains its stream and returns what it wrote."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import journals
from tidemark.plans.tables import table
from tidemark.session import work_path
from tidemark.sources import journal as source
from tidemark.streaming import consumer

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@contextlib.contextmanager
def _stateful(spark: SparkSession):
    """Settings that stateful queries need, put back afterwards."""
    want = {"spark.sql.streaming.stateStore.providerClass": consumer.ROCKSDB}
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a glob: a plain path would have to be a folder


def _drain(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    out, check = work_path(spark, "stream-out"), work_path(spark, "stream-checkpoint")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def last(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = df.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


@query(journals.SQL["seq_committed"])
def stream_committed(spark, sf_dir):
    """The stateful sequencer over events as a stream of messages."""
    with _stateful(spark):
        e = _stream(spark, sf_dir, "events")
        flags = F.when(F.col("event_id") % 7 == 0, 2).when(F.col("event_id") % 5 == 0, 0).otherwise(1)
        m = e.select(F.format_string("events/part-%03d", F.col("user_id") % 8).alias("journal"), F.col("user_id").cast("string").alias("producer"), (F.col("event_id") * 100).alias("begin_offset"), (F.col("event_id") + 1).alias("clock"), flags.alias("flags"), F.lit("").alias("payload"))
        return _drain(spark, consumer.committed_stream(m)).drop("payload")


@query("select event_type, sum(event_id)::bigint as total, count(*) as count from events group by 1")
def stream_running_sums(spark, sf_dir):
    out = _drain(spark, consumer.running_sums(_stream(spark, sf_dir, "events"), "event_type", "event_id"), "complete")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("total", "count"), "_batch").alias("r"))
    return last.select("event_type", "r.*")


@query("select user_id as key, count(*) as kept, max(event_id) as newest, min(event_id) as oldest from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20 group by 1")
def stream_keep_last(spark, sf_dir):
    with _stateful(spark):
        e = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"))
        out = _drain(spark, consumer.keep_last_stream(e, 20), "update")
        return out.groupBy("key").agg(F.max_by(F.struct("kept", "newest", "oldest"), "_batch").alias("r")).select("key", "r.*")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1 having arg_max(event_type, event_id) <> 'error'")
def consumer_upsert(spark, sf_dir):
    """Each micro-batch is one transaction on a keyed table; errors delete."""
    state = consumer.KeyedTable(spark, work_path(spark, "keyed-table"), ["user_id"], "event_id")
    owner = state.take_over()
    stream = _stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    q = consumer.run_consumer(stream, f"upsert-{owner[:8]}", work_path(spark, "stream-checkpoint"), lambda rows, batch: state.commit(owner, "upsert", batch, rows, "event_type = 'error'"))
    q.awaitTermination()
    return state.live()


_JSON = "select c_custkey, c_name, c_nationkey, c_acctbal from customer"


def _written(spark: SparkSession, sf_dir: str, codec: str) -> str:
    from tidemark.functions.mapping import modulo

    source.register(spark)
    root = work_path(spark, "journals")
    c = table(spark, sf_dir, "customer")
    rows = c.select(modulo("c_name", tuple(f"customers/part-{i:03d}" for i in range(4))).alias("journal"), F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal")).cast("binary").alias("payload"))
    rows.write.format("journal").option("path", root).option("codec", codec).option("postfix", "utc_date=2025-03-01/utc_hour=00").mode("append").save()
    return root


def _parsed(df: DataFrame) -> DataFrame:
    return df.select(F.from_json(F.col("payload").cast("string"), "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double").alias("r")).select("r.*")


@query(_JSON)
def journal_roundtrip(spark, sf_dir):
    """customer written as JSON lines to compressed fragments, and read again."""
    return _parsed(spark.read.format("journal").option("path", _written(spark, sf_dir, "ZSTANDARD")).load())


@query(_JSON)
def journal_stream(spark, sf_dir):
    """The same through the streaming reader."""
    return _parsed(_drain(spark, spark.readStream.format("journal").option("path", _written(spark, sf_dir, "SNAPPY")).load()))


_PARTS = f"with c as (select *, 'customers/part-' || lpad(({journals._fnv('c_name')} % 4)::varchar, 3, '0') as journal from customer)"


@query(f"{_PARTS} select c_custkey, c_name, c_nationkey, c_acctbal from c where journal = 'customers/part-002'")
def journal_pruned(spark, sf_dir):
    """A filter on the journal is pushed into the listing."""
    d = spark.read.format("journal").option("path", _written(spark, sf_dir, "GZIP")).load()
    return _parsed(d.where("journal = 'customers/part-002'"))


@query(f"{_PARTS} select journal, 'ZSTANDARD' as codec, 'utc_date=2025-03-01/utc_hour=00' as path_postfix, 0::bigint as first_offset, count(*) as records from c group by 1")
def journal_manifest(spark, sf_dir):
    """The listing as a table, beside the number of records that the files hold."""
    root = _written(spark, sf_dir, "ZSTANDARD")
    m = source.manifest(spark, [root]).groupBy("journal", "codec", "path_postfix").agg(F.min("begin_offset").alias("first_offset"))
    n = spark.read.format("journal").option("path", root).load().groupBy("journal").agg(F.count("*").alias("records"))
    return m.join(n, "journal")


def _messages_written(spark: SparkSession, sf_dir: str) -> str:
    """The troubled messages as JSON with their UUIDs, appended to journals in their order in two writes."""
    from tidemark.functions import uuids

    source.register(spark)
    root = work_path(spark, "message-journals")
    m = journals.troubled(spark, sf_dir)
    uuid = uuids.build(F.lpad(F.lower(F.hex(F.col("producer").cast("long"))), 12, "0"), F.col("clock") * 16 + (1 << 40), F.col("flags"))
    rows = m.select("journal", F.col("begin_offset").alias("place"), F.to_json(F.struct(uuid.alias("uuid"), F.col("begin_offset").alias("place"), "value")).cast("binary").alias("payload"))
    for half in ("place < 30000", "place >= 30000"):
        rows.where(half).orderBy("journal", "place").select("journal", "payload").write.format("journal").option("path", root).option("codec", "GZIP").mode("append").save()
    return root


@query(journals._TROUBLED + """select journal, begin_offset as place from run where n > 0 and outcome in ('outside_commit', 'ack_empty', 'ack_commit')
union all
select p.journal, p.begin_offset from run p join run a on a.journal = p.journal and a.producer = p.producer and a.span = p.span and a.outcome = 'ack_commit' and a.n > p.n
where p.outcome in ('continue_begin_span', 'continue_extend_span') and p.clock > a.bound and p.clock <= a.clock""")
def journal_read_committed(spark, sf_dir):
    """Messages written to journals, with repeats and rollbacks, and read back committed."""
    from tidemark.sources.messages import read_committed

    return read_committed(spark, _messages_written(spark, sf_dir), "uuid string, place bigint, value double").select("journal", "place")


@query(journals._TROUBLED + "select journal, begin_offset as place, flags from q where journal in ('events/part-001', 'events/part-004')")
def journal_read_uncommitted(spark, sf_dir):
    """All envelopes of two journals, those that a selector finds in a catalog."""
    from tidemark.functions import uuids
    from tidemark.functions.labels import label, label_set
    from tidemark.sources.messages import read_uncommitted, select_journals

    specs = spark.range(8).select(F.format_string("events/part-%03d", "id").alias("name"), label_set(label("app", F.lit("events")), label("parity", (F.col("id") % 3).cast("string"))).alias("labels"))
    chosen = select_journals(specs.where("id in (1, 2, 4)"), "app=events, parity in (1)")
    env = read_uncommitted(spark, _messages_written(spark, sf_dir), "uuid string, place bigint", chosen)
    return env.select("journal", "place", uuids.flags("uuid").alias("flags"))


_UUIDS = journals._uuid_sql("printf('%012x', c_custkey)", "(c_custkey * 16 + 1099511627776)", "0")


@query(f"select {_UUIDS} as uuid, c_name, round(c_acctbal * 100)::bigint as cents from customer")
def journal_csv(spark, sf_dir):
    """customer as CSV records whose first field is a UUID, quoted names among them."""
    from tidemark.functions import uuids

    source.register(spark)
    root = work_path(spark, "csv-journals")
    c = table(spark, sf_dir, "customer")
    uuid = uuids.build(F.lpad(F.lower(F.hex("c_custkey")), 12, "0"), F.col("c_custkey") * 16 + (1 << 40), F.lit(0))
    line = F.concat(uuid, F.lit(',"'), F.col("c_name"), F.lit('",'), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"))
    c.select(F.lit("customers/csv").alias("journal"), line.cast("binary").alias("payload")).write.format("journal").options(path=root, contentType="text/csv", codec="GZIP").mode("append").save()
    d = spark.read.format("journal").options(path=root, contentType="text/csv").load()
    r = F.from_csv(F.col("payload").cast("string"), F.lit("uuid string, c_name string, cents bigint"))
    return d.select(r.alias("r")).select("r.*")


@query("select o_orderkey, o_orderstatus from orders")
def journal_fixed(spark, sf_dir):
    """orders as length-framed records, eight bytes of key and the status."""
    source.register(spark)
    root = work_path(spark, "fixed-journals")
    o = table(spark, sf_dir, "orders")
    payload = F.concat(F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")), F.col("o_orderstatus").cast("binary"))
    o.select(F.concat(F.lit("orders/"), F.col("o_orderstatus")).alias("journal"), payload.alias("payload")).write.format("journal").options(path=root, contentType="application/x-protobuf-fixed").mode("append").save()
    d = spark.read.format("journal").options(path=root, contentType="application/x-protobuf-fixed").load()
    h = F.hex("payload")
    return d.select(F.conv(F.substring(h, 1, 16), 16, 10).cast("long").alias("o_orderkey"), F.unhex(F.expr("substring(hex(payload), 17)")).cast("string").alias("o_orderstatus"))


@query("""select seq_no, checksum, author, op_create.path as created, op_link.path as linked, op_unlink.path as unlinked, coalesce(op_link.fnode, op_unlink.fnode, op_write.fnode) as fnode, op_write.write_offset as write_offset, op_write.write_length % 97 as write_length
from recorded_ops where log is not null and seq_no is not null and checksum is not null and author is not null""")
def journal_recovery_log(spark, sf_dir):
    """recorded_ops encoded to recovery logs, the writes with their bytes, and decoded again."""
    import pyarrow as pa

    from tidemark.sources import framing

    source.register(spark)
    root = work_path(spark, "recovery-journals")
    ops = table(spark, sf_dir, "recorded_ops").where("log is not null and seq_no is not null and checksum is not null and author is not null")
    short = F.when(F.col("op_write").isNotNull(), F.struct("op_write.fnode", "op_write.write_offset", (F.col("op_write.write_length") % 97).alias("write_length")))
    rows = ops.select("log", F.struct("seq_no", "checksum", "author", "op_create", "op_link", "op_unlink", short.alias("op_write"), "op_property").alias("op"))

    def encode(batches):
        for b in batches:
            frames = [framing.encode_op(op, bytes((op["op_write"]["write_length"] or 0) if op["op_write"] else 0)) for op in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"recovery/{x}" for x in b.column(0).to_pylist()]), pa.array(frames, pa.binary())], names=["journal", "payload"])

    rows.mapInArrow(encode, "journal string, payload binary").write.format("journal").options(path=root, contentType="recovery-log", codec="SNAPPY").mode("append").save()
    kind = "seq_no bigint, checksum bigint, author bigint, op_create struct<path: string>, op_link struct<fnode: bigint, path: string>, op_unlink struct<fnode: bigint, path: string>, op_write struct<fnode: bigint, write_offset: bigint, write_length: bigint>"
    schema = T._parse_datatype_string(kind)

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            ops = [framing.recorded_op(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: o[k] for k in schema.fieldNames()} for o in ops], schema=to_arrow_schema(schema))

    d = spark.read.format("journal").options(path=root, contentType="recovery-log").load().select("payload").mapInArrow(decode, kind)
    return d.select("seq_no", "checksum", "author", F.col("op_create.path").alias("created"), F.col("op_link.path").alias("linked"), F.col("op_unlink.path").alias("unlinked"), F.coalesce("op_link.fnode", "op_unlink.fnode", "op_write.fnode").alias("fnode"), "op_write.write_offset", "op_write.write_length")


@query(_JSON)
def journal_two_stores(spark, sf_dir):
    """Two stores, of which the second holds a copy of some journals: each record comes once."""
    root, other = _written(spark, sf_dir, "GZIP"), work_path(spark, "journals-copy")
    from pyarrow import fs

    store, base = source.filesystem(root)
    to, base_to = source.filesystem(other)
    for f in source.list_fragments([root]):
        if f.journal.endswith(("0", "1")):
            path = base_to + f.path[len(base) :]
            to.create_dir(path.rpartition("/")[0], recursive=True)
            fs.copy_files(f.path, path, source_filesystem=store, destination_filesystem=to)
    return _parsed(spark.read.format("journal").option("path", f"{other},{root}").load())


@query("select c_custkey, c_custkey % 2 = 1 as late from customer")
def journal_incremental(spark, sf_dir):
    """What was appended between two runs comes in the second, and nothing twice."""
    source.register(spark)
    root, out, check = (work_path(spark, n) for n in ("incremental", "incremental-out", "incremental-checkpoint"))
    c = table(spark, sf_dir, "customer").select(F.lit("customers/all").alias("journal"), F.col("c_custkey").cast("string").cast("binary").alias("payload"))
    for run in (0, 1):
        c.where(F.col("payload").cast("string").cast("long") % 2 == run).write.format("journal").option("path", root).mode("append").save()
        got = spark.readStream.format("journal").option("path", root).load().select(F.col("payload").cast("string").cast("long").alias("c_custkey"), F.lit(run == 1).alias("late"))
        got.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("c_custkey bigint, late boolean").parquet(out)


@query("select * from (values (0, 'OK'), (3, 'OK'), (8, 'OFFSET_NOT_YET_AVAILABLE'), (100, 'OFFSET_NOT_YET_AVAILABLE')) t(read_at, status)")
def journal_status(spark, sf_dir):
    """What reads at several offsets of a journal of eight bytes would meet."""
    source.register(spark)
    root = work_path(spark, "status")
    spark.createDataFrame([("j/one", b"abc"), ("j/one", b"def")], "journal string, payload binary").coalesce(1).write.format("journal").option("path", root).mode("append").save()
    return spark.createDataFrame([(at, source.status(at, [root], "j/one")) for at in (0, 3, 8, 100)], "read_at int, status string")


@query("select * from (values (1, 'appended', 4), (2, 'refused', 4), (3, 'appended', 8), (4, 'refused', 8), (5, 'appended', 12)) t(step, outcome, head)")
def append_preconditions(spark, sf_dir):
    """Appends with an expected offset and with registers that must match: those that fail change nothing."""
    from tidemark.sources.messages import Registers

    source.register(spark)
    root = work_path(spark, "preconditions")
    one = spark.createDataFrame([("j/one", b"abc")], "journal string, payload binary").coalesce(1)
    registers = Registers(spark, f"{root}/.registers")
    registers.append(union={"author": "me"})
    steps = [(None, 0), (None, 2), (None, 4), ("author=you", -1), ("author=me", -1)]
    out = []
    for step, (check, expect) in enumerate(steps, 1):
        outcome = "refused"
        if check is None or registers.append(check, union={"author": "me"}):
            try:
                one.write.format("journal").option("path", root).option("expectOffset", expect).mode("append").save()
                outcome = "appended"
            except Exception as e:  # noqa: BLE001 - the writer's error comes wrapped
                if "ends at" not in str(e):
                    raise
        out.append((step, outcome, source.write_head([root], "j/one")))
    return spark.createDataFrame(out, "step int, outcome string, head int")


@query(journals._TROUBLED.replace("q as materialized (select journal, producer, begin_offset, clock, flags,", "late as (select journal, min(begin_offset) as floor_ from m where begin_offset >= 50000 group by 1), q as materialized (select journal, producer, begin_offset, clock, flags,").replace("over (partition by journal, producer order by begin_offset) as n from m)", "over (partition by journal, producer order by begin_offset) as n from m left join late using (journal) where begin_offset >= coalesce(floor_, 0))")
    + """select journal, begin_offset as place from run where n > 0 and outcome in ('outside_commit', 'ack_empty', 'ack_commit')
union all
select p.journal, p.begin_offset from run p join run a on a.journal = p.journal and a.producer = p.producer and a.span = p.span and a.outcome = 'ack_commit' and a.n > p.n
where p.outcome in ('continue_begin_span', 'continue_extend_span') and p.clock > a.bound and p.clock <= a.clock""")
def journal_min_offsets(spark, sf_dir):
    """Committed messages of readers that begin in the middle of each journal."""
    from tidemark.sources.messages import read_committed, read_uncommitted

    root = _messages_written(spark, sf_dir)
    kind = "uuid string, place bigint"
    floors = read_uncommitted(spark, root, kind).where("place >= 50000").groupBy("journal").agg(F.min("begin_offset").alias("floor")).collect()
    return read_committed(spark, root, kind, min_offsets={r.journal: r.floor for r in floors}).select("journal", "place")
