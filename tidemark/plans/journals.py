"""Queries of the journal operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions import names as nm
from tidemark.functions import uuids
from tidemark.functions.checksums import crc32c, crc64
from tidemark.functions.mapping import modulo, rendezvous
from tidemark.operators import apps, fragments, publish, sequencer
from tidemark.plans.tables import table

JOURNALS = tuple(f"orders/part-{i:03d}" for i in range(8))
GRAM_JOURNALS = tuple(f"ngrams/part-{i:03d}" for i in range(8))
NOW = 1_741_800_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _fnv(expr: str) -> str:
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({expr}, ''), lambda c: ascii(c)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


# ---- messages ---------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages of transactions: a producer per user, eight journals."""
    e = table(spark, sf_dir, "events")
    flags = F.when(F.col("event_id") % 7 == 0, 2).when(F.col("event_id") % 5 == 0, 0).otherwise(1)
    return e.select(
        F.format_string("events/part-%03d", F.col("user_id") % 8).alias("journal"),
        F.col("user_id").cast("string").alias("producer"),
        (F.col("event_id") * 100).alias("begin_offset"),
        (F.col("event_id") * 100 + 100).alias("end_offset"),
        (F.col("event_id") + 1).alias("clock"),
        flags.alias("flags"),
        "value",
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages, with every eleventh pending one delivered again at a later offset."""
    m = messages(spark, sf_dir)
    again = m.where("flags = 1 and (clock - 1) % 11 = 0").withColumns({"begin_offset": F.col("begin_offset") + 3750, "end_offset": F.col("end_offset") + 3750})
    return m.unionByName(again)


_MESSAGES = """
with m as (select printf('events/part-%03d', user_id % 8) as journal, user_id::varchar as producer, event_id * 100 as begin_offset, event_id * 100 + 100 as end_offset,
           event_id + 1 as clock, case when event_id % 7 = 0 then 2 when event_id % 5 = 0 then 0 else 1 end as flags, value from events)
"""
_COMMITTED = (
    _MESSAGES
    + """, n as (select *, first_value(case when flags <> 1 then flags end ignore nulls) over w as next_flags,
                 first_value(case when flags <> 1 then begin_offset end ignore nulls) over w as next_begin
          from m window w as (partition by journal, producer order by begin_offset rows between 1 following and unbounded following))
select journal, producer, begin_offset, clock, flags, case when flags <> 1 then begin_offset else next_begin end as commit_begin
from n where flags <> 1 or next_flags = 2
"""
)


@query(_COMMITTED)
def seq_committed(spark, sf_dir):
    """The automaton over redelivered messages gives what a window gives over the clean ones."""
    return sequencer.committed(redelivered(spark, sf_dir))


@query(_COMMITTED)
def seq_committed_ascending(spark, sf_dir):
    return sequencer.committed_ascending(messages(spark, sf_dir)).drop("end_offset", "value")


@query(f"select * from ({_COMMITTED}) where flags <> 2")
def seq_drop_acks(spark, sf_dir):
    return sequencer.committed(redelivered(spark, sf_dir), drop_acks=True)


def troubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with repeats of pending and of committed ones, and acknowledgements that lie before what is acknowledged."""
    m = redelivered(spark, sf_dir)
    moved = lambda d, by: d.withColumns({"begin_offset": F.col("begin_offset") + by, "end_offset": F.col("end_offset") + by})
    outside = moved(m.where("flags = 0 and clock % 3 = 0"), 2260)
    stale = moved(m.where("clock % 13 = 0"), 41).withColumns({"flags": F.lit(2), "clock": F.greatest(F.lit(1), F.col("clock") - F.col("clock") % 4 * 900)})
    return m.unionByName(outside).unionByName(stale)


_TROUBLED = (
    _MESSAGES.replace("with m as", "with recursive m0 as")
    + """, m1 as (select * from m0 union all select journal, producer, begin_offset + 3750, end_offset + 3750, clock, flags, value from m0 where flags = 1 and (clock - 1) % 11 = 0),
m as (select * from m1 union all select journal, producer, begin_offset + 2260, end_offset + 2260, clock, flags, value from m1 where flags = 0 and clock % 3 = 0
  union all select journal, producer, begin_offset + 41, end_offset + 41, greatest(1, clock - clock % 4 * 900), 2, value from m1 where clock % 13 = 0),
q as materialized (select journal, producer, begin_offset, clock, flags, row_number() over (partition by journal, producer order by begin_offset) as n from m),
run as (
  select journal, producer, 0::bigint as n, 0::bigint as begin_offset, 0::bigint as clock, 0 as flags, null::bigint as acked, null::bigint as top, false as pending, 0::bigint as span, null::bigint as bound, '' as outcome from (select distinct journal, producer from q)
  union all
  select journal, producer, n, begin_offset, clock, flags,
    case when outcome in ('outside_commit', 'ack_rollback', 'ack_empty', 'ack_commit') then clock else bound end,
    case when outcome in ('outside_already_acked', 'continue_already_acked', 'continue_clock_larger') then most else clock end,
    case when outcome in ('continue_begin_span', 'continue_extend_span') then true when outcome in ('outside_commit', 'ack_rollback', 'ack_empty', 'ack_commit') then false else pending end,
    span + (outcome = 'continue_begin_span')::bigint, bound, outcome
  from (select *, case when flags = 0 then case when clock <= bound then 'outside_already_acked' else 'outside_commit' end
                       when flags = 2 then case when clock <= bound then 'ack_rollback' when pending then 'ack_commit' else 'ack_empty' end
                       when clock <= bound then 'continue_already_acked' when clock <= most then 'continue_clock_larger'
                       when pending then 'continue_extend_span' else 'continue_begin_span' end as outcome
        from (select q.*, coalesce(r.acked, q.clock - 1) as bound, coalesce(r.top, q.clock - 1) as most, r.pending, r.span from run r join q on q.journal = r.journal and q.producer = r.producer and q.n = r.n + 1)))
"""
)


@query(_TROUBLED + "select journal, producer, begin_offset, outcome from run where n > 0")
def seq_outcomes(spark, sf_dir):
    """All nine outcomes, against the automaton walked row by row."""
    return sequencer.outcomes(troubled(spark, sf_dir)).select("journal", "producer", "begin_offset", "outcome")


@query(
    _TROUBLED
    + """select journal, producer, begin_offset, clock, begin_offset as commit_begin from run where n > 0 and outcome in ('outside_commit', 'ack_empty', 'ack_commit')
union all
select p.journal, p.producer, p.begin_offset, p.clock, a.begin_offset from run p join run a on a.journal = p.journal and a.producer = p.producer and a.span = p.span and a.outcome = 'ack_commit' and a.n > p.n
where p.outcome in ('continue_begin_span', 'continue_extend_span') and p.clock > a.bound and p.clock <= a.clock"""
)
def seq_committed_troubled(spark, sf_dir):
    return sequencer.committed(troubled(spark, sf_dir)).select("journal", "producer", "begin_offset", "clock", "commit_begin")


_STATES = (
    _MESSAGES
    + """, s as (select journal, producer, max(case when flags <> 1 then clock end) as settled, max(case when flags <> 1 then begin_offset end) as settled_at, min(clock) - 1 as first_low from m group by 1, 2),
o as (select m.journal, m.producer, min(m.begin_offset) as opened from m join s using (journal, producer) where m.flags = 1 and m.begin_offset > coalesce(settled_at, -1) group by 1, 2),
states as (select journal, producer, coalesce(settled, first_low) as last_ack, coalesce(opened, -1) as begin_offset from s left join o using (journal, producer))
"""
)


@query(_STATES + "select * from states")
def producer_states(spark, sf_dir):
    return sequencer.producer_states(messages(spark, sf_dir))


@query(_STATES + "select states.* from states join (select journal, max(last_ack) as top from states group by 1) using (journal) where top - last_ack <= 5000")
def prune_states(spark, sf_dir):
    return sequencer.prune_states(sequencer.producer_states(messages(spark, sf_dir)), 5000)


@query(_MESSAGES + "select journal, max(end_offset) as read_through from m group by 1")
def read_through(spark, sf_dir):
    return sequencer.read_through(messages(spark, sf_dir))


# ---- UUIDs, mapping, publishing ---------------------------------------------------------------


def _uuid_sql(producer: str, clock: str, flags: str) -> str:
    t = f"({clock} >> 4)"
    return f"printf('%08x-%04x-1%03x-%04x-%s', ({t} & 4294967295)::bigint, (({t} >> 32) & 65535)::bigint, (({t} >> 48) & 4095)::bigint, (32768 + (({clock} & 15) << 10) + {flags})::bigint, {producer})"


_CLOCK = "(((epoch_us(ts) * 10 + 122192928000000000) << 4) + event_id % 16)"


@query(f"select event_id, {_uuid_sql("printf('%012x', user_id)", _CLOCK, 'event_id % 3')} as uuid, printf('%012x', user_id) as producer, {_CLOCK} as clock, (event_id % 3)::int as flags, ts, case event_id % 3 when 0 then 'OUTSIDE_TXN' when 1 then 'CONTINUE_TXN' else 'ACK_TXN' end as flag_name from events")
def uuid_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clock = uuids.clock_of(F.unix_micros(F.col("ts").cast("timestamp"))) + F.col("event_id") % 16
    u = e.select("event_id", uuids.build(F.lpad(F.lower(F.hex("user_id")), 12, "0"), clock, (F.col("event_id") % 3).cast("int")).alias("uuid"))
    return u.select("event_id", "uuid", uuids.producer("uuid").alias("producer"), uuids.clock("uuid").alias("clock"), uuids.flags("uuid").alias("flags"), uuids.as_time(uuids.clock("uuid")).cast("timestamp_ntz").alias("ts"), uuids.flag_name(uuids.flags("uuid")).alias("flag_name"))


@query(f"select c_custkey, {_fnv('c_name')} as hash, 'orders/part-' || lpad(({_fnv('c_name')} % 8)::varchar, 3, '0') as journal from customer")
def fnv_modulo(spark, sf_dir):
    from tidemark.functions.mapping import fnv1a

    return table(spark, sf_dir, "customer").select("c_custkey", fnv1a("c_name").alias("hash"), modulo("c_name", JOURNALS).alias("journal"))


_VARINT = "list_aggregate(list_transform(range(10), lambda i: case when i = 0 or (v >> (7 * i)) > 0 then printf('%02X', ((v >> (7 * i)) & 127)::int + case when (i < 9 and (v >> (7 * (i + 1))) > 0) then 128 else 0 end) else '' end), 'string_agg', '')"


@query(f"with x as (select o_orderkey, (o_orderkey::hugeint * o_orderkey * 7919 * 104729 % 9223372036854775807)::bigint as v from orders) select o_orderkey, {_VARINT} as encoded, v as decoded from x")
def uvarint(spark, sf_dir):
    from tidemark.functions import varint

    o = table(spark, sf_dir, "orders")
    v = o.select("o_orderkey", F.expr("cast(cast(o_orderkey as decimal(12,0)) * cast(o_orderkey as decimal(12,0)) * cast(829348951 as decimal(10,0)) % cast(9223372036854775807 as decimal(19,0)) as bigint)").alias("v"))
    e = v.withColumn("e", varint.encode("v"))
    return e.select("o_orderkey", F.hex("e").alias("encoded"), varint.decode("e").alias("decoded"))


@query("select n_nationkey - 1 as attempt, case when n_nationkey = 0 then 0 when n_nationkey <= 2 then 50 when n_nationkey <= 4 then 100 when n_nationkey <= 6 then 1000 else 5000 end::bigint as wait_ms from nation")
def backoff_schedule(spark, sf_dir):
    from tidemark.functions.retry import backoff

    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") - 1).alias("attempt"))
    return n.select("attempt", backoff("attempt").alias("wait_ms"))


@query("select event_id, 'utc_date=' || strftime(ts, '%Y-%m-%d') || '/utc_hour=' || strftime(ts, '%H') as postfix from events")
def postfix_template(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", nm.date_postfix(F.col("ts").cast("timestamp")).alias("postfix"))


@query(f"select event_id, greatest({_CLOCK} + 160, ((epoch_us(ts) - event_id % 3 + 1) * 10 + 122192928000000000) << 4) as clock from events")
def clock_updates(spark, sf_dir):
    """A clock that ticked once and then sees a time a little before or after its own."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = uuids.tick(uuids.clock_of(micros) + F.col("event_id") % 16)
    return e.select("event_id", uuids.update(own, micros - F.col("event_id") % 3 + 1).alias("clock"))


@query("select c_custkey, 'all/customers' as journal from customer")
def constant_mapping(spark, sf_dir):
    from tidemark.functions.mapping import constant

    return table(spark, sf_dir, "customer").select("c_custkey", constant("all/customers").alias("journal"))


@query("select c_custkey, true as listed from customer")
def random_mapping(spark, sf_dir):
    """Every row goes to one of the listed journals."""
    from tidemark.functions.mapping import random

    return table(spark, sf_dir, "customer").select("c_custkey", random(JOURNALS, 1).isin(*JOURNALS).alias("listed"))


@query(
    f"""
with j as (select 'orders/part-' || lpad(i::varchar, 3, '0') as name, i from range(8) t(i)), h as (select name, i, {_fnv('name')} as ph from j),
c as (select c_custkey, {_fnv('c_name')} as kh from customer)
select c_custkey, arg_max(name, xor(kh, ph) * 100 - i) as journal from c, h group by 1"""
)
def rendezvous_mapping(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", rendezvous("c_name", JOURNALS).alias("journal"))


@query("select o_orderkey, o_orderpriority as journal from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def direct_mapping(spark, sf_dir):
    from tidemark.functions.mapping import direct

    listed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "name string")
    return direct(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("journal")), "journal", listed)


_PRODUCER, _START = "01aabbccddee", 2_200_000_000_000_000_000
_MAPPED = f"o as (select o_orderkey, o_custkey, o_totalprice, 'orders/part-' || lpad(({_fnv('o_custkey::varchar')} % 8)::varchar, 3, '0') as journal from orders), c as (select *, {_START} + row_number() over (partition by journal order by o_orderkey) * 160 as clock from o)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_custkey").cast("string").alias("key"))


@query(f"with {_MAPPED} select o_orderkey, journal, clock, 0 as flags, {_uuid_sql(repr(_PRODUCER), 'clock', '0')} as uuid from c")
def publish_committed(spark, sf_dir):
    return publish.publish_committed(_orders(spark, sf_dir), "key", JOURNALS, _PRODUCER, _START, ["o_orderkey"]).select("o_orderkey", "journal", "clock", "flags", "uuid")


@query(
    f"""with {_MAPPED}, a as (select journal, max(clock) + 160 as clock, 2 as flags from c group by 1), u as (select journal, clock, 1 as flags from c union all select * from a)
select journal, clock, flags, {_uuid_sql(repr(_PRODUCER), 'clock', 'flags')} as uuid from u"""
)
def publish_transaction(spark, sf_dir):
    """Pending messages and the acknowledgements that commit them."""
    pending = publish.publish_transaction(_orders(spark, sf_dir), "key", JOURNALS, _PRODUCER, _START, ["o_orderkey"]).select("journal", "clock", "flags", "uuid")
    return pending.unionByName(publish.ack_intents(pending, _PRODUCER))


@query("select o_orderkey, o_totalprice > 1000 and o_orderstatus <> 'P' as valid from orders")
def validate_messages(spark, sf_dir):
    good, bad = publish.reject_invalid(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") != "P"))
    return good.select("o_orderkey", F.lit(True).alias("valid")).unionByName(bad.select("o_orderkey", F.lit(False).alias("valid")))


# ---- labels -----------------------------------------------------------------------------------


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    brand = F.regexp_replace("p_brand", "#", "-")
    kind = F.regexp_replace("p_type", " ", "/")
    a = lb.label_set(lb.label("brand", brand), lb.label("size", F.col("p_size").cast("string")), lb.label("type", kind), lb.label("size", (F.col("p_size") % 7).cast("string")))
    b = lb.label_set(lb.label("brand", F.lit("Brand-13")), lb.label("size", F.col("p_size").cast("string")), lb.label("tier", (F.col("p_partkey") % 3).cast("string")))
    return p.select("p_partkey", a.alias("labels"), b.alias("other"))


_PARTS = """
with p as (select p_partkey, replace(p_brand, '#', '-') as brand, p_size, p_size % 7 as small, replace(p_type, ' ', '/') as kind, p_partkey % 3 as tier from part),
a as (select distinct p_partkey, name, value from p, unnest([{'name': 'brand', 'value': brand}, {'name': 'size', 'value': p_size::varchar}, {'name': 'type', 'value': kind}, {'name': 'size', 'value': small::varchar}]) as u(x), lateral (select x.name as name, x.value as value)),
b as (select distinct p_partkey, name, value from p, unnest([{'name': 'brand', 'value': 'Brand-13'}, {'name': 'size', 'value': p_size::varchar}, {'name': 'tier', 'value': tier::varchar}]) as u(x), lateral (select x.name as name, x.value as value))
"""
_SHOWN = "select p_partkey, coalesce(string_agg(name || '=' || value, ',' order by name, value), '') as labels from"
_GROUPED = "ga as (select p_partkey, name, list(value order by value) as v from a group by 1, 2), gb as (select p_partkey, name, list(value order by value) as v from b group by 1, 2)"


def _shown(labels):
    return F.array_join(F.transform(labels, lambda x: F.concat_ws("=", x["name"], x["value"])), ",").alias("labels")


@query(
    _PARTS
    + """select p_partkey from p where kind like 'STANDARD%' and (p_size in (3, 5, 21) or small in (3, 5, 21)) and brand not in ('Brand-11', 'Brand-12')"""
)
def selector_match(spark, sf_dir):
    return _parts(spark, sf_dir).where(lb.matches("labels", "type:prefix=STANDARD, size in (3,5,21), brand notin (Brand-11,Brand-12), !missing, brand")).select("p_partkey")


@query(_PARTS + f", u as (select * from a union select b.* from b where not exists (select 1 from a where a.p_partkey = b.p_partkey and a.name = b.name)) {_SHOWN} u group by 1")
def label_union(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _shown(lb.union(F.col("labels"), F.col("other"))))


@query(_PARTS + f", {_GROUPED}, u as (select p.p_partkey, a.name, a.value from p left join (select a.* from a join ga using (p_partkey, name) join gb using (p_partkey, name) where ga.v = gb.v) a using (p_partkey)) {_SHOWN} u group by 1")
def label_intersect(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _shown(lb.intersect(F.col("labels"), F.col("other"))))


@query(_PARTS + f", {_GROUPED}, u as (select p.p_partkey, a.name, a.value from p left join (select a.* from a join ga using (p_partkey, name) left join gb using (p_partkey, name) where gb.v is null or ga.v <> gb.v) a using (p_partkey)) {_SHOWN} u group by 1")
def label_subtract(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _shown(lb.subtract(F.col("labels"), F.col("other"))))


@query(_PARTS + "select p_partkey, brand, case when p_size::varchar <= small::varchar then p_size::varchar else small::varchar end as size, len(list_distinct([p_size, small]))::int as n_sizes, '' as missing from p")
def label_values(spark, sf_dir):
    p = _parts(spark, sf_dir)
    c = F.col("labels")
    return p.select("p_partkey", lb.value_of(c, "brand").alias("brand"), lb.value_of(c, "size").alias("size"), F.size(lb.values_of(c, "size")).alias("n_sizes"), lb.value_of(c, "missing").alias("missing"))


@query(_PARTS + "select coalesce(x.name, y.name) as name, x.n as left_values, y.n as right_values from (select name, count(distinct value)::int as n from a group by 1) x full join (select name, count(distinct value)::int as n from b group by 1) y on x.name = y.name")
def label_outer_join(spark, sf_dir):
    p = _parts(spark, sf_dir)
    j = lb.outer_join(p.select(F.inline("labels")), p.select(F.inline("other")))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return j.select("name", n("left_values"), n("right_values"))


# ---- fragments --------------------------------------------------------------------------------

_VALID = "f as (select * from fragments where journal is not null and begin_offset is not null and end_offset > begin_offset)"


@query("select journal, begin_offset, end_offset, printf('%016x-%016x-', begin_offset, end_offset) || lower(hex(frag_sum)) || case codec when 'NONE' then '.raw' when 'GZIP' then '.gz' when 'ZSTANDARD' then '.zst' when 'SNAPPY' then '.sz' else '' end as name, codec, coalesce(path_postfix, '') as path_postfix from fragments where begin_offset <= end_offset and frag_sum is not null and codec is not null")
def fragment_names(spark, sf_dir):
    """Names are built and parsed again; what is shown is what was parsed."""
    f = table(spark, sf_dir, "fragments").where("begin_offset <= end_offset and frag_sum is not null and codec is not null")
    name = nm.content_name(F.col("begin_offset"), F.col("end_offset"), F.col("frag_sum"), F.col("codec"))
    g = f.select("journal", name.alias("name"), nm.parse_content_path(nm.content_path(F.lit(None).cast("string"), F.col("path_postfix"), name)).alias("p"))
    return g.select("journal", "p.begin_offset", "p.end_offset", "name", "p.codec", "p.path_postfix")


@query(f"with {_VALID}, d as (select distinct journal, begin_offset, end_offset from f), m as (select *, max(end_offset) over (partition by journal order by begin_offset, end_offset desc rows between unbounded preceding and 1 preceding) as prev from d) select journal, begin_offset, end_offset, greatest(begin_offset, coalesce(prev, begin_offset)) as own_from from m where prev is null or end_offset > prev")
def cover_set(spark, sf_dir):
    return fragments.cover_set(table(spark, sf_dir, "fragments")).select("journal", "begin_offset", "end_offset", "own_from")


_ISLANDS = """m as (select *, case when begin_offset <= max(end_offset) over (partition by journal order by begin_offset, end_offset desc rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from {0}),
n as (select *, sum(fresh) over (partition by journal order by begin_offset, end_offset desc rows unbounded preceding) as island from m),
spans as (select journal, min(begin_offset) as b, max(end_offset) as e from n group by journal, island)"""


@query(f"with {_VALID}, x as (select distinct journal, begin_offset, end_offset from f where codec = 'GZIP'), y as (select distinct journal, begin_offset, end_offset from f where codec <> 'GZIP'), {_ISLANDS.format('y')} select * from x where not exists (select 1 from spans s where s.journal = x.journal and s.b <= x.begin_offset and s.e >= x.end_offset)")
def cover_difference(spark, sf_dir):
    f = table(spark, sf_dir, "fragments").select("journal", "begin_offset", "end_offset", "codec")
    return fragments.cover_difference(f.where("codec = 'GZIP'").drop("codec").distinct(), f.where("codec <> 'GZIP'").drop("codec"))


@query(f"with {_VALID}, y as (select distinct journal, begin_offset, end_offset from f), {_ISLANDS.format('y')} select journal, e as begin_offset, nb as end_offset from (select journal, e, lead(b) over (partition by journal order by b) as nb from spans) where nb is not null")
def fragment_gaps(spark, sf_dir):
    return fragments.gaps(table(spark, sf_dir, "fragments"))


@query("with g as (select *, row_number() over (partition by journal order by begin_offset nulls first, end_offset nulls first, mod_time, frag_sum nulls first, store nulls first) as n from fragments where mod_time <> 0 and mod_time >= 1741100000 and mod_time <= 1741500000 and begin_offset >= 0) select journal, begin_offset, end_offset, mod_time from g where n <= 3")
def fragment_page(spark, sf_dir):
    return fragments.page(table(spark, sf_dir, "fragments"), 1_741_100_000, 1_741_500_000, limit=3).select("journal", "begin_offset", "end_offset", "mod_time")


@query(f"with {_VALID} select journal, min(begin_offset) as first_offset, max(end_offset) as write_head, max(mod_time) as last_mod_time, count(*) as n_fragments, sum((end_offset - begin_offset)::hugeint)::bigint as n_bytes from f group by 1")
def fragment_extent(spark, sf_dir):
    return fragments.extent(table(spark, sf_dir, "fragments")).withColumn("n_bytes", F.col("n_bytes").cast("long"))


@query(f"with r as (select *, case when contains(journal, 'tiny') then 86400 when contains(journal, 'rides') then 0 else 345600 end as retention from fragments) select journal, begin_offset, end_offset, mod_time from r where mod_time > 0 and store is not null and retention > 0 and {NOW} - mod_time >= retention")
def prune_retention(spark, sf_dir):
    r = F.when(F.col("journal").contains("tiny"), 86_400).when(F.col("journal").contains("rides"), 0).otherwise(345_600)
    return fragments.aged_out(table(spark, sf_dir, "fragments"), r, NOW).select("journal", "begin_offset", "end_offset", "mod_time")


@query(f"with {_VALID}, p as (select * from f where mod_time > 0 and store is not null and {NOW} - mod_time >= 345600) select journal, count(*) as n_fragments, sum((end_offset - begin_offset)::hugeint)::bigint as n_bytes, (select count(*) from p where p.journal = f.journal) as n_pruned, coalesce((select sum((end_offset - begin_offset)::hugeint) from p where p.journal = f.journal), 0)::bigint as pruned_bytes from f group by journal")
def prune_totals(spark, sf_dir):
    """What pruning by age would delete of each journal."""
    f = table(spark, sf_dir, "fragments")
    t = fragments.prune_totals(f, fragments.aged_out(f, 345_600, NOW))
    return t.select("journal", "n_fragments", F.col("n_bytes").cast("long").alias("n_bytes"), "n_pruned", F.col("pruned_bytes").cast("long").alias("pruned_bytes"))


@query(f"with {_VALID}, live as (select journal, begin_offset as b, end_offset as e from f where mod_time % 7 = 0) select journal, begin_offset, end_offset, mod_time from f where store is not null and not exists (select 1 from live l where l.journal = f.journal and l.b < f.end_offset and l.e > f.begin_offset)")
def prune_segments(spark, sf_dir):
    f = table(spark, sf_dir, "fragments")
    live = f.where("mod_time % 7 = 0").select("journal", F.col("begin_offset").alias("first_offset"), F.col("end_offset").alias("last_offset"))
    return fragments.prunable(f, live).select("journal", "begin_offset", "end_offset", "mod_time")


_REQUESTS = "r as (select journal, k, case when k = 4 then -1 else (max(end_offset) // 4) * k end as read_offset, case when k = 2 then 1741400000 else 0 end as since from f, range(5) t(k) group by journal, k)"


@query(
    f"""with {_VALID}, {_REQUESTS}, h as (select journal, max(end_offset) as head, min(begin_offset) as first_offset from f group by 1),
q as (select r.journal, read_offset, since, head, first_offset, case when read_offset = -1 then head else read_offset end as pos from r join h using (journal)),
c as (select q.*, f.begin_offset as b, f.end_offset as e, f.mod_time as t, row_number() over (partition by q.journal, read_offset order by case when f.begin_offset <= pos then 0 else 1 end, case when f.begin_offset <= pos then -f.end_offset else f.begin_offset end, case when f.begin_offset <= pos then f.begin_offset else -f.end_offset end, f.mod_time) as n
 from q left join f on f.journal = q.journal and f.end_offset > pos and (f.mod_time = 0 or f.mod_time >= since)),
z as (select *, coalesce(b <= pos, false) as covers, coalesce(b > pos and (pos <= first_offset or (t > 0 and t < {NOW} - 21600)), false) as jumped from c where n = 1)
select journal, read_offset, case when covers then pos when jumped then b end as "offset", case when covers or jumped then b end as begin_offset, case when covers or jumped then e end as end_offset, jumped, head as write_head from z"""
)
def fragment_query(spark, sf_dir):
    """Five reads of each journal: at quarters of it and at its head, one with a lower bound on modification time."""
    f = table(spark, sf_dir, "fragments")
    top = fragments.valid(f).groupBy("journal").agg(F.max("end_offset").alias("top"))
    k = top.select("journal", "top", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    req = k.select("journal", F.when(F.col("k") == 4, -1).otherwise(F.expr("(top div 4) * k")).alias("read_offset"), F.when(F.col("k") == 2, 1_741_400_000).otherwise(0).alias("begin_mod_time"))
    return fragments.query(f, req, now=NOW)


@query("select journal, 'file' as kind, count(*) as n_files, count(*) filter (sha1(content) = lower(hex(frag_sum))) as n_valid, sum(octet_length(content))::bigint as n_bytes from fragment_files group by 1, 2")
def fragment_sums(spark, sf_dir):
    """Files of each journal, and those whose content has the sum it should have."""
    f = table(spark, sf_dir, "fragment_files")
    ok = F.unhex(F.sha1("content")) == F.col("frag_sum")
    return f.groupBy("journal", F.lit("file").alias("kind")).agg(F.count("*").alias("n_files"), F.count_if(ok).alias("n_valid"), F.sum(F.length("content")).alias("n_bytes"))


def _crc_sql(rows: str, poly: int, mask: int, name: str) -> str:
    """Common table expressions: {name}_table by the rule of the reflected polynomial, and {name} (id, crc) of rows (id, data)."""
    table_ = f"{name}_table as (select list(v order by n) as t from (select n, list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, {poly}::ubigint) else c >> 1 end) as v from range(256) x(n)))"
    byte = "('0x' || substr(h, 2 * i + 1, 2))::ubigint"
    fold = f"list_reduce(list_prepend({mask}::ubigint, list_transform(range(strlen(h) // 2), lambda i: {byte})), lambda c, b: xor(t[(xor(c, b) & 255)::bigint + 1], c >> 8))"
    return f"{table_}, {name} as (select id, xor({fold}, {mask}::ubigint) as crc from (select id, hex(data) as h from {rows}), {name}_table)"


_SUMS = f"with files as (select row_number() over () as id, journal, begin_offset, end_offset, content as data from fragment_files), {_crc_sql('files', 0xC96C5795D7870F42, 2**64 - 1, 'c64')}, {_crc_sql('files', 0x82F63B78, 2**32 - 1, 'c32')}"


@query(f"{_SUMS} select journal, begin_offset, end_offset, case when data is not null then printf('%08x%08x', (c64.crc >> 32)::bigint, (c64.crc & 4294967295)::bigint) end as crc64, case when data is not null then c32.crc::bigint end as crc32c from files join c64 using (id) join c32 using (id)")
def fragment_checksums(spark, sf_dir):
    """CRC-64 and CRC-32C of each file."""
    return table(spark, sf_dir, "fragment_files").select("journal", "begin_offset", "end_offset", crc64("content").alias("crc64"), crc32c("content").alias("crc32c"))


_HEADS = f"{_VALID}, e as (select journal, max(end_offset) as reset_to from f group by 1), l as (select journal, max(end_offset) as append_offset from f where mod_time % 3 = 0 group by 1)"


@query(f"with {_HEADS} select journal, append_offset, reset_to from l join e using (journal) where reset_to > append_offset")
def reset_heads(spark, sf_dir):
    f = table(spark, sf_dir, "fragments")
    heads = fragments.valid(f).where("mod_time % 3 = 0").groupBy("journal").agg(F.max("end_offset").alias("append_offset"))
    return fragments.reset_heads(f, heads)


@query(f"with {_HEADS} select journal, reset_to as write_head, append_offset as read_through, reset_to - coalesce(append_offset, 0) as lag from e left join l using (journal)")
def read_lag(spark, sf_dir):
    from tidemark.operators.catalog import lag

    f = fragments.valid(table(spark, sf_dir, "fragments"))
    heads = f.groupBy("journal").agg(F.max("end_offset").alias("write_head"))
    return lag(heads, f.where("mod_time % 3 = 0").groupBy("journal").agg(F.max("end_offset").alias("read_through")))


@query(
    f"""with {_VALID}, d as (select distinct journal, begin_offset, end_offset from f),
m as (select *, max(end_offset) over (partition by journal order by begin_offset, end_offset desc rows between unbounded preceding and 1 preceding) as prev from d) select journal, begin_offset, end_offset from m where prev is null or end_offset > prev"""
)
def merge_remote(spark, sf_dir):
    """The listing of the stores merged with fragments that are not persisted yet."""
    f = table(spark, sf_dir, "fragments")
    return fragments.merge_remote(f.where("store is null"), f.where("store is not null")).select("journal", "begin_offset", "end_offset")


@query("select distinct journal, split_part(journal || ';meta', ';', 1) as stripped, ';meta' as meta, replace(journal, 'tiny-', '') as rewritten, true as valid from fragments where journal is not null")
def journal_names(spark, sf_dir):
    j = table(spark, sf_dir, "fragments").where("journal is not null").select("journal").distinct()
    alias = F.concat("journal", F.lit(";meta"))
    return j.select("journal", nm.strip_meta(alias).alias("stripped"), nm.meta(alias).alias("meta"), nm.rewrite_path(F.col("journal"), "tiny-", "").alias("rewritten"), nm.is_journal(F.col("journal")).alias("valid"))


# ---- applications -----------------------------------------------------------------------------

_GRAMS = """
with w as (select list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') as words from documents where text is not null),
p as (select ['START', 'START'] || words || ['END', 'END'] as padded from w),
g as (select unnest(list_transform(range(2, len(padded)), lambda i: padded[i] || ' ' || padded[i + 1])) as n_gram from p),
c as (select n_gram, count(*) as count from g group by 1)
"""


_FNV_BYTES = "list_reduce(list_prepend(2166136261::bigint, list_transform(range(strlen(n_gram)), lambda i: ('0x' || substr(hex(encode(n_gram)), 2 * i + 1, 2))::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query(f"{_GRAMS} select n_gram, 'ngrams/part-' || lpad(({_FNV_BYTES} % 8)::varchar, 3, '0') as journal, count from c")
def ngram_counts(spark, sf_dir):
    return apps.ngram_counts(table(spark, sf_dir, "documents"), "text", 2, GRAM_JOURNALS)


@query(
    f"""
with w as (select list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda x: x <> '') as words from part where p_name is not null),
p as (select ['START', 'START', 'START'] || words || ['END', 'END', 'END'] as padded from w),
g as (select unnest(list_transform(range(2, len(padded) - 1), lambda i: padded[i] || ' ' || padded[i + 1] || ' ' || padded[i + 2])) as n_gram from p),
c as (select n_gram, count(*) as count from g group by 1)
select n_gram, 'ngrams/part-' || lpad(({_fnv('n_gram')} % 8)::varchar, 3, '0') as journal, count from c"""
)
def ngram_counts_names(spark, sf_dir):
    """Trigrams of part names, which are ASCII: SQL engines agree on their lower case."""
    return apps.ngram_counts(table(spark, sf_dir, "part"), "p_name", 3, GRAM_JOURNALS)


@query(f"{_GRAMS} select n_gram, 'ngrams/part-' || lpad(({_FNV_BYTES} % 8)::varchar, 3, '0') as journal, count from c where n_gram like 'the %'")
def ngram_prefix(spark, sf_dir):
    return apps.with_prefix(ngram_counts(spark, sf_dir), "the ")


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as bike rides between five stations; one in eleven bikes is moved between rides."""
    e = table(spark, sf_dir, "events")
    bike, station = F.col("user_id") % 500, F.col("event_id") * 7 % 11 % 5
    from pyspark.sql import Window

    w = Window.partitionBy("bike_id").orderBy("start_time", "uuid")
    r = e.select(bike.alias("bike_id"), F.col("event_id").alias("uuid"), F.col("ts").alias("start_time"), (F.col("ts") + F.expr("interval 5 minutes")).alias("end_time"), station.alias("end_id"))
    return r.withColumn("start_id", F.when(F.col("uuid") % 11 == 0, (F.col("end_id") + 2) % 5).otherwise(F.coalesce(F.lag("end_id").over(w), F.lit(0).cast("long"))))


_RIDES = """
r0 as (select user_id % 500 as bike_id, event_id as uuid, ts as start_time, ts + interval 5 minutes as end_time, event_id * 7 % 11 % 5 as end_id from events),
r1 as (select *, case when uuid % 11 = 0 then (end_id + 2) % 5 else coalesce(lag(end_id) over (partition by bike_id order by start_time, uuid), 0) end as start_id from r0),
rides as (select * from (select *, row_number() over (partition by bike_id order by start_time desc, uuid desc) as ind from r1) where ind <= 20)
"""


@query(f"with {_RIDES} select bike_id, uuid, start_id, end_id from rides")
def bike_keep_last_n(spark, sf_dir):
    return apps.keep_last(rides(spark, sf_dir), "bike_id", [F.col("start_time").desc(), F.col("uuid").desc()], 20).select("bike_id", "uuid", "start_id", "end_id")


@query(
    f"""with {_RIDES},
walks as (select bike_id, list({{'began': start_time, 'ended': end_time, 'a': start_id, 'z': end_id}} order by start_time desc, uuid desc) as w from rides group by bike_id),
cuts as (select bike_id, w, list_filter(range(2, len(w) + 1), lambda i: w[i].z <> w[i - 1].a or w[i].z = w[1].z) as stops from walks),
legs as (select bike_id, w[1].z as home, w[1].ended as last_ts, w[:coalesce(stops[1] - 1, len(w))] as w from cuts)
select bike_id, array_to_string(list_append(list_reverse(list_transform(w, lambda x: x.a)), home), '>') as stations, w[len(w)].began as first_ts, last_ts
from legs where len(w) > 2 and len(list_filter(w, lambda x: x.a = home)) = 1"""
)
def bike_cycles(spark, sf_dir):
    c = apps.bike_cycles(rides(spark, sf_dir), 20, 2)
    return c.select("bike_id", F.array_join(F.transform("steps", lambda s: s["station"].cast("string")), ">").alias("stations"), F.element_at("steps", 1)["ts"].alias("first_ts"), F.element_at("steps", -1)["ts"].alias("last_ts"))


_CHUNKS = """with n as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq_no, l_partkey || '|' || l_suppkey || '|' || l_linenumber as data from lineitem),
kept as (select * from n where id % 7 <> 0 or seq_no <> 2),
files as (select id, string_agg(data, '' order by seq_no)::blob as data, max(seq_no) + (id % 5 <> 0)::int as seq_no, max(seq_no) > count(*) as torn from kept group by id)"""


@query(f"{_CHUNKS}, {_crc_sql('files', 0xC96C5795D7870F42, 2**64 - 1, 'c64')} select id, seq_no::bigint as seq_no, printf('%08x%08x', (crc >> 32)::bigint, (crc & 4294967295)::bigint) as value, case when torn then 'out of order' when id % 5 = 0 then 'incomplete' else 'complete' end as state from files join c64 using (id)")
def stream_sums(spark, sf_dir):
    """The lines of each order as chunks of a stream, ended by an empty chunk; CRC-64 in order. Some lack a chunk, some their end."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").withColumn("seq_no", F.row_number().over(w).cast("long")).where("l_orderkey % 7 <> 0 or seq_no <> 2")
    chunks = li.select(F.col("l_orderkey").alias("id"), "seq_no", F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber").cast("binary").alias("data"))
    ends = chunks.where("id % 5 <> 0").groupBy("id").agg((F.max("seq_no") + 1).alias("seq_no")).withColumn("data", F.lit(b""))
    return apps.stream_sums(chunks.unionByName(ends))


@query(
    """with s as (select distinct log, author, seq_no, first_offset, last_offset from recorded_ops where log is not null and author is not null and seq_no is not null),
m as (select *, case when seq_no <= max(seq_no) over (partition by log, author order by seq_no rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from s),
n as (select *, sum(fresh) over (partition by log, author order by seq_no rows unbounded preceding) as run from m)
select log, author, min(seq_no) as first_seq_no, max(seq_no) as last_seq_no from n group by log, author, run"""
)
def recovery_segments(spark, sf_dir):
    """Runs of operations of one author in each recovery log."""
    ops = table(spark, sf_dir, "recorded_ops").select("log", "author", F.col("seq_no").alias("first_seq_no"), F.col("seq_no").alias("last_seq_no"), "first_offset", "last_offset")
    return apps.reduce_segments(ops).select("log", "author", "first_seq_no", "last_seq_no")
