"""Queries of the catalog operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.operators import catalog
from tidemark.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _journals(spark, sf_dir):
    """The journals of fragments, labelled by their first path component and whether they are tiny."""
    j = table(spark, sf_dir, "fragments").where("journal is not null").select(F.col("journal").alias("name")).distinct()
    owner = F.substring_index("name", "/", 1)
    return j.select("name", lb.label_set(lb.label("owner", owner), lb.label("size-class", F.when(F.col("name").contains("tiny"), "tiny").otherwise("plain"))).alias("labels"))


_NAMES = "j as (select distinct journal as name, split_part(journal, '/', 1) as owner from fragments where journal is not null)"


@query(f"with {_NAMES} select name, owner from j where owner in ('kestrin', 'tindale') and not contains(name, 'tiny') and name like '%/part-%' and name like '%i%'")
def list_journals(spark, sf_dir):
    j = catalog.list_journals(_journals(spark, sf_dir), "owner in (kestrin, tindale), size-class != tiny")
    return j.where(F.col("name").contains("i")).select("name", lb.value_of(F.col("labels"), "owner").alias("owner"))


@query(f"with {_NAMES} select name from j where starts_with(name, 'tindale/') and contains(name, 'tiny')")
def list_journals_prefix(spark, sf_dir):
    """A prefix of names, within what the caller's claims allow."""
    return catalog.list_journals(_journals(spark, sf_dir), "prefix:prefix = tindale/", claims="size-class=tiny").select("name")


def _assignments(spark, sf_dir):
    """Suppliers of a part as the members an item is assigned to; the nation is the zone."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(s, "l_suppkey").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").cast("string").alias("member"), F.col("s_nationkey").alias("zone"), (F.col("l_suppkey") % 3).cast("int").alias("slot"))


_ASSIGNED = "a as (select l_partkey as item, l_suppkey::varchar as member, s_nationkey as zone, (l_suppkey % 3)::int as slot from (select distinct l_partkey, l_suppkey from lineitem) join supplier on s_suppkey = l_suppkey)"


@query(f"with {_ASSIGNED}, i as (select p_partkey as item from part) select item, coalesce(string_agg(slot || ':' || member, ',' order by slot, member), '') as route from i left join a using (item) group by 1")
def left_join_routes(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    r = catalog.with_assignments(items, _assignments(spark, sf_dir), "item")
    return r.select("item", F.array_join(F.transform("route", lambda x: F.concat_ws(":", x["slot"].cast("string"), x["member"])), ",").alias("route"))


@query(f"with {_ASSIGNED} select zone, count(*) as slots, count(*) filter (slot = 0) as primaries, count(distinct member) as members, count(distinct item) as items from a group by 1")
def zone_counts(spark, sf_dir):
    return catalog.zone_counts(_assignments(spark, sf_dir))


@query(f"with {_ASSIGNED}, c as (select item, member from a where slot < 2), d as (select item, member from a where slot > 0) select coalesce(c.item, d.item) as item, coalesce(c.member, d.member) as member, case when c.item is null then 'added' when d.item is null then 'removed' else 'unchanged' end as change from c full join d on c.item = d.item and c.member = d.member")
def assignment_diff(spark, sf_dir):
    a = _assignments(spark, sf_dir)
    return catalog.changes(a.where("slot < 2"), a.where("slot > 0"), ["item", "member"])


@query(
    f"with {_ASSIGNED}, r as (select item, (zone % 5)::int as code, case when zone % 5 = 4 then 'failed ' || member end as error, slot, member from a) select item, max(code) as code, coalesce(string_agg(error, ';' order by slot, error), '') as errors, case max(code) when 0 then 'IDLE' when 1 then 'BACKFILL' when 2 then 'STANDBY' when 3 then 'PRIMARY' else 'FAILED' end as status from r group by 1"
)
def status_reduce(spark, sf_dir):
    a = _assignments(spark, sf_dir)
    code = (F.col("zone") % 5).cast("int")
    r = a.select("item", "slot", code.alias("code"), F.when(code == 4, F.array(F.concat(F.lit("failed "), "member"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return catalog.reduce_status(r, "item").select("item", "code", F.array_join("errors", ";").alias("errors"), "status")


@query(
    """with m as (select s_suppkey as member, s_nationkey * 1000 + s_suppkey as create_revision, (s_suppkey % 9 + 1)::int as item_limit, s_suppkey % 4 = 0 as exiting from supplier),
t as (select sum(item_limit) as total from m), e as (select *, sum(item_limit) over (order by create_revision, member) as gone from m where exiting)
select member, exiting, total - gone >= total * 9 // 10 as can_leave from e, t union all select member, exiting, false from m where not exiting"""
)
def shed_capacity(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), (F.col("s_nationkey") * 1000 + F.col("s_suppkey")).alias("create_revision"), (F.col("s_suppkey") % 9 + 1).cast("int").alias("item_limit"), (F.col("s_suppkey") % 4 == 0).alias("exiting"))
    need = m.agg(F.expr("sum(item_limit) * 9 div 10").alias("n"))
    return catalog.shed_capacity(m, need.scalar()).select("member", "exiting", "can_leave")


@query("select p_partkey, (p_size * least(p_partkey % 7, 5) + 4) // 5 as share from part")
def scale_and_round(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", catalog.scale_and_round(F.col("p_size").cast("long"), F.col("p_partkey") % 7, F.lit(5).cast("long")).alias("share"))


_UPDATED = """with cat as (select c_custkey as name, c_custkey % 50 + 1 as revision, c_mktsegment as spec from customer where c_custkey % 3 <> 0),
u as (select c_custkey as name, case when c_custkey % 3 = 0 then 0 when c_custkey % 2 = 0 then -1 else c_custkey % 50 + 1 end as expect, case when c_custkey % 10 = 1 then null else 'new' end as spec from customer where c_custkey % 5 < 2),
top as (select max(revision) as top from cat)
select coalesce(cat.name, u.name) as name, case when u.name is null then revision else top + 1 end as revision, case when u.name is null then cat.spec else u.spec end as spec from cat full join u on cat.name = u.name, top where u.name is null or u.spec is not null"""


@query(_UPDATED)
def apply_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "name")
    rev = F.col("name") % 50 + 1
    cat = c.where("name % 3 <> 0").select("name", rev.alias("revision"), F.col("c_mktsegment").alias("spec"))
    expect = F.when(F.col("name") % 3 == 0, 0).when(F.col("name") % 2 == 0, -1).otherwise(rev)
    new = F.when(F.col("name") % 10 == 1, F.lit(None).cast("string")).otherwise("new")
    return catalog.apply_changes(cat, c.where("name % 5 < 2").select("name", expect.alias("expect_revision"), new.alias("spec")))


def _specs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 4).cast("int").alias("replication"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("tier"))
    b = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 3).cast("int").alias("replication"), F.col("c_mktsegment").alias("tier"))
    return a, b


_SPECS = "with a as (select c_custkey as name, (c_custkey % 4)::int as replication, case when c_custkey % 3 = 0 then '' else c_mktsegment end as tier from customer), b as (select c_custkey as name, (c_custkey % 3)::int as replication, c_mktsegment as tier from customer where c_custkey % 2 = 0)"


@query(f"{_SPECS} select name, coalesce(nullif(a.replication, 0), b.replication, a.replication) as replication, coalesce(nullif(a.tier, ''), b.tier, a.tier) as tier from a left join b using (name)")
def spec_union(spark, sf_dir):
    return catalog.union_specs(*_specs(spark, sf_dir), "name", ["replication", "tier"])


@query(f"{_SPECS} select name, case when a.replication = b.replication then a.replication end as replication, case when a.tier = b.tier then a.tier end as tier from a join b using (name)")
def spec_intersect(spark, sf_dir):
    return catalog.intersect_specs(*_specs(spark, sf_dir), "name", ["replication", "tier"])


@query(f"{_SPECS} select name, case when a.replication <> b.replication then a.replication end as replication, case when a.tier <> b.tier then a.tier end as tier from a join b using (name)")
def spec_subtract(spark, sf_dir):
    return catalog.subtract_specs(*_specs(spark, sf_dir), "name", ["replication", "tier"])


_TREE = "t as (select split_part(journal, '/', 1) as parent, journal as name, max(codec) as codec, max(store) as store from fragments where journal is not null group by 1, 2), h as (select parent, case when count(distinct codec) = 1 and count(codec) = count(*) then min(codec) end as codec, case when count(distinct store) = 1 and count(store) = count(*) then min(store) end as store, count(*) as children from t group by 1)"


def _tree(spark, sf_dir):
    f = table(spark, sf_dir, "fragments").where("journal is not null")
    return f.groupBy(F.col("journal").alias("name")).agg(F.max("codec").alias("codec"), F.max("store").alias("store"))


@query(f"with {_TREE} select * from h")
def spec_hoist(spark, sf_dir):
    return catalog.hoist(_tree(spark, sf_dir), F.substring_index("name", "/", 1), ["codec", "store"])


@query(f"with {_TREE} select name, codec, store from t")
def spec_push_down(spark, sf_dir):
    """Children without what their parent holds, completed from it again."""
    t = _tree(spark, sf_dir)
    parent = F.substring_index("name", "/", 1)
    h = catalog.hoist(t, parent, ["codec", "store"])
    p = h.select(F.col("parent").alias("_q"), F.col("codec").alias("_c"), F.col("store").alias("_s"))
    bare = t.withColumn("_q", parent).join(p, "_q").select("name", F.when(~F.col("codec").eqNullSafe(F.col("_c")), F.col("codec")).alias("codec"), F.when(~F.col("store").eqNullSafe(F.col("_s")), F.col("store")).alias("store"))
    return catalog.push_down(bare, h, parent, ["codec", "store"])


def _shards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("shard-"), F.col("o_custkey").cast("string")).alias("id"))
    return o.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("sources"))  # five values at most


@query("select source as journal, string_agg(id, ',' order by id) as shards from (select distinct 'shard-' || o_custkey as id, o_orderpriority as source from orders) group by 1")
def shards_of_journals(spark, sf_dir):
    return catalog.shards_of_journals(_shards(spark, sf_dir)).select("journal", F.array_join("shards", ",").alias("shards"))


@query("select distinct 'shard-' || o_custkey as id, o_orderpriority as source from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def missing_references(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).where("name < '4'").distinct()
    return catalog.missing_references(_shards(spark, sf_dir), known)


@query("select 'shard-' || o_custkey as id, count(*) as n_orders from orders where ('shard-' || o_custkey) >= 'shard-5' and ('shard-' || o_custkey) < 'shard-7' group by 1")
def list_shards(spark, sf_dir):
    """Shards by id prefix, through the meta-label id."""
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("shard-"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count("*").alias("n_orders"))
    specs = o.withColumn("labels", F.array().cast(lb.LABELS))
    return catalog.list_shards(specs, "id:prefix in (shard-5, shard-6)").select("id", "n_orders")


@query("select kv_key, kv_value, mod_revision from keyspace_kvs where kv_key >= '/kestrin/' and kv_key < '/pinnock/' and kv_key like '%/items/%'")
def keyspace_range(spark, sf_dir):
    """Range and infix of keys; the bounds reach the Parquet scan."""
    k = table(spark, sf_dir, "keyspace_kvs")
    return k.where((F.col("kv_key") >= "/kestrin/") & (F.col("kv_key") < "/pinnock/") & F.col("kv_key").contains("/items/")).select("kv_key", "kv_value", "mod_revision")


@query("select snapshot_id, kv_key, max(mod_revision) as mod_revision from keyspace_kvs where starts_with(kv_key, '/tindale/') group by 1, 2")
def keyspace_prefixed(spark, sf_dir):
    return table(spark, sf_dir, "keyspace_kvs").where(F.col("kv_key").startswith("/tindale/")).groupBy("snapshot_id", "kv_key").agg(F.max("mod_revision").alias("mod_revision"))


@query(f"""with {_ASSIGNED}, i as (select p_partkey as item from part),
p as (select item, arg_min(member, member) as primary_ from a where slot = 0 group by 1),
m as (select item, member from (select *, row_number() over (partition by item order by case when zone = 7 then 0 else 1 end, slot, member) as n from a) where n = 1)
select item, case when member is null then 'NOT_ASSIGNED' when primary_ is null then 'NO_PRIMARY' else 'OK' end as status, primary_ as "primary", member from i left join p using (item) left join m using (item)""")
def resolve_routes(spark, sf_dir):
    """Who serves each part, for a reader in zone 7."""
    return catalog.resolve(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), _assignments(spark, sf_dir), "item", near=7)


@query(f"{_SPECS}, p as (select name, nullif(replication, 0) as replication, case when name % 8 = 0 then tier end as tier from b), x as (select name + 100000 as name, 9 as replication, 'new' as tier from b where name % 10 = 0), u as (select * from p union all select * from x) select coalesce(a.name, u.name) as name, coalesce(u.replication, a.replication) as replication, coalesce(u.tier, a.tier) as tier, u.name is null as delete from a full join u on a.name = u.name")
def spec_patch(spark, sf_dir):
    """A tree patched by changed and new rows; what no patch names is marked for deletion."""
    a, b = _specs(spark, sf_dir)
    changed = b.select("name", F.nullif("replication", F.lit(0)).alias("replication"), F.when(F.col("name") % 8 == 0, F.col("tier")).alias("tier"))
    new = b.where("name % 10 = 0").select((F.col("name") + 100000).alias("name"), F.lit(9).alias("replication"), F.lit("new").alias("tier"))
    return catalog.mark_unpatched(catalog.patch(a, changed.unionByName(new), "name", ["replication", "tier"]))


@query(_UPDATED.replace("top as (", "nr as (select name, (row_number() over (order by name) - 1) // 50 as batch from u), top as (").replace("else top + 1 end", "else top + 1 + (select batch from nr where nr.name = u.name) end"))
def apply_in_batches(spark, sf_dir):
    """The same changes in transactions of fifty."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "name")
    rev = F.col("name") % 50 + 1
    cat = c.where("name % 3 <> 0").select("name", rev.alias("revision"), F.col("c_mktsegment").alias("spec"))
    expect = F.when(F.col("name") % 3 == 0, 0).when(F.col("name") % 2 == 0, -1).otherwise(rev)
    new = F.when(F.col("name") % 10 == 1, F.lit(None).cast("string")).otherwise("new")
    return catalog.apply_in_batches(cat, c.where("name % 5 < 2").select("name", expect.alias("expect_revision"), new.alias("spec")), 50)


def _crc_of_keys() -> str:
    from tidemark.plans.journals import _crc_sql

    keys = "keys as (select 1 as id, ((select string_agg(s_name, chr(10) order by s_name) from supplier) || chr(10) || chr(10) || (select string_agg(p_partkey::varchar, chr(10) order by p_partkey::varchar) from part))::blob as data)"
    return f"with {keys}, {_crc_sql('keys', 0xC96C5795D7870F42, 2**64 - 1, 'c64')} select printf('%08x%08x', (crc >> 32)::bigint, (crc & 4294967295)::bigint) as hash from c64"


@query(_crc_of_keys())
def network_hash(spark, sf_dir):
    return catalog.network_hash(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")), table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key")))


@query("select p_partkey::varchar as item, (p_size % 3 + 1)::bigint as replicas, p_size % 3 > 0 as spread, true as within_limits from part")
def allocation(spark, sf_dir):
    """Parts assigned to suppliers as members: each as often as asked for, over two zones where replicated, within limits."""
    from tidemark.operators.allocator import allocate_frame

    parts = table(spark, sf_dir, "part")
    items = parts.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 3 + 1).cast("int").alias("replication"))
    limit = 6 * parts.count() // table(spark, sf_dir, "supplier").count() + 1
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_nationkey") % 5).cast("string").alias("zone"), F.lit(limit).alias("limit"), F.lit(False).alias("exiting"))
    got = allocate_frame(items, members, network=100).join(members.select(F.col("id").alias("member"), "zone", "limit"), "member")
    within = got.groupBy("member", "limit").agg(F.count("*").alias("n")).agg(F.min(F.col("n") <= F.col("limit")).alias("ok"))
    per = got.groupBy("item").agg(F.count_distinct("member").alias("replicas"), F.count_distinct("zone").alias("zones"))
    return per.select("item", "replicas", (F.col("zones") > 1).alias("spread"), within.scalar().alias("within_limits"))


@query(f"with {_ASSIGNED}, c as (select item, member from a where slot < 2), d as (select item, member from a where slot > 0), s as (select coalesce(c.item, d.item) as item, coalesce(c.member, d.member) as member, case when c.item is null then 'add' else 'remove' end as step from c full join d on c.item = d.item and c.member = d.member where c.item is null or d.item is null) select *, row_number() over (partition by item order by step, member)::int as at from s")
def convergence(spark, sf_dir):
    """The steps from one assignment to another."""
    from tidemark.operators.allocator import converge_frame

    a = _assignments(spark, sf_dir)
    return converge_frame(a.where("slot < 2"), a.where("slot > 0"))


@query("select s_suppkey, case when s_suppkey % 6 = 5 then null else s_suppkey % 6 end as flags, coalesce(s_suppkey % 6 in (0, 1, 4, 5), true) as readable, coalesce(s_suppkey % 6 in (0, 2, 4, 5), true) as writable from supplier")
def may_read_write(spark, sf_dir):
    flags = F.nullif(F.col("s_suppkey") % 6, F.lit(5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", flags.alias("flags"), catalog.may_read(flags).alias("readable"), catalog.may_write(flags).alias("writable"))


@query("select p_partkey, 'Brand' || (p_partkey % 3) as set_brand, 2 as n_sizes, false as has_type from part")
def label_changes(spark, sf_dir):
    """Labels set, added and removed."""
    from tidemark.plans.journals import _parts

    c = lb.remove(lb.add_value(lb.remove(lb.set_value(F.col("labels"), "brand", F.concat(F.lit("Brand"), (F.col("p_partkey") % 3).cast("string"))), "size"), "size", "a"), "type")
    d = _parts(spark, sf_dir).withColumn("labels", lb.add_value(c, "size", "b"))
    return d.select("p_partkey", lb.value_of(F.col("labels"), "brand").alias("set_brand"), F.size(lb.values_of(F.col("labels"), "size")).alias("n_sizes"), F.array_contains(lb.names(F.col("labels")), "type").alias("has_type"))


@query("select * from (values ('aa=1,bb in (2,3)', 'bb in (2,3),aa=1'), ('xx,yy!=4,!zz', 'yy!=4 , xx, !zz'), ('nn:prefix=q,kk notin (5,6)', 'kk notin (6,5,6), nn:prefix = q')) t(shown, given)")
def selector_strings(spark, sf_dir):
    given = ["bb in (2,3),aa=1", "yy!=4 , xx, !zz", "kk notin (6,5,6), nn:prefix = q"]
    return spark.createDataFrame([(str(lb.parse_selector(g)), g) for g in given], "shown string, given string")
