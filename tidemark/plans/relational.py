"""The SQL shapes that stores and sample applications use: set operations, comma joins, windows, recursion, upserts.

Each is one text run by Spark SQL on temporary views; the same text, where both dialects allow it,
is its oracle. A recursion over a table is none: Spark ends one with an error at 1,000,000 rows. Compound set operations are parenthesised from left to right, as INTERSECT would
bind tighter otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.apps import keep_last
from tidemark.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Run text with {name} standing for the tables; no views are left behind."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def shape(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text, *tables)
    SQL[name] = oracle or text.format(**{t: t for t in tables})


shape(
    "set_ops_left_to_right",
    """((select o_custkey as k from {orders} where o_orderpriority = '1-URGENT' union select c_custkey from {customer} where c_nationkey < 12)
       intersect select o_custkey from {orders} where o_totalprice > 20000) except select c_custkey from {customer} where c_acctbal < 0""",
    "orders",
    "customer",
)
shape(
    "set_ops_union_all",
    """(select o_custkey % 17 as k, o_orderpriority as p from {orders} union all select c_custkey % 17, c_mktsegment from {customer}) except select l_partkey % 17, l_returnflag from {lineitem}""",
    "orders",
    "customer",
    "lineitem",
)
shape(
    "comma_join_in_lists",
    """select c_custkey + o_orderkey as ck, n_nationkey * 993 + r_regionkey as nr, s_suppkey, l_linenumber
       from {customer} c, {orders} o, {lineitem} l, {supplier} s, {nation} n, {region} r
       where c_custkey = o_custkey and 2 < l_linenumber and o_orderkey = l_orderkey and l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
         and (r_regionkey in (1, 3) or n_nationkey in (2, 4, 7, 19)) and not (l_returnflag = 'R' and (l_linestatus = 'F' or l_discount in (0.01, 0.07)))""",
    "customer",
    "orders",
    "lineitem",
    "supplier",
    "nation",
    "region",
)
# NOT IN under an OR would be a nested loop; the same meaning, nulls included, as counts and a hash join.
shape(
    "not_in_with_or",
    """with big as (select l_partkey from {lineitem} where l_quantity > 45), facts as (select count(*) as n, count(*) - count(l_partkey) as nulls from big)
       select p_partkey, case when exists (select 1 from {part} q where q.p_size = 50 and q.p_brand = p.p_brand) then 1 else 0 end as big_brand from {part} p
       where p_size = 1 or (select n from facts) = 0 or (p_partkey is not null and (select nulls from facts) = 0 and not exists (select 1 from big where l_partkey = p_partkey))""",
    "part",
    "lineitem",
    oracle="""select p_partkey, case when p_brand in (select p_brand from part where p_size = 50) then 1 else 0 end as big_brand from part
       where p_size = 1 or p_partkey not in (select l_partkey from lineitem where l_quantity > 45)""",
)
shape(
    "window_totals",
    """select event_type, user_id, n, count(*) over (partition by event_type) - 1 as others, cast(sum(case when n > 3 then 1 else 0 end) over (partition by event_type) as bigint) as busy
       from (select event_type, user_id, count(*) as n from {events} group by event_type, user_id) t""",
    "events",
)
shape("topk", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25", "orders")
shape("keyed_running_sum", "select event_id, user_id, cast(sum(event_id % 10) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as running from {events}", "events")
shape("recursive_generator", "with recursive g(n) as (select 1 union all select n + 1 from g where n < 90) select n, n * n as square from g")
shape(
    "recursive_walk",
    """with recursive chain(order_key, depth, part_key) as (
         select l_orderkey, 1, l_partkey from {lineitem} where l_linenumber = 1
         union all
         select l.l_orderkey, c.depth + 1, l.l_partkey from {lineitem} l join chain c on l.l_orderkey = c.order_key and l.l_linenumber = c.depth + 1)
       select order_key, max(depth) as depth, max(part_key) as top_part from chain group by order_key""",
    "lineitem",
)
shape(
    "left_join_lookup",
    """select n_name, r_name, count(c_custkey) as customers, count(s_suppkey) as suppliers from {nation} join {region} on n_regionkey = r_regionkey
       left join {customer} on c_nationkey = n_nationkey and c_acctbal > 5000 left join {supplier} on s_nationkey = n_nationkey and s_acctbal < 0 group by n_name, r_name""",
    "nation",
    "region",
    "customer",
    "supplier",
)
shape(
    "multi_source_join",
    """select e.event_type, c_mktsegment, count(*) as n, cast(sum(e.event_id) as bigint) as ids from {events} e join {customer} c on e.user_id = c.c_custkey group by e.event_type, c_mktsegment""",
    "events",
    "customer",
)
shape(
    "json_fields",
    "select event_id, cast(get_json_object(props, '$.k') as int) as k, to_json(named_struct('uuid', event_id, 'record', event_type)) as wrapped from {events}",
    "events",
    oracle="""select event_id, cast(json_extract_string(props, '$.k') as int) as k, '{"uuid":' || event_id || ',"record":"' || event_type || '"}' as wrapped from events""",
)
shape(
    "base64_keys",
    "select c_custkey, base64(cast(c_name as binary)) as key64, cast(unbase64(base64(cast(c_name as binary))) as string) as key from {customer}",
    "customer",
    oracle="select c_custkey, to_base64(encode(c_name)) as key64, c_name as key from customer",
)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, unless it is an error, which deletes."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.col("event_id")).alias("r")).select("user_id", "r.*")
    return last.where("event_type <> 'error'")


def recursive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the lines of each order go on from 1 without a gap, and the largest part on the way.

    What the recursion of the oracle comes to, in one pass: line n is reached if it is the n-th number from 1 on.
    A null order is equal to none, so that its walk ends at line 1.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_partkey").where("l_linenumber = 1 or l_linenumber > 1 and l_orderkey is not null")
    nth = F.dense_rank().over(Window.partitionBy("order_key").orderBy("l_linenumber"))
    return lines.withColumn("nth", nth).where("l_linenumber = nth").groupBy("order_key").agg(F.max("l_linenumber").alias("depth"), F.max("l_partkey").alias("top_part"))


def running_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest events of each user."""
    return keep_last(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


QUERIES |= {"recursive_walk": recursive_walk, "upsert_latest": upsert_latest, "keep_last_events": running_keep_last}
SQL |= {
    "upsert_latest": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1 having arg_max(event_type, event_id) <> 'error'",
    "keep_last_events": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 5",
}
