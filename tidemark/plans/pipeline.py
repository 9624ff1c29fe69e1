"""Queries of the general data-processing problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.changefeed import live_files, live_segments
from tidemark.operators.compaction import consolidate
from tidemark.operators.dedup import surplus_copies
from tidemark.operators.history import snapshot_history
from tidemark.operators.intervals import coverage
from tidemark.plans.tables import fragment_files, table
from tidemark.session import work_path


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = snapshot_history(table(spark, sf_dir, "keyspace_headers"), table(spark, sf_dir, "keyspace_kvs"))
    return versions.select("cluster_id", "kv_key", "valid_from_rev", "valid_to_rev")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_copies(table(spark, sf_dir, "recorded_ops"), ["log", "author", "seq_no"], "first_offset", "delivery_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "fragments"), "journal", "begin_offset", "end_offset")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(fragment_files(spark, sf_dir), work_path(spark, "compacted")).select("journal", "record_begin")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(table(spark, sf_dir, "recorded_ops"), table(spark, sf_dir, "log_hints"))


def recovery_live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_segments(table(spark, sf_dir, "recorded_ops"), table(spark, sf_dir, "log_hints"))


QUERIES = {"recovery_live_segments": recovery_live_segments, "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}

_REPLAY = """
with recursive cand as materialized (
  select * from (select log, seq_no, checksum, next_checksum, op_create, op_link, op_unlink, op_write,
                 row_number() over (partition by log, seq_no, checksum order by first_offset nulls last, delivery_id) as rn
                 from recorded_ops where log is not null and seq_no is not null and checksum is not null) where rn = 1),
walk as (
  select distinct log, first_seq_no as s0, first_checksum as c0, first_seq_no as seq_no, first_checksum as checksum from log_hints
  union all
  select w.log, w.s0, w.c0, w.seq_no + 1, c.next_checksum from walk w join cand c on c.log = w.log and c.seq_no = w.seq_no and c.checksum = w.checksum),
done as (
  select w.log, w.s0, w.c0, c.seq_no, op_create is not null or op_link is not null as linked, op_unlink is not null as unlinked,
         case when op_create is not null then c.seq_no else coalesce(op_link.fnode, op_unlink.fnode, op_write.fnode) end as fnode,
         coalesce(op_create.path, op_link.path, op_unlink.path) as path
  from walk w join cand c on c.log = w.log and c.seq_no = w.seq_no and c.checksum = w.checksum),
"""

SQL = {
    "recovery_live_segments": _REPLAY
    + """live as (select distinct log, s0, c0, fnode from (select log, s0, c0, fnode, path, arg_max(linked, seq_no) as live from done where (linked or unlinked) and path is not null group by all) where live),
runs as (select log, s0, c0, fnode, seq_no, seq_no - row_number() over (partition by log, s0, c0, fnode order by seq_no) as run from done semi join live using (log, s0, c0, fnode))
select log, fnode, min(seq_no) as first_seq_no, max(seq_no) as last_seq_no from runs group by log, s0, c0, fnode, run
""",
    "p1_found": """
with heads as (select distinct snapshot_id, root, cluster_id, revision, key_count from keyspace_headers),
kv as (select distinct snapshot_id, kv_key, kv_value, create_revision, mod_revision from keyspace_kvs where kv_value is not null and kv_key is not null),
cnt as (select snapshot_id, count(distinct kv_key) as n from kv group by snapshot_id),
complete as (select distinct cluster_id, root, revision from heads left join cnt using (snapshot_id) where coalesce(n, 0) = key_count),
st as (select distinct h.cluster_id, h.root, kv_key, h.revision, create_revision, kv_value, mod_revision from kv join heads h using (snapshot_id)),
mark as (select *, case when lag(create_revision) over w = create_revision and lag(kv_value) over w = kv_value then 0 else 1 end as new_run
         from st window w as (partition by cluster_id, kv_key order by revision, mod_revision)),
num as (select *, sum(new_run) over (partition by cluster_id, kv_key order by revision, mod_revision rows unbounded preceding) as run from mark),
runs as (select cluster_id, root, kv_key, run, min(mod_revision) as f, max(revision) as last_rev from num group by cluster_id, root, kv_key, run),
gone as (select r.cluster_id, r.kv_key, r.run, min(c.revision) as g
         from runs r join complete c on c.cluster_id = r.cluster_id and c.root = r.root and c.revision > r.last_rev
         where not exists (select 1 from st s where s.cluster_id = r.cluster_id and s.root = r.root and s.kv_key = r.kv_key and s.revision = c.revision)
         group by r.cluster_id, r.kv_key, r.run)
select cluster_id, kv_key, f as valid_from_rev, coalesce(least(lead(f) over (partition by cluster_id, kv_key order by run), g), -1) as valid_to_rev
from runs left join gone using (cluster_id, kv_key, run)
""",
    "p2_found": """
select delivery_id from (
  select delivery_id, row_number() over (partition by log, author, seq_no order by first_offset nulls last, delivery_id) as rn
  from recorded_ops where log is not null and author is not null and seq_no is not null) where rn > 1
""",
    "p3_found": """
with f as (select distinct journal, begin_offset as b, end_offset as e from fragments where journal is not null and end_offset > begin_offset),
m as (select *, case when b <= max(e) over (partition by journal order by b, e desc rows between unbounded preceding and 1 preceding) then 0 else 1 end as new_span from f),
n as (select *, sum(new_span) over (partition by journal order by b, e desc rows unbounded preceding) as span from m),
s as (select journal, min(b) as b, max(e) as e from n group by journal, span)
select journal, 'span' as kind, b as begin_offset, e as end_offset from s
union all
select journal, 'gap', e, nb from (select journal, e, lead(b) over (partition by journal order by b) as nb from s) where nb is not null
""",
    "p4_found": """
with v as materialized (select distinct journal, begin_offset, content from fragment_files where sha1(content) = lower(hex(frag_sum)) and journal is not null and begin_offset is not null),
s as (select journal, begin_offset, string_split(decode(content), chr(10)) as parts from v),
u as (select journal, begin_offset, parts, unnest(range(1, len(parts) + 1)) as i from s)
select distinct journal, begin_offset + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x) + 1)), 0)::bigint as record_begin
from u where i < len(parts) or strlen(parts[i]) > 0
""",
    "p5_found": _REPLAY
    + """paths as (select log, s0, c0, fnode, path, arg_max(linked, seq_no) as live from done where (linked or unlinked) and path is not null group by all),
named as (select log, s0, c0, fnode, max(seq_no) as last_seq_no from done where fnode is not null group by all)
select log, path, fnode, last_seq_no from paths join named using (log, s0, c0, fnode) where live
""",
}
