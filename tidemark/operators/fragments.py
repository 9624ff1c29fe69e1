"""Algebra over fragment manifests: journal, begin_offset, end_offset, ... one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import coverage, quantile_shards, running_max_before


def valid(df: DataFrame) -> DataFrame:
    return df.where("journal is not null and begin_offset is not null and end_offset > begin_offset")


def cover_set(df: DataFrame) -> DataFrame:
    """Fragments that lie in no other fragment of their journal; of equal ones one is kept. Adds own_from.

    A survivor owns the bytes [own_from, end_offset): what no fragment before it holds.
    """
    one = valid(df).dropDuplicates(["journal", "begin_offset", "end_offset"])
    before = running_max_before(quantile_shards(one, "journal", "begin_offset"), "journal", "begin_offset", "end_offset", "_before", F.col("shard"))
    kept = before.where(F.col("end_offset") > F.coalesce("_before", F.lit(-(2**63))))
    return kept.withColumn("own_from", F.greatest("begin_offset", F.coalesce("_before", "begin_offset"))).drop("_before", "shard")


def _reach(rows: DataFrame, spans: DataFrame, position: Column) -> DataFrame:
    """Adds `_reach`: the furthest end among the spans (journal, b, e) of its journal that begin at or before a row's position.

    Spans are disjoint, so that is the end of the last of them. Both sides are sorted together
    within shards of about 20,000 rows, and one row a shard carries the furthest end over:
    no row meets more than its neighbours, as it would in a range join.
    """
    left = rows.select("journal", position.alias("_p"), F.struct(*rows.columns).alias("_row"))
    none = F.lit(None)
    both = left.withColumn("_e", none.cast("long")).unionByName(spans.select("journal", F.col("b").alias("_p"), none.cast(left.schema["_row"].dataType).alias("_row"), F.col("e").alias("_e")))
    d = quantile_shards(both, "journal", "_p", name="_s")
    upto = Window.partitionBy("journal", "_s").orderBy("_p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carry = d.groupBy("journal", "_s").agg(F.max("_e").alias("_m"))
    carry = carry.withColumn("_c", F.max("_m").over(Window.partitionBy("journal").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    seen = d.withColumn("_here", F.max("_e").over(upto)).join(carry, ["journal", "_s"])
    return seen.where("_row is not null").select("_row.*", F.coalesce(F.greatest("_here", "_c"), F.lit(-(2**63))).alias("_reach"))


def _spans(df: DataFrame, begin: str, end: str) -> DataFrame:
    return coverage(df, "journal", begin, end).where("kind = 'span'").select("journal", F.col(begin).alias("b"), F.col(end).alias("e"))


def cover_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` that no unbroken chain of `b` covers. Rows that cover nothing are left out."""
    d = _reach(valid(a), _spans(valid(b), "begin_offset", "end_offset"), F.col("begin_offset"))
    return d.where("_reach < end_offset").drop("_reach")


def gaps(df: DataFrame) -> DataFrame:
    return coverage(df, "journal", "begin_offset", "end_offset").where("kind = 'gap'").drop("kind")


def query(fragments: DataFrame, requests: DataFrame, now: int | None = None, min_age: int = 6 * 3600) -> DataFrame:
    """For each request (journal, read_offset, begin_mod_time): the fragment that covers the offset with most content after it.

    If none does, the next fragment is taken (an offset jump) when the read starts at the journal's
    beginning or the next fragment is older than `min_age` seconds at `now`; else the offset is not
    yet available and the columns are null. Fragments modified before begin_mod_time are skipped,
    local ones (mod_time 0) never. An offset of -1 is the write head.
    """
    f = valid(fragments)
    head = f.groupBy("journal").agg(F.max("end_offset").alias("_head"), F.min("begin_offset").alias("_first"))
    r = requests.select("journal", "read_offset", F.coalesce("begin_mod_time", F.lit(0)).alias("_since")).join(head, "journal", "left")
    r = r.withColumn("at", F.when(F.col("read_offset") == -1, F.col("_head")).otherwise(F.col("read_offset")))
    # Requests and the fragments they may use, sorted together within shards: the best fragment at or before
    # a request's offset, and the next after it, are a running maximum and minimum, carried over between shards.
    # Fragments are taken once for each bound on modification time that is asked of their journal.
    since = r.select("journal", "_since").distinct()
    usable = f.join(since, "journal").where((F.col("mod_time") == 0) | (F.col("mod_time") >= F.col("_since")))
    group = F.to_json(F.struct("journal", "_since"))
    none = F.lit(None)
    best = F.struct(F.col("end_offset").alias("e"), (-F.col("begin_offset")).alias("b"), (-F.col("mod_time")).alias("t"))
    after = F.struct(F.col("begin_offset").alias("b"), (-F.col("end_offset")).alias("e"), F.col("mod_time").alias("t"))
    left = usable.select(group.alias("_g"), F.col("begin_offset").alias("_p"), best.alias("_best"), after.alias("_after"))
    right = r.select(group.alias("_g"), F.col("at").alias("_p"), F.struct(*r.columns).alias("_row"))
    both = left.withColumn("_row", none.cast(right.schema["_row"].dataType)).unionByName(right.where("_p is not null").withColumns({"_best": none.cast(left.schema["_best"].dataType), "_after": none.cast(left.schema["_after"].dataType)}))
    d = quantile_shards(both, "_g", "_p", name="_s")
    here = Window.partitionBy("_g", "_s").orderBy("_p")
    by_shard = Window.partitionBy("_g").orderBy("_s")
    carry = d.groupBy("_g", "_s").agg(F.max("_best").alias("_m"), F.min("_after").alias("_n"))
    carry = carry.select("_g", "_s", F.max("_m").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_n").over(by_shard.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    seen = d.withColumn("_m", F.max("_best").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.min("_after").over(here.rangeBetween(1, Window.unboundedFollowing))).where("_row is not null")
    found = seen.join(carry, ["_g", "_s"]).select("_row.*", F.greatest("_m", "_before").alias("_c"), F.coalesce("_n", "_later").alias("_n"))
    found = found.unionByName(r.where("at is null").withColumns({"_c": none.cast(left.schema["_best"].dataType), "_n": none.cast(left.schema["_after"].dataType)}))
    covers = F.coalesce(F.col("_c.e") > F.col("at"), F.lit(False))
    old = (F.col("_n.t") > 0) & (F.col("_n.t") < (F.lit(now) if now is not None else F.unix_timestamp()) - min_age)
    jump = F.coalesce(~covers & F.col("_n").isNotNull() & ((F.col("at") <= F.col("_first")) | old), F.lit(False))
    pick = lambda c, n: F.when(covers, c).when(jump, n)
    return found.select("journal", "read_offset", pick(F.col("at"), F.col("_n.b")).alias("offset"), pick(-F.col("_c.b"), F.col("_n.b")).alias("begin_offset"), pick(F.col("_c.e"), -F.col("_n.e")).alias("end_offset"), jump.alias("jumped"), F.col("_head").alias("write_head"))


def page(fragments: DataFrame, begin_mod_time: int = 0, end_mod_time: int = 0, after: int = 0, limit: int = 1000) -> DataFrame:
    """One page of each journal's listing by begin_offset: rows modified in [begin_mod_time, end_mod_time].

    Both bounds are inclusive; 0 leaves one open. Local rows (mod_time 0) are listed only with an
    open end. The token of the next page is the last begin_offset + 1. limit is 1 to 10000.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("limit is 1 to 10000")
    t = F.col("mod_time")
    keep = F.when(t == 0, F.lit(end_mod_time == 0)).otherwise((t >= begin_mod_time) & ((t <= end_mod_time) if end_mod_time else F.lit(True)))
    rows = fragments.where(keep & (F.col("begin_offset") >= after))
    w = Window.partitionBy("journal").orderBy("begin_offset", "end_offset", "mod_time", "frag_sum", "store")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def extent(fragments: DataFrame) -> DataFrame:
    """journal, first_offset, write_head, last_mod_time, n_fragments, n_bytes."""
    f = valid(fragments)
    return f.groupBy("journal").agg(F.min("begin_offset").alias("first_offset"), F.max("end_offset").alias("write_head"), F.max("mod_time").alias("last_mod_time"), F.count("*").alias("n_fragments"), F.sum((F.col("end_offset") - F.col("begin_offset")).cast("decimal(38,0)")).alias("n_bytes"))


def aged_out(fragments: DataFrame, retention: Column | int, now: int) -> DataFrame:
    """Persisted fragments as old as their retention (seconds). A retention of 0 or less keeps for ever."""
    r = retention if isinstance(retention, Column) else F.lit(retention)
    return fragments.where((F.col("mod_time") > 0) & F.col("store").isNotNull() & (r > 0) & (F.lit(now) - F.col("mod_time") >= r))


def prunable(fragments: DataFrame, live: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Fragments of recovery logs that no live segment (journal, first_offset, last_offset) overlaps.

    Segments are merged first, so that a fragment meets disjoint ranges only. A log without an
    entry in `complete` (journal), if given, is skipped altogether: its hints do not tell all.
    """
    f = valid(fragments).where("store is not null")
    if complete is not None:
        f = f.join(complete.select("journal").distinct(), "journal", "left_semi")
    d = _reach(f, _spans(live, "first_offset", "last_offset"), F.col("end_offset") - 1)
    return d.where("_reach <= begin_offset").drop("_reach")


def prune_totals(fragments: DataFrame, pruned: DataFrame) -> DataFrame:
    """Per journal: fragments and bytes in all, and those of them that are pruned."""
    size = (F.col("end_offset") - F.col("begin_offset")).cast("decimal(38,0)")
    both = valid(fragments).select("journal", size.alias("b"), F.lit(0).alias("p")).unionByName(valid(pruned).select("journal", size.alias("b"), F.lit(1).alias("p")))
    part = lambda p, c: F.coalesce(F.sum(F.when(F.col("p") == p, c)), F.lit(0))
    return both.groupBy("journal").agg(part(0, F.lit(1)).alias("n_fragments"), part(0, F.col("b")).alias("n_bytes"), part(1, F.lit(1)).alias("n_pruned"), part(1, F.col("b")).alias("pruned_bytes"))


def merge_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The index after a listing: remote fragments and local ones they do not cover."""
    return cover_set(remote.unionByName(local, allowMissingColumns=True))


def reset_heads(fragments: DataFrame, heads: DataFrame) -> DataFrame:
    """Journals whose append offset (journal, append_offset) lies before their fragments' end, with the offset to jump to."""
    e = valid(fragments).groupBy("journal").agg(F.max("end_offset").alias("reset_to"))
    return heads.join(e, "journal").where("reset_to > append_offset").select("journal", "append_offset", "reset_to")
