"""Overlapping and gapped intervals per entity: continuous coverage and its gaps.

Two levels, so that an entity with a third of all rows is never merged in one task:

1. each entity's axis is cut into shards at quantiles of its intervals' beginnings, so that shards
   hold like numbers of rows however the offsets lie; intervals are clipped to the first and last
   shard they touch and merged within each shard. The shards between (covered whole) are kept as
   one row per first such shard, whatever the number of intervals;
2. only coverage touching a shard boundary, and the whole-shard ranges, are stitched per entity;
   these are as many as shards, not as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, width


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge touching or overlapping [b, e) within each group; sorted and streamed."""
    w = Window.partitionBy(*by).orderBy("b", F.col("e").desc())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("b") > F.max("e").over(before)).cast("long"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_island")


#: Quantiles that are looked up for an entity; it has as many shards at most.
_QUANTILES = 256


def cut_points(df: DataFrame, by: str, at: str, per_shard: int) -> DataFrame:
    """by, cuts: ascending values of `at` that cut each large group into shards of about per_shard rows, 256 at most.

    Groups of up to per_shard rows are left out, so that there are fewer cuts than rows / per_shard.
    The quantiles are aggregated on the map side.
    """
    q = df.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"), F.percentile_approx(at, [i / _QUANTILES for i in range(1, _QUANTILES)], 4000).alias("_q"))
    shards = F.least(F.lit(_QUANTILES), F.ceil(F.col("_n") / F.lit(per_shard))).cast("int")
    picked = F.transform(F.sequence(F.lit(1), shards - 1), lambda i: F.element_at("_q", F.ceil(i * _QUANTILES / shards).cast("int")))
    return q.where(F.col("_n") > per_shard).select(by, F.array_distinct(picked).alias("cuts"))


def _number(cuts: Column | str, at: Column | str) -> Column:
    """How many cuts are at or below a value, by bisection; none where there are no cuts."""
    cuts, at = (F.col(c) if isinstance(c, str) else c for c in (cuts, at))
    steps = F.array(*[F.lit(_QUANTILES >> i) for i in range(_QUANTILES.bit_length())])
    beyond = lambda n: (n <= F.size(cuts)) & (F.try_element_at(cuts, n) <= at)
    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, step: F.when(beyond(n + step), n + step).otherwise(n)))


def _with_cuts(df: DataFrame, cuts: DataFrame, by: str, broadcast_cuts: int = 50_000) -> DataFrame:
    """Adds cuts. They are sent to all tasks if at most broadcast_cuts values are counted in them; else Spark decides."""
    total = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    return df.join(F.broadcast(cuts) if total <= broadcast_cuts else cuts, by, "left")


def quantile_shards(df: DataFrame, by: str, at: str, per_shard: int = 20_000, name: str = "shard") -> DataFrame:
    """Adds `name`, a number that grows with `at` and is shared by about per_shard rows of the group, wherever their values lie."""
    cuts = materialize(cut_points(df, by, at, per_shard), "shard-cuts")
    return _with_cuts(df, cuts, by).withColumn(name, _number("cuts", at)).drop("cuts")


def coverage(df: DataFrame, entity: str, begin: str, end: str, rows_per_shard: int = 20_000) -> DataFrame:
    """Spans and gaps of each entity: entity, kind ('span' or 'gap'), begin, end.

    Rows with a null entity, begin or end, and those with end <= begin, cover nothing. Touching
    ranges are joined. Repeated and nested rows add nothing. An entity with one span has no gap.
    Bounds may lie anywhere in the 64-bit range.
    """
    rows = df.select(F.col(entity).alias("j"), F.col(begin).cast("long").alias("b"), F.col(end).cast("long").alias("e")).where("j is not null and b is not null and e is not null and e > b")
    # Repeated and same-start rows go on the map side.
    rows = rows.groupBy("j", "b").agg(F.max("e").alias("e"))
    # Both are read again below: written once, the input is scanned and shuffled once.
    cuts = materialize(cut_points(rows, "j", "b", rows_per_shard), "coverage-cuts")
    numbered = _with_cuts(rows, cuts, "j").withColumns({"s1": _number("cuts", "b"), "s2": _number("cuts", F.col("e") - 1)})
    # Shard s is [lo, hi): from the s-th cut, if there is one, to the next.
    bound = lambda n: F.try_element_at("cuts", F.when(n > 0, n))
    numbered = numbered.withColumns({"lo1": bound(F.col("s1")), "hi1": bound(F.col("s1") + 1), "lo2": bound(F.col("s2")), "hi2": bound(F.col("s2") + 1)}).drop("cuts")
    cut = materialize(numbered, "coverage-cut")
    piece = lambda s, b, e, lo, hi: F.struct(F.col(s).alias("s"), F.col(b).alias("b"), F.col(e).alias("e"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    parts = F.when(F.col("s1") == F.col("s2"), F.array(piece("s1", "b", "e", "lo1", "hi1"))).otherwise(F.array(piece("s1", "b", "hi1", "lo1", "hi1"), piece("s2", "lo2", "e", "lo2", "hi2")))
    pieces = cut.select("j", F.inline(parts)).groupBy("j", "s", "b", "lo", "hi").agg(F.max("e").alias("e"))
    touching = F.coalesce(F.col("b") == F.col("lo"), F.lit(False)) | F.coalesce(F.col("e") == F.col("hi"), F.lit(False))
    local = materialize(_islands(pieces, ["j", "s", "lo", "hi"]).select("j", "s", "b", "e", touching.alias("touching")), "coverage-local")
    # Shards covered whole by one interval: the furthest for each first shard is enough.
    whole = cut.where("s2 - s1 >= 2").groupBy("j", "s1").agg(F.max("s2").alias("s2"), F.max("lo2").alias("lo2"), F.min("hi1").alias("hi1"))
    whole = whole.select("j", (F.col("s1") + 1).alias("b"), F.col("s2").alias("e"), F.col("hi1").alias("from"), F.col("lo2").alias("upto"))
    whole = materialize(_islands(whole.select("j", "b", "e"), ["j"]).join(whole.groupBy("j", "b").agg(F.min("from").alias("from")), ["j", "b"]).join(whole.groupBy("j", "e").agg(F.max("upto").alias("upto")), ["j", "e"]), "coverage-whole")
    edge = local.where("touching").select("j", "b", "e").unionByName(whole.select("j", F.col("from").alias("b"), F.col("upto").alias("e")))
    stitched = _islands(edge, ["j"])
    covered = whole.select("j", F.explode(F.sequence("b", F.col("e") - 1)).alias("s"))
    free = local.where("not touching").join(covered, ["j", "s"], "left_anti").select("j", "b", "e", "s")
    stitched = _with_cuts(stitched.select("j", "b", "e"), cuts, "j").select("j", "b", "e", _number("cuts", "b").alias("s"))
    spans = materialize(stitched.unionByName(free), "coverage-spans")
    # Gap before each span: its neighbour is in the same shard, or the last span of an earlier one.
    within = Window.partitionBy("j", "s").orderBy("b")
    ends = spans.groupBy("j", "s").agg(F.max("e").alias("last_end"), F.min("b").alias("b"))
    carry = ends.select("j", "b", F.lag("last_end").over(Window.partitionBy("j").orderBy("s")).alias("carry"))
    inside = spans.select("j", F.lag("e").over(within).alias("p"), "b")
    gaps = inside.where("p is not null").unionByName(carry.where("carry is not null").select("j", F.col("carry").alias("p"), "b"))
    out = lambda d, kind, b, e: d.select(F.col("j").alias(entity), F.lit(kind).alias("kind"), F.col(b).alias(begin), F.col(e).alias(end))
    return out(spans, "span", "b", "e").unionByName(out(gaps, "gap", "p", "b"))


def running_max_before(df: DataFrame, by: str, begin: str, end: str, name: str, shard: Column) -> DataFrame:
    """Adds `name`: the largest `end` among the rows of the group that come before in (begin, end desc) order.

    `shard` must grow with `begin`. Each (group, shard) is sorted alone; one summary row a shard
    carries the maximum over from the shards before.
    """
    d = df.withColumn("_s", shard)
    w = Window.partitionBy(by, "_s").orderBy(begin, F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(by, "_s").agg(F.max(end).alias("_m"))
    carry = carry.withColumn("_c", F.max("_m").over(Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    return d.withColumn(name, F.max(end).over(w)).join(carry, [by, "_s"]).withColumn(name, F.greatest(name, "_c")).drop("_s", "_c")


def ranks(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... within each group in `order`, which should tell all rows apart. A hot group is numbered in many tasks.

    Rows are range-partitioned by group and order and written once; each range counts its rows, and the sums of those before
    are carried over.
    """
    cols = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(width(df.sparkSession), *cols).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranks")
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    same = None
    for c in [*by, "_part"]:
        same = F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) if same is None else same & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return own.alias("r").join(before.alias("k"), same).select(*[f"r.{c}" for c in df.columns], (F.col("_before") + F.col("_own")).cast("long").alias(name))
