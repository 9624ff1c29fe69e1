"""Queries and updates of catalogs: journals, shards, routes, assignments, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import journal_meta, matches, with_meta

#: Replica statuses in ascending order.
STATUSES = ("IDLE", "BACKFILL", "STANDBY", "PRIMARY", "FAILED")


def list_journals(specs: DataFrame, selector: str, claims: str | None = None) -> DataFrame:
    """Journals (name, labels, ...) that match the selector, and the caller's claims if given, by name."""
    labels = journal_meta(F.col("labels"), F.col("name"))
    ok = matches(labels, selector)
    return specs.where(ok & matches(labels, claims) if claims else ok).orderBy("name")


#: Bits of a journal's flags.
NOT_SPECIFIED, O_RDONLY, O_WRONLY, O_RDWR = 0, 1, 2, 4


def may_read(flags: Column) -> Column:
    return F.coalesce(flags, F.lit(NOT_SPECIFIED)).isin(NOT_SPECIFIED, O_RDONLY, O_RDWR)


def may_write(flags: Column) -> Column:
    return F.coalesce(flags, F.lit(NOT_SPECIFIED)).isin(NOT_SPECIFIED, O_WRONLY, O_RDWR)


def list_shards(specs: DataFrame, selector: str) -> DataFrame:
    return specs.where(matches(with_meta(F.col("labels"), id=F.col("id")), selector)).orderBy("id")


def with_assignments(items: DataFrame, assignments: DataFrame, item: str) -> DataFrame:
    """Items left-joined with their assignments, folded in slot order: route array<struct<slot, member>>."""
    route = assignments.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("slot", "member"))).alias("route"))
    return items.join(route, item, "left").withColumn("route", F.coalesce("route", F.array().cast("array<struct<slot:int,member:string>>")))


def changes(current: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """Key rows with change: added, removed or unchanged."""
    a = current.select(*key).distinct().withColumn("_a", F.lit(True))
    b = desired.select(*key).distinct().withColumn("_b", F.lit(True))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, kind.alias("change"))


def apply_changes(catalog: DataFrame, updates: DataFrame, key: str = "name") -> DataFrame:
    """The catalog (key, revision, spec) after updates (key, expect_revision, spec), all or nothing.

    A null spec deletes. expect_revision: 0 to create, -1 for any, else the row's revision. A
    mismatch or several updates of one key raise when the result is read.
    """
    u = updates.select(F.col(key), "expect_revision", F.col("spec").alias("_new"))
    n = u.groupBy(key).agg(F.count("*").alias("_n"), F.first("expect_revision").alias("_expect"), F.first("_new").alias("_new"))
    top = catalog.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("_top"))
    j = catalog.join(n, key, "full_outer").withColumn("_top", top.scalar())
    wrong = F.col("_n").isNotNull() & ((F.col("_n") > 1) | ((F.col("_expect") != -1) & (F.col("_expect") != F.coalesce("revision", F.lit(0)))))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("conflict at "), F.col(key))).cast("long")).when(F.col("_n").isNotNull(), F.col("_top") + 1).otherwise(F.col("revision"))
    touched = j.withColumn("_rev", checked)
    return touched.where(F.col("_n").isNull() | F.col("_new").isNotNull() | (F.col("_rev") < 0)).select(key, F.col("_rev").alias("revision"), F.coalesce("_new", "spec").alias("spec"))


def lag(heads: DataFrame, progress: DataFrame) -> DataFrame:
    """journal, write_head, read_through, lag: bytes a reader is behind (null progress: everything)."""
    j = heads.join(progress, "journal", "left")
    return j.select("journal", "write_head", "read_through", (F.col("write_head") - F.coalesce("read_through", F.lit(0))).alias("lag"))


def reduce_status(replicas: DataFrame, key: str) -> DataFrame:
    """The highest status code of an item's replicas, and all their errors in slot order."""
    errs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "errors"))), lambda r: F.coalesce(r["errors"], F.array().cast("array<string>"))))
    code = F.max("code")
    return replicas.groupBy(key).agg(code.alias("code"), errs.alias("errors")).withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("code") + 1))


def zone_counts(assignments: DataFrame) -> DataFrame:
    """Per zone: slots, primaries, members and items."""
    return assignments.groupBy("zone").agg(F.count("*").alias("slots"), F.count_if(F.col("slot") == 0).alias("primaries"), F.count_distinct("member").alias("members"), F.count_distinct("item").alias("items"))


def shed_capacity(members: DataFrame, total: Column | int) -> DataFrame:
    """Members (member, create_revision, item_limit, exiting): exiting ones may leave, oldest first, while the rest still hold `total` items.

    Adds can_leave. Members are few: a cluster's nodes, not its data.
    """
    stay = members.agg(F.coalesce(F.sum(F.col("item_limit").cast("long")), F.lit(0)).alias("_all"))
    w = Window.orderBy("create_revision", "member").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ex = members.where("exiting").withColumn("_gone", F.sum(F.col("item_limit").cast("long")).over(w)).withColumn("_all", stay.scalar())
    marked = ex.withColumn("can_leave", F.col("_all") - F.col("_gone") >= (total if isinstance(total, Column) else F.lit(total))).drop("_gone", "_all")
    return marked.unionByName(members.where("not exiting").withColumn("can_leave", F.lit(False)))


def scale_and_round(c: Column, n: Column, d: Column) -> Column:
    """ceil(c * min(n / d, 1)) in integers."""
    m = F.least(n, d)
    return F.call_function("div", c * m + d - 1, d)


def union_specs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field: a's value, or b's where a has none (null, 0 or '')."""
    blank = lambda c, t: F.nullif(c, F.lit(0 if t in ("int", "bigint") else "" if t == "string" else False).cast(t))
    kinds = dict(a.dtypes)
    j = a.alias("a").join(b.alias("b"), key, "full_outer")
    return j.select(key, *[F.coalesce(blank(F.col(f"a.{f}"), kinds[f]), F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f) for f in fields])


def intersect_specs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field: the common value, null where they differ."""
    j = a.alias("a").join(b.alias("b"), key)
    return j.select(key, *[F.when(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.col(f"a.{f}")).alias(f) for f in fields])


def subtract_specs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field: a's value where b's differs, else null."""
    j = a.alias("a").join(b.alias("b"), key)
    return j.select(key, *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.col(f"a.{f}")).alias(f) for f in fields])


def hoist(specs: DataFrame, parent: Column, fields: list[str]) -> DataFrame:
    """Per parent: each field's value if all children agree on it, else null."""
    return specs.groupBy(parent.alias("parent")).agg(*[F.when((F.count_distinct(f) == 1) & (F.count(f) == F.count("*")), F.min(f)).alias(f) for f in fields], F.count("*").alias("children"))


def push_down(children: DataFrame, parents: DataFrame, parent: Column, fields: list[str]) -> DataFrame:
    """Children with the parent's value where they have none: the inverse of hoist()."""
    c = children.withColumn("_p", parent)
    p = parents.select(F.col("parent").alias("_p"), *[F.col(f).alias(f"_{f}") for f in fields])
    return c.join(p, "_p", "left").select(*[F.coalesce(f, f"_{f}").alias(f) if f in fields else F.col(f) for f in children.columns])


def missing_references(shards: DataFrame, journals: DataFrame) -> DataFrame:
    """Sources (id, source) of shards that no journal (name) exists for."""
    return shards.select("id", F.explode("sources").alias("source")).join(journals.select(F.col("name").alias("source")), "source", "left_anti").select("id", "source")


def shards_of_journals(shards: DataFrame) -> DataFrame:
    """journal, shards: which shards consume a journal."""
    return shards.select(F.explode(F.array_distinct("sources")).alias("journal"), "id").groupBy("journal").agg(F.array_sort(F.collect_set("id")).alias("shards"))


def resolve(items: DataFrame, assignments: DataFrame, item: str, near: str | None = None) -> DataFrame:
    """item, status, primary, member: who serves each item. assignments: item, slot, member, zone.

    The primary holds slot 0. Reads go to a member of the zone `near` if there is one (the lowest slot first), else to
    the primary, else to the lowest slot. Status: OK, NO_PRIMARY (no slot 0) or NOT_ASSIGNED.
    """
    close = F.when(F.col("zone") == near, 0).otherwise(1) if near is not None else F.lit(1)
    per = assignments.groupBy(item).agg(F.min_by("member", F.when(F.col("slot") == 0, F.struct("slot", "member"))).alias("primary"), F.min_by("member", F.struct(close, "slot", "member")).alias("member"))
    status = F.when(F.col("member").isNull(), "NOT_ASSIGNED").when(F.col("primary").isNull(), "NO_PRIMARY").otherwise("OK")
    return items.select(item).distinct().join(per, item, "left").select(item, status.alias("status"), "primary", "member")


def patch(tree: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The tree after patches: a patch's values win where it has them (not null), its new keys are added; patched tells which rows were named."""
    t, p = tree.select(key, *fields), patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_p"))
    return t.join(p, key, "full_outer").select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], F.coalesce("_p", F.lit(False)).alias("patched"))


def mark_unpatched(patched: DataFrame) -> DataFrame:
    """Rows of patch() with `delete`: what no patch named is to be deleted."""
    return patched.withColumn("delete", ~F.col("patched")).drop("patched")


def apply_in_batches(catalog: DataFrame, updates: DataFrame, size: int, key: str = "name") -> DataFrame:
    """apply_changes() with updates taken in batches of `size` by key: each batch is a transaction, and so a revision, of its own."""
    from tidemark.operators.intervals import ranks

    numbered = ranks(updates, [], [key], "_rank").select(F.col(key), (F.expr(f"(_rank - 1) div {size}")).alias("_batch"))
    after = apply_changes(catalog, updates, key).join(numbered, key, "left")
    return after.select(key, (F.col("revision") + F.coalesce("_batch", F.lit(0))).alias("revision"), "spec")


def network_hash(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row, hash: CRC-64 over the sorted keys of members and of items (both: key). It tells whether an assignment must be solved anew."""
    from tidemark.functions.checksums import crc64

    listed = lambda d: d.agg(F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("k"))  # noqa: E731 - a catalog, not data
    both = listed(members).withColumn("n", F.lit(0)).unionByName(listed(items).withColumn("n", F.lit(1)))
    return both.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k"))), lambda x: x["k"]), "\n\n").alias("k")).select(crc64(F.col("k").cast("binary")).alias("hash"))
