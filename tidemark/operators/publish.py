"""Publish rows as messages: map to journals, stamp UUIDs, and acknowledge transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import uuids
from tidemark.functions.mapping import by_key
from tidemark.operators.intervals import ranks


def attach_uuids(df: DataFrame, producer: str, start_clock: int, order: Sequence[str | Column], flags: int = uuids.OUTSIDE, journal: str | None = "journal") -> DataFrame:
    """Adds clock and uuid; within a journal clocks ascend in `order`, one tick each.

    The clock restarts per journal from start_clock, so no global order of all rows is needed; a
    pair (journal, clock) is unique for the producer. A journal with most of the rows is numbered in
    many tasks.
    """
    numbered = ranks(df, [journal] if journal else [], list(order), "_rank")
    stamped = numbered.withColumn("clock", F.lit(start_clock) + F.col("_rank") * uuids.TICK).drop("_rank").withColumn("flags", F.lit(flags))
    return stamped.withColumn("uuid", uuids.build(F.lit(producer), F.col("clock"), F.col("flags")))


def publish_committed(df: DataFrame, key: str, journals: Sequence[str], producer: str, start_clock: int, order: Sequence[str], how: str = "modulo") -> DataFrame:
    """Each row is a message of its own, committed at once."""
    return attach_uuids(by_key(df, key, journals, how), producer, start_clock, order, uuids.OUTSIDE)


def publish_transaction(df: DataFrame, key: str, journals: Sequence[str], producer: str, start_clock: int, order: Sequence[str], how: str = "modulo") -> DataFrame:
    """Rows as pending messages of one transaction; they count once ack_intents() of them are written too."""
    return attach_uuids(by_key(df, key, journals, how), producer, start_clock, order, uuids.CONTINUE)


def ack_intents(pending: DataFrame, producer: str) -> DataFrame:
    """One acknowledgement per touched journal, its clock a tick after the journal's last message: journal, clock, flags, uuid."""
    last = pending.groupBy("journal").agg((F.max("clock") + uuids.TICK).alias("clock"))
    return last.select("journal", "clock", F.lit(uuids.ACK).alias("flags"), uuids.build(F.lit(producer), F.col("clock"), F.lit(uuids.ACK)).alias("uuid"))


def reject_invalid(df: DataFrame, check: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the check, and those that fail it or for which it is null."""
    ok = F.coalesce(check, F.lit(False))
    return df.where(ok), df.where(~ok)
