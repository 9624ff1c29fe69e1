"""Read-committed sequencing: at-least-once messages of transactions -> exactly-once committed ones.

A message has journal, begin_offset, producer, clock and flags. Per (journal, producer), in offset
order, a small automaton keeps the clock of the last acknowledgement (exclusive lower bound), the
largest clock, and whether a span of pending messages is open. The batch form cuts producers behind
their acknowledgements, numbers the spans in one streamed pass which holds three numbers and nothing
else, and finds out what became of each span; whether a message is committed is then a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.uuids import ACK, CONTINUE, OUTSIDE
from tidemark.operators.intervals import running_max_before
from tidemark.session import materialize, width

OUTCOMES = ("outside_already_acked", "outside_commit", "continue_already_acked", "continue_clock_larger", "continue_begin_span", "continue_extend_span", "ack_rollback", "ack_empty", "ack_commit")


class Automaton:
    """State of one (journal, producer): step() takes a message and tells its outcome."""

    __slots__ = ("max", "min", "open")

    def __init__(self, min_: int | None = None, max_: int | None = None, open_: bool = False):
        self.min, self.max, self.open = min_, max_, open_

    def step(self, clock: int, flags: int) -> tuple[str, int]:
        """Outcome, and the lower bound of clocks that an acknowledgement commits."""
        if clock == 0:
            return "outside_commit", 0
        if self.min is None:
            self.min = self.max = clock - 1
        low = self.min
        if flags == CONTINUE:
            if clock <= self.min:
                return "continue_already_acked", low
            if clock <= self.max:
                return "continue_clock_larger", low
            self.max = clock
            if self.open:
                return "continue_extend_span", low
            self.open = True
            return "continue_begin_span", low
        if flags == ACK:
            was_open, self.open = self.open, False
            rolled_back = clock <= self.min
            self.min = self.max = clock
            return ("ack_rollback" if rolled_back else "ack_commit" if was_open else "ack_empty"), low
        if clock <= self.min:
            return "outside_already_acked", low
        self.open = False
        self.min = self.max = clock
        return "outside_commit", low


_FOLDED = pa.schema([("journal", pa.string()), ("producer", pa.string()), ("begin_offset", pa.int64()), ("clock", pa.int64()), ("flags", pa.int32()), ("since", pa.int64()), ("outcome", pa.string()), ("span", pa.int64()), ("low", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by journal, producer, offset of the acknowledgement before, own offset."""
    key, a, span = None, Automaton(), 0
    for b in batches:
        outcome, spans, low = [], [], []
        columns = [b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
        for j, p, clock, flags, since, ack in zip(*columns, strict=True):
            if (j, p, since) != key:
                key, a, span = (j, p, since), Automaton(ack, ack), 0
            o, lo = a.step(clock, flags)
            if o == "continue_begin_span":
                span += 1
            outcome.append(o)
            spans.append(span)
            low.append(lo)
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(outcome), pa.array(spans, pa.int64()), pa.array(low, pa.int64())], schema=_FOLDED)


def outcomes(messages: DataFrame, shard_bits: int = 26) -> DataFrame:
    """Outcome of each message (journal, producer, begin_offset, clock, flags), with its span and lower clock bound.

    An acknowledgement sets the automaton to its own clock whatever came before. So a producer is cut
    behind each of its acknowledgements (`since`: the offset of the one before, -1 if none), and the
    pieces are folded in parallel; a producer with a third of all rows is as many pieces as
    transactions. The acknowledgement before is found in shards of 2**shard_bits bytes.

    Rows with a null journal, offset or clock are no messages; a null producer is one of its own
    and null flags are 0. Extra columns are ignored.
    """
    rows = messages.where("journal is not null and begin_offset is not null and clock is not null").select("journal", "producer", F.col("begin_offset").cast("long"), F.col("clock").cast("long"), F.coalesce(F.col("flags").cast("int"), F.lit(OUTSIDE)).alias("flags"))
    who = F.concat_ws("\x00", F.col("journal"), F.coalesce("producer", F.lit("\x01")))
    ack = F.when((F.col("flags") == ACK) & (F.col("clock") != 0), F.struct("begin_offset", "clock"))
    keyed = rows.withColumns({"_who": who, "_ack": ack})
    cut = running_max_before(keyed, "_who", "begin_offset", "_ack", "_last", F.shiftright("begin_offset", shard_bits))
    pieces = cut.select("journal", "producer", "begin_offset", "clock", "flags", F.coalesce("_last.begin_offset", F.lit(-1).cast("long")).alias("since"), F.col("_last.clock").alias("ack_clock"))
    ordered = pieces.repartition(width(messages.sparkSession), "journal", "producer", "since").sortWithinPartitions("journal", "producer", "since", "begin_offset")
    return ordered.mapInArrow(_fold, "journal string, producer string, begin_offset bigint, clock bigint, flags int, since bigint, outcome string, span bigint, low bigint")


def committed(messages: DataFrame, drop_acks: bool = False, shard_bits: int = 26) -> DataFrame:
    """Committed messages with commit_begin, the offset of what committed them. Order: journal, commit_begin, begin_offset."""
    folded = materialize(outcomes(messages, shard_bits), "sequenced")
    acks = folded.where("outcome = 'ack_commit'").select("journal", "producer", "since", "span", F.col("clock").alias("ack"), F.col("low").alias("floor"), F.col("begin_offset").alias("commit_begin"))
    pending = folded.where("outcome in ('continue_begin_span', 'continue_extend_span')").drop("outcome", "low")
    m, k = pending.alias("m"), acks.alias("k")
    in_span = m.join(k, F.expr("m.journal = k.journal and m.producer <=> k.producer and m.since = k.since and m.span = k.span and m.clock > k.floor and m.clock <= k.ack"))
    out = in_span.select("m.journal", "m.producer", "m.begin_offset", "m.clock", "m.flags", "k.commit_begin")
    self_committed = folded.where("outcome in ('outside_commit', 'ack_empty', 'ack_commit')").select("journal", "producer", "begin_offset", "clock", "flags", F.col("begin_offset").alias("commit_begin"))
    both = out.unionByName(self_committed)
    return both.where(f"flags <> {ACK}") if drop_acks else both


def committed_ascending(messages: DataFrame, drop_acks: bool = False) -> DataFrame:
    """The same, by one window, for producers whose clocks strictly ascend (no repeats, no rollbacks)."""
    w = Window.partitionBy("journal", "producer").orderBy("begin_offset").rowsBetween(1, Window.unboundedFollowing)
    ends = F.when(F.col("flags") != CONTINUE, F.struct("flags", "begin_offset"))
    nxt = messages.withColumn("_next", F.first(ends, ignorenulls=True).over(w))
    own = F.col("flags") != CONTINUE
    keep = nxt.where(own | (F.col("_next.flags") == ACK)).withColumn("commit_begin", F.when(own, F.col("begin_offset")).otherwise(F.col("_next.begin_offset"))).drop("_next")
    return keep.where(f"flags <> {ACK}") if drop_acks else keep


def producer_states(messages: DataFrame) -> DataFrame:
    """journal, producer, last_ack, begin_offset of the pending span (-1: none) after all messages: the sequencer's checkpoint."""
    folded = materialize(outcomes(messages), "sequenced").where("clock <> 0")
    last = folded.groupBy("journal", "producer").agg(
        F.max_by("outcome", "begin_offset").alias("last"),
        F.max(F.when(F.col("outcome").isin("outside_commit", "ack_rollback", "ack_empty", "ack_commit"), F.struct("begin_offset", "clock"))).alias("settled"),
        F.min_by("low", "begin_offset").alias("first_low"),
        F.max(F.when(F.col("outcome") == "continue_begin_span", F.struct("begin_offset"))["begin_offset"]).alias("opened"),
    )
    pending = F.col("opened").isNotNull() & (F.col("opened") > F.coalesce("settled.begin_offset", F.lit(-1)))
    return last.select("journal", "producer", F.coalesce("settled.clock", "first_low").alias("last_ack"), F.when(pending, F.col("opened")).otherwise(-1).alias("begin_offset"))


def prune_states(states: DataFrame, horizon: int) -> DataFrame:
    """States without producers whose last_ack is more than `horizon` clock units behind their journal's newest."""
    newest = states.groupBy("journal").agg(F.max("last_ack").alias("_newest"))
    return states.join(newest, "journal").where(F.col("_newest") - F.col("last_ack") <= horizon).drop("_newest")


def read_through(messages: DataFrame, end: str = "end_offset") -> DataFrame:
    """journal, read_through: the end of the read messages of each journal."""
    return messages.groupBy("journal").agg(F.max(end).alias("read_through"))
