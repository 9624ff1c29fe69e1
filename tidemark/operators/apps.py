"""End-to-end queries: n-gram counts, bike cycles, ordered stream sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checksums import crc64_update
from tidemark.functions.mapping import modulo
from tidemark.functions.ngrams import ngrams
from tidemark.operators.intervals import coverage
from tidemark.session import width


def ngram_counts(docs: DataFrame, text: str, n: int, journals: Sequence[str]) -> DataFrame:
    """n_gram, journal, count over all texts. Grams are counted on the map side; only then is each one mapped. A null text has none."""
    grams = docs.where(F.col(text).isNotNull()).select(F.explode(ngrams(F.col(text), n)).alias("n_gram"))
    return grams.groupBy("n_gram").agg(F.count("*").alias("count")).select("n_gram", modulo("n_gram", journals).alias("journal"), "count")


def with_prefix(counts: DataFrame, prefix: str) -> DataFrame:
    return counts.where(F.col("n_gram").startswith(prefix)).orderBy("n_gram")


def keep_last(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in `order`. Spark limits each partition before the shuffle, so a hot key costs n rows a task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def bike_cycles(rides: DataFrame, window: int = 20, min_length: int = 10) -> DataFrame:
    """bike_id, steps array<struct<ts, station>>: bikes whose last rides form a cycle.

    Rides: bike_id, uuid, start_time, end_time, start_id, end_id. Of the `window` latest rides, the
    path goes back from the last station over rides without relocation, until that station is met
    again; it is a cycle if it ends there and has more than min_length steps. Rides are numbered
    by start_time descending, then uuid. This is the recursive walk as one window, since each ride
    continues the one after it.
    """
    last = keep_last(rides, "bike_id", [F.col("start_time").desc(), F.col("uuid").desc()], window)
    w = Window.partitionBy("bike_id").orderBy(F.col("start_time").desc(), F.col("uuid").desc())
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = last.withColumns({"ind": F.row_number().over(w), "terminus": F.first("end_id").over(up), "next_start": F.lag("start_id").over(w)})
    linked = (F.col("ind") == 1) | ((F.col("end_id") == F.col("next_start")) & (F.col("end_id") != F.col("terminus")))
    path = r.withColumn("broken", F.max((~F.coalesce(linked, F.lit(False))).cast("int")).over(up)).where("broken = 0")
    g = path.groupBy("bike_id").agg(
        F.count("*").alias("length"),
        F.count_if(F.col("start_id") == F.col("terminus")).alias("returns"),
        F.min_by(F.struct(F.col("end_time").alias("ts"), F.col("end_id").alias("station")), "ind").alias("final"),
        F.sort_array(F.collect_list(F.struct("ind", F.col("start_time").alias("ts"), F.col("start_id").alias("station"))), asc=False).alias("back"),  # window rows at most
    )
    steps = F.concat(F.transform("back", lambda s: F.struct(s["ts"].alias("ts"), s["station"].alias("station"))), F.array("final"))
    return g.where((F.col("returns") == 1) & (F.col("length") > min_length)).select("bike_id", steps.alias("steps"))


def _sum_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (id, seq_no), data null or empty at the end -> one row per finished stream."""
    current, seq, value, ok, done = None, 0, 0, True, False
    kind: pa.DataType | None = None

    def close(out: list) -> None:
        if current is not None:
            out.append((current, seq, f"{value:016x}", "complete" if ok and done else "incomplete" if ok else "out of order"))

    for b in batches:
        kind = b.schema.field(0).type
        out: list[tuple] = []
        for i, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if i != current:
                close(out)
                current, seq, value, ok, done = i, 0, 0, True, False
            if n == seq and seq:  # delivered again
                continue
            ok = ok and n == seq + 1 and not done
            seq = n
            if data:
                value = crc64_update(value, bytes(data))
            else:
                done = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "seq_no", "value", "state"])
    out = []
    close(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "seq_no", "value", "state"])


def stream_sums(chunks: DataFrame) -> DataFrame:
    """id, seq_no, value, state: CRC-64 of each stream's data in order of seq_no (from 1), folded as the rows stream by.

    In: id, seq_no, data; empty or null data ends a stream. A chunk delivered again is passed over,
    a missing one makes the stream out of order. A null id or seq_no is no chunk.
    """
    rows = chunks.where("id is not null and seq_no is not null").select("id", F.col("seq_no").cast("long"), F.col("data").cast("binary"))
    kind = dict(rows.dtypes)["id"]
    ordered = rows.repartition(width(chunks.sparkSession), "id").sortWithinPartitions("id", "seq_no")
    return ordered.mapInArrow(_sum_streams, f"id {kind}, seq_no bigint, value string, state string")


def reduce_segments(segments: DataFrame) -> DataFrame:
    """Segments (log, author, first_seq_no, last_seq_no, first_offset, last_offset) with overlapping and adjacent ones of one author joined.

    first_offset is a lower bound, of which the tightest is kept at the first seq_no; a last_offset
    of 0 is unknown. Rows with a null log, author or seq_no, and reversed ones, are no segments.
    """
    s = segments.where("log is not null and author is not null and first_seq_no is not null and last_seq_no >= first_seq_no")
    s = s.select(F.struct("log", "author").alias("who"), "first_seq_no", "last_seq_no", "first_offset", "last_offset")
    # Runs are coverage of sequence numbers, which is found in shards; offsets come by equality with a run's ends.
    spans = coverage(s.select("who", "first_seq_no", (F.col("last_seq_no") + 1).alias("stop")), "who", "first_seq_no", "stop").where("kind = 'span'")
    runs = spans.select("who", "first_seq_no", (F.col("stop") - 1).alias("last_seq_no"))
    first = s.groupBy("who", "first_seq_no").agg(F.max("first_offset").alias("first_offset"))
    last = s.groupBy("who", "last_seq_no").agg(F.max("last_offset").alias("last_offset"))
    return runs.join(first, ["who", "first_seq_no"]).join(last, ["who", "last_seq_no"]).select("who.*", "first_seq_no", "last_seq_no", "first_offset", "last_offset")
