"""Consolidate very many tiny files into few well-sized ones, each record once.

1. A manifest of the valid files (content has its SHA-1 sum) is written and from then on frozen.
2. Repeated files and ranges that other files cover are settled in the manifest: each file owns
   the bytes after the furthest end of the files before it (no content is moved for that).
3. Files are packed into bins by owned bytes, first-fit decreasing, in groups of neighbouring files of one
   journal, so that a bin holds one stretch of it. Bins that stay small are packed together once
   more, so that many tiny journals share a file, within which they are sorted.
4. Each bin is rewritten to one file of records in journal order.
5. Rows and checksums of the written files are compared with those of the manifest's owned
   records, counted at the source; records that start inside a range which another
   file was trusted to hold, and that it does not hold, are written to supplementary files, so none is lost.
6. The result is published with one rename.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import quantile_shards, running_max_before
from tidemark.session import materialize, remove, rename, width, work_path

_RECORDS = "journal string, record_begin bigint, record binary"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item. Items larger than a bin get one of their own. O(n log n).

    A segment tree over the bins' free space finds the first bin in which an item fits.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, (n - 1).bit_length())
    free = np.full(2 * leaves, capacity, dtype=np.int64)
    bins = np.zeros(n, dtype=np.int64)
    extra = 0
    for i in order:
        s = int(sizes[i])
        if s > capacity:
            bins[i] = n + extra
            extra += 1
            continue
        at = 1
        while at < leaves:
            at = 2 * at if free[2 * at] >= s else 2 * at + 1
        bins[i] = at - leaves
        free[at] -= s
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return bins


def _pack(capacity: int):
    """Files of one stretch of a journal -> (file_id, own_from, journal, bin, owned_bytes)."""

    def run(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values(["owned_bytes", "begin_offset"], ascending=[False, True])
        bins = first_fit_decreasing(files["owned_bytes"].to_numpy(), capacity)
        return pd.DataFrame({"file_id": files["file_id"], "own_from": files["own_from"], "journal": files["journal"], "bin": [f"{key[1]}-{b}" for b in bins], "owned_bytes": files["owned_bytes"]})

    return run


def _share(capacity: int):
    """Bins of some journals -> (journal, bin, store_key): the file each is written to."""

    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["bytes", "journal", "bin"], ascending=[False, True, True])
        return pd.DataFrame({"journal": bins["journal"], "bin": bins["bin"], "store_key": [f"{key[0]}-{b}" for b in first_fit_decreasing(bins["bytes"].to_numpy(), capacity)]})

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """journal, begin_offset, content, own_from, store_key -> store_key, journal, record_begin, record, owned.

    Only the newline byte ends a record, and the end of a file. The records of a batch are slices of its content.
    """
    for b in batches:
        content = pa.concat_arrays([b.column(2).cast(pa.binary())])
        if not b.num_rows:
            continue
        at = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + b.num_rows + 1].astype(np.int64)
        data = np.frombuffer(content.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        first, last = at[:-1] - at[0], at[1:] - at[0]
        bounds = np.unique(np.concatenate([[0], np.flatnonzero(data == 10) + 1, last]))
        start = bounds[:-1]
        of = np.searchsorted(last, start, side="right")
        begin = b.column(1).to_numpy(zero_copy_only=False)[of] + start - first[of]
        owned = begin >= b.column(3).to_numpy(zero_copy_only=False)[of]
        records = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        of = pa.array(of)
        out = pa.RecordBatch.from_arrays([b.column(4).take(of), b.column(0).take(of), pa.array(begin, pa.int64()), records, pa.array(owned)], names=["store_key", "journal", "record_begin", "record", "owned"])
        for k in range(0, out.num_rows, 20_000):
            yield out.slice(k, 20_000)


def _sums(df: DataFrame) -> DataFrame:
    """Order-independent count, bytes and checksum of records per journal."""
    one, two = F.xxhash64("journal", "record_begin", "record"), F.xxhash64("record", "record_begin")
    return df.groupBy("journal").agg(F.count("*").alias("records"), F.sum(F.length("record").cast("long")).alias("bytes"), F.bit_xor(one).alias("checksum"), F.bit_xor(two).alias("checksum2"))


def consolidate(files: DataFrame, out: str, target_bytes: int = 128 << 20, group_files: int = 20_000) -> DataFrame:
    """Write the records of files to `out`, each once, and return them: journal, record_begin, record.

    In: files with file_id (unique, the same on every read), journal, begin_offset, content,
    frag_sum. A file counts if its content has the SHA-1 sum frag_sum; the empty content adds
    nothing. A null journal, begin_offset, content or sum is no file. A record ends with a newline;
    bytes after the last newline are a record of their own. Equal bytes at other offsets are other
    records. Nothing is published unless counts and checksums agree.
    """
    spark = files.sparkSession
    files = files.select("file_id", "journal", "begin_offset", "content", "frag_sum")
    staging = work_path(spark, "compaction-staging")
    valid = files.where("file_id is not null and journal is not null and begin_offset is not null and content is not null and frag_sum is not null and unhex(sha1(content)) = frag_sum and length(content) > 0")
    listed = valid.select("file_id", "journal", "begin_offset", (F.col("begin_offset") + F.length("content")).alias("end_offset"), "frag_sum")
    manifest = materialize(listed, "compaction-manifest")
    unique = manifest.groupBy("journal", "begin_offset", "end_offset", "frag_sum").agg(F.min("file_id").alias("file_id"))
    unique = quantile_shards(unique, "journal", "begin_offset", group_files, "part")
    owned = running_max_before(unique, "journal", "begin_offset", "end_offset", "before", F.col("part"))
    owned = owned.withColumn("own_from", F.greatest("begin_offset", F.coalesce("before", "begin_offset"))).withColumn("owned_bytes", F.greatest(F.lit(0), F.col("end_offset") - F.col("own_from")))
    items = owned.select("journal", "part", "file_id", "own_from", "begin_offset", "owned_bytes")
    packed = materialize(items.groupBy("journal", "part").applyInPandas(_pack(target_bytes), "file_id string, own_from bigint, journal string, bin string, owned_bytes bigint"), "compaction-bins")
    bins = packed.groupBy("journal", "bin").agg(F.sum("owned_bytes").alias("bytes"))
    groups = max(1, -(-bins.count() // group_files))
    stores = bins.groupBy(F.pmod(F.xxhash64("journal", "bin"), F.lit(groups)).alias("group")).applyInPandas(_share(target_bytes), "journal string, bin string, store_key string")
    placed = materialize(packed.select("file_id", "own_from", "journal", "bin").join(stores, ["journal", "bin"]).select("file_id", "own_from", "store_key"), "compaction-placed")
    assigned = files.join(placed, "file_id").select("journal", "begin_offset", "content", "own_from", "store_key")
    found = assigned.mapInArrow(_records, "store_key string, journal string, record_begin bigint, record binary, owned boolean")
    # What must come out, counted at the source.
    expected = materialize(_sums(found.where("owned")), "compaction-sums")
    kept = found.where("owned").drop("owned").repartition(width(spark), "store_key").sortWithinPartitions("store_key", "journal", "record_begin")
    kept.write.partitionBy("store_key").parquet(staging)
    # Starts that lie in another file's range and were not found there: none if files agree.
    shared = assigned.where("own_from > begin_offset").mapInArrow(_records, "store_key string, journal string, record_begin bigint, record binary, owned boolean").where("not owned")
    inner = shared.groupBy("journal", "record_begin").agg(F.min("record").alias("record"))
    written = spark.read.schema(_RECORDS).parquet(staging).select("journal", "record_begin")
    missed = materialize(inner.join(written, ["journal", "record_begin"], "left_anti").select("journal", "record_begin", "record"), "compaction-missed")
    if missed.take(1):
        # Spread by stretches of each journal, so that no task writes all of one.
        spread = quantile_shards(missed, "journal", "record_begin", 100_000, "part").repartition(width(spark), "journal", "part").sortWithinPartitions("journal", "record_begin")
        spread.drop("part").withColumn("store_key", F.lit("supplement")).write.mode("append").partitionBy("store_key").parquet(staging)
        expected = expected.unionByName(_sums(missed)).groupBy("journal").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.bit_xor("checksum").alias("checksum"), F.bit_xor("checksum2").alias("checksum2"))
    got = _sums(spark.read.schema(_RECORDS).parquet(staging)).withColumn("side", F.lit(1))
    differing = expected.withColumn("side", F.lit(0)).unionByName(got).groupBy("journal", "records", "bytes", "checksum", "checksum2").agg(F.count_distinct("side").alias("sides")).where("sides < 2")
    if differing.take(1):
        remove(spark, staging)
        raise ValueError("the written files do not hold the records of the manifest; nothing was published")
    rename(spark, staging, out)
    return spark.read.schema(_RECORDS).parquet(out).select("journal", "record_begin", "record")
