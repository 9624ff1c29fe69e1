"""History of changing entity attributes, built from periodic snapshots.

The states of all snapshots are range-partitioned by (entity, time) and sorted within each
partition: the external sorter merges its k sorted runs into one iterator ordered by entity and
time. One pass over that iterator closes a version whenever the payload changes. It holds two
runs at most, never an entity's history. Since the ranges also split on time, an entity which
holds a third of all rows is spread over many tasks; only the runs at the edges of a partition
(three at most) are stitched afterwards, so the stitch is as small as the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import running_max_before
from tidemark.session import materialize, width

_MAX = np.iinfo(np.int64).max

_RUN_SCHEMA = (
    "cluster_id bigint, kv_key string, create_revision bigint, kv_value string, "
    "start bigint, first_rev bigint, last_rev bigint, gone bigint, last_nc bigint, "
    "next_start bigint, next_rev bigint, part int, pos int, edge boolean, valid_to bigint"
)
_NAMES = [x.split()[0] for x in _RUN_SCHEMA.split(", ")]


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Elementwise a is distinct from b, nulls being equal to each other."""
    ne = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Runs of equal (entity, payload) in one sorted batch."""
    n = batch.num_rows
    cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    entity = np.zeros(n, bool)
    payload = np.zeros(n, bool)
    if n > 1:
        for c in ("cluster_id", "kv_key"):
            entity[1:] |= _differs(cols[c][1:], cols[c][:-1])
        payload = entity.copy()
        for c in ("create_revision", "kv_value"):
            payload[1:] |= _differs(cols[c][1:], cols[c][:-1])
    payload[0] = True
    at = np.flatnonzero(payload)
    last = np.append(at[1:], n) - 1
    rev = cols["revision"].to_numpy(zero_copy_only=False)
    nc = pc.fill_null(cols["next_complete"], _MAX).to_numpy(zero_copy_only=False)
    mod = pc.fill_null(cols["mod_revision"], _MAX).to_numpy(zero_copy_only=False)
    gone = np.full(n, _MAX)
    if n > 1:  # within a run: a complete snapshot between two sightings lacks the key
        inner = ~payload[1:] & (rev[1:] > nc[:-1])
        gone[:-1][inner] = nc[:-1][inner]
    take = pa.array(at)
    out = {c: np.array(cols[c].take(take).to_pylist(), dtype=object) for c in ("cluster_id", "kv_key", "create_revision", "kv_value")}
    out |= {"start": np.minimum.reduceat(mod, at), "first_rev": rev[at], "last_rev": rev[last], "gone": np.minimum.reduceat(gone, at), "last_nc": nc[last]}
    return out


_KEYS = ("cluster_id", "kv_key", "create_revision", "kv_value")


def _join(a: dict, b: dict) -> dict:
    """Append the runs of b to those of a, merging where a's last and b's first are one run."""
    if not len(a["start"]):
        return b
    if all(a[k][-1] == b[k][0] for k in _KEYS):
        crossed = a["last_nc"][-1] if b["first_rev"][0] > a["last_nc"][-1] else _MAX
        b["start"][0] = min(a["start"][-1], b["start"][0])
        b["gone"][0] = min(a["gone"][-1], b["gone"][0], crossed)
        b["first_rev"][0] = a["first_rev"][-1]
        a = {k: v[:-1] for k, v in a.items()}
    return {k: np.concatenate([a[k], b[k]]) for k in b}


def _closed(r: dict, upto: int) -> dict[str, np.ndarray]:
    """valid_to and successor of the first `upto` runs, each of which has a run after it in r."""
    i = np.arange(upto)
    same = np.array([r["kv_key"][j] == r["kv_key"][j + 1] and r["cluster_id"][j] == r["cluster_id"][j + 1] for j in i], dtype=bool)
    nxt_start = np.where(same, r["start"][i + 1], _MAX)
    nxt_rev = np.where(same, r["first_rev"][i + 1], _MAX)
    return {"next_start": nxt_start, "next_rev": nxt_rev, "valid_to": _end(r["gone"][i], r["last_nc"][i], nxt_start, nxt_rev)}


def _end(gone, last_nc, nxt_start, nxt_rev):
    absent = np.where(nxt_rev > last_nc, last_nc, _MAX)
    to = np.minimum(np.minimum(gone, absent), nxt_start)
    return np.where(to == _MAX, -1, to)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, pos = TaskContext.get().partitionId(), 0
    held: dict = {"start": np.array([], np.int64)}
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _RUN_SCHEMA.split(", "))])

    def emit(r: dict, n: int, tail: bool) -> pa.RecordBatch:
        nonlocal pos
        k = len(r["start"])
        known = min(n, k - 1)
        c = _closed(r, known)
        pad = n - known
        ext = {x: np.concatenate([c[x], np.full(pad, _MAX if x != "valid_to" else -1)]) for x in c}
        edge = np.zeros(n, bool)
        if pos == 0:
            edge[0] = True
        if tail:
            edge[-2:] = True
        cols = {x: r[x][:n] for x in (*_KEYS, "start", "first_rev", "last_rev", "gone", "last_nc")} | ext
        cols |= {"part": np.full(n, part, np.int32), "pos": np.arange(pos, pos + n, dtype=np.int32), "edge": edge}
        pos += n
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name].tolist() if f.name in _KEYS else cols[f.name], type=f.type) for f in schema], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held = _join(held, _runs(batch))
        ready = len(held["start"]) - 2
        if ready > 0:
            yield emit(held, ready, False)
            held = {k: v[ready:] for k, v in held.items()}
    if len(held["start"]):
        yield emit(held, len(held["start"]), True)


def _stitch(frames):
    """Merge the runs at the partitions' edges; the input is three rows a partition at most."""
    import pandas as pd

    some = [f for f in frames if len(f)]
    if not some:
        return
    rows = pd.concat(some, ignore_index=True)
    rows = rows.sort_values(["part", "pos"]).to_dict("records")
    none = lambda x: None if x is None or x != x else x
    key = lambda r: tuple(none(r[k]) for k in _KEYS)
    out: list[dict] = []
    for r in rows:
        p = out[-1] if out else None
        if p and p["part"] < r["part"] and key(p) == key(r):
            crossed = p["last_nc"] if r["first_rev"] > p["last_nc"] else _MAX
            r = r | {"start": min(p["start"], r["start"]), "gone": min(p["gone"], r["gone"], crossed), "first_rev": p["first_rev"]}
            out[-1] = r  # under the later piece's place
        else:
            out.append(r)
    for i, r in enumerate(out):
        nxt = out[i + 1] if i + 1 < len(out) else None
        # The row after in this list is the true successor if it is the next of its own partition or begins a later one.
        if nxt and (nxt["part"] > r["part"] or nxt["pos"] == r["pos"] + 1) and key(nxt)[:2] == key(r)[:2]:
            r["next_start"], r["next_rev"] = nxt["start"], nxt["first_rev"]
        r["valid_to"] = int(_end(r["gone"], r["last_nc"], r["next_start"], r["next_rev"]))
    yield pd.DataFrame({c: [r[c] for r in out] for c in ("part", "pos", "start", "valid_to")})


def snapshot_history(headers: DataFrame, kvs: DataFrame, broadcast_snapshots: int = 200_000) -> DataFrame:
    """Versions of each key of a cluster with the revisions between which they held.

    In: headers (snapshot_id, root, cluster_id, revision, key_count), kvs (snapshot_id, kv_key,
    kv_value, create_revision, mod_revision). Other columns are ignored. Out: cluster_id, kv_key,
    valid_from_rev, valid_to_rev (-1: still valid), kv_value, create_revision.

    Defined results: a header or row delivered repeatedly counts once; rows with a null snapshot,
    key or value, and headers with a null snapshot or revision, say nothing; a null cluster or root is a
    value of its own; a null key_count is never complete; a snapshot of key_count 0 without rows is
    complete; an empty table gives no versions. Values are compared byte for byte, empty and very
    long ones included. Snapshots of one revision are one point in time.
    """
    spark = headers.sparkSession
    heads = headers.select("snapshot_id", "root", "cluster_id", "revision", "key_count").where("snapshot_id is not null and revision is not null").dropDuplicates()
    rows = kvs.select("snapshot_id", "kv_key", "kv_value", "create_revision", "mod_revision").where("snapshot_id is not null and kv_key is not null and kv_value is not null").dropDuplicates()
    counts = kvs.where("kv_value is not null").groupBy("snapshot_id").agg(F.count_distinct("kv_key").alias("n_keys"))
    full = heads.join(counts, "snapshot_id", "left").withColumn("complete", F.coalesce(F.coalesce("n_keys", F.lit(0)) == F.col("key_count"), F.lit(False)))
    # Next complete revision strictly after each: a running maximum of negated revisions, in shards of
    # 65,536 revisions, so that no root's snapshots meet in one task.
    revs = full.groupBy("cluster_id", "root", "revision").agg(F.max("complete").alias("complete"))
    keyed = revs.withColumns({"_g": F.to_json(F.struct("cluster_id", "root")), "_at": -F.col("revision"), "_is": F.when(F.col("complete"), -F.col("revision"))})
    nxt = running_max_before(keyed, "_g", "_at", "_is", "_next", F.shiftright("_at", 16)).select("cluster_id", "root", "revision", (-F.col("_next")).alias("next_complete"))
    h = heads.alias("h").join(nxt.alias("n"), F.expr("h.cluster_id <=> n.cluster_id and h.root <=> n.root and h.revision = n.revision")).select("h.snapshot_id", "h.cluster_id", "h.revision", "n.next_complete")
    # Up to broadcast_snapshots snapshots (counted first) are sent to all tasks, so that values are not shuffled by snapshot.
    h = materialize(h, "history-snapshots")
    if h.count() <= broadcast_snapshots:
        h = F.broadcast(h)
    states = rows.join(h, "snapshot_id").select("cluster_id", "kv_key", "create_revision", "kv_value", "mod_revision", "revision", "next_complete")
    n = width(spark)
    ordered = states.repartitionByRange(n, "cluster_id", "kv_key", "revision").sortWithinPartitions("cluster_id", "kv_key", "revision", "create_revision", "mod_revision", "kv_value")
    runs = materialize(ordered.mapInArrow(_fold, _RUN_SCHEMA), "history-runs")
    closed = runs.where("not edge").selectExpr("cluster_id", "kv_key", "start as valid_from_rev", "valid_to as valid_to_rev", "kv_value", "create_revision")
    # The stitch compares digests of the values; three rows a partition at most come to it, and back from it to the runs.
    edges = runs.where("edge")
    stitched = edges.withColumn("kv_value", F.sha2("kv_value", 256)).repartition(1).mapInPandas(_stitch, "part int, pos int, start bigint, valid_to bigint").withColumnsRenamed({"start": "valid_from_rev", "valid_to": "valid_to_rev"})
    return closed.unionByName(edges.join(F.broadcast(stitched), ["part", "pos"]).select(*closed.columns))
