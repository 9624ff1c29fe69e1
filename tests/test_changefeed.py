from __future__ import annotations

import random

import pytest

from tidemark.operators.changefeed import live_files

OPS = "delivery_id bigint, seq_no bigint, checksum bigint, next_checksum bigint, author bigint, first_offset bigint, log string, op_create struct<path string>, op_link struct<fnode bigint, path string>, op_unlink struct<fnode bigint, path string>, op_write struct<fnode bigint, write_offset bigint, write_length bigint>, replay string"
HINTS = "log string, first_seq_no bigint, first_checksum bigint"


def brute(ops, hints):
    first = {}
    for d, seq, ck, nx, _, off, log, *op, _ in sorted(ops, key=lambda o: (o[5] is None, o[5] or 0, o[0])):
        if None not in (seq, ck, log):
            first.setdefault((log, seq, ck), (nx, *op))
    out = []
    for log, seq, ck in {h for h in hints if None not in h}:
        links, last = {}, {}
        while ck is not None and (log, seq, ck) in first:
            nx, create, link, unlink, write = first[log, seq, ck]
            if create:
                links[seq, create["path"]] = True
                last[seq] = seq
            for op in (link, unlink, write):
                if op and op["fnode"] is not None:
                    last[op["fnode"]] = seq
            if link:
                links[link["fnode"], link["path"]] = True
            if unlink:
                links.pop((unlink["fnode"], unlink["path"]), None)
            seq, ck = seq + 1, nx
        out += [(log, p, f, last[f]) for f, p in links]
    return sorted(out)


def made(seed, n=300):
    rnd = random.Random(seed)
    ops, live, ck = [], {}, 0
    for seq in range(1, n):
        nx = rnd.randrange(1, 10**6)
        op = [None] * 4
        kind = rnd.random()
        if kind < 0.3 or not live:
            op[0] = {"path": f"p{seq}"}
            live[seq] = {f"p{seq}"}
        else:
            f = rnd.choice(list(live))
            if kind < 0.45:
                op[1] = {"fnode": f, "path": f"l{seq}"}
                live[f].add(f"l{seq}")
            elif kind < 0.7:
                p = rnd.choice(sorted(live[f]))
                op[2] = {"fnode": f, "path": p}
                live[f].discard(p)
                if not live[f]:
                    del live[f]
            elif kind < 0.95:
                op[3] = {"fnode": f, "write_offset": 0, "write_length": 1}
        row = (seq, ck, nx, rnd.choice((1, 2, None)), seq * 10, "log", *op, "x")
        for _ in range(rnd.choice((1, 1, 1, 3))):
            ops.append(row)
        if rnd.random() < 0.1:  # a competing author's operation, further back in the log
            ops.append((seq, ck, nx + 1, 9, seq * 10 + 5, "log", {"path": f"bad{seq}"}, None, None, None, "x"))
        ck = nx
    rnd.shuffle(ops)
    mid = next(o for o in ops if o[0] == n // 2)
    return [(i, *o) for i, o in enumerate(ops)], [("log", 1, 0), ("log", 1, 0), ("log", n // 2, mid[1]), ("log", 5, 123), ("none", 1, 0)]


def run(spark, ops, hints, **kw):
    got = live_files(spark.createDataFrame(ops, OPS), spark.createDataFrame(hints, HINTS), **kw)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("bits", [2, 5, 12])
def test_against_brute_force(spark, bits):
    ops, hints = made(bits)
    assert run(spark, ops, hints, shard_bits=bits, rows_per_bucket=20) == brute(ops, hints)


def test_lost_operation_ends_the_replay(spark):
    ops, hints = made(3, 80)
    ops = [o for o in ops if o[1] != 50]
    assert run(spark, ops, hints, shard_bits=3) == brute(ops, hints)


def test_nulls_and_empty(spark):
    assert run(spark, [], []) == []
    ops = [(1, 1, 0, None, 1, None, "a", {"path": "x" * 100_000}, None, None, None, "r"), (2, None, 0, 1, 1, 1, "a", {"path": "y"}, None, None, None, "r"), (3, 2, None, 1, 1, 1, None, None, None, None, None, "r"), (4, 2, 7, 1, 1, 1, "a", {"path": None}, None, None, None, "r")]
    hints = [("a", 1, 0), ("a", None, 0), (None, 1, 0), ("a", 2, 7)]
    assert run(spark, ops, hints) == [("a", "x" * 100_000, 1, 1)]
