from __future__ import annotations

import random
from collections import defaultdict

from tidemark.operators.history import snapshot_history

HEADERS = "snapshot_id bigint, root string, cluster_id bigint, revision bigint, key_count int"
KVS = "snapshot_id bigint, kv_key string, kv_value string, create_revision bigint, mod_revision bigint"


def brute(headers, kvs):
    heads = {h[0]: h for h in headers if h[0] is not None and h[3] is not None}
    states, seen = defaultdict(dict), defaultdict(set)
    for sid, key, value, create, mod in kvs:
        if sid in heads and key is not None and value is not None:
            _, root, cluster, rev, _ = heads[sid]
            states[cluster, key].setdefault(rev, (create, value, mod, root))
            seen[sid].add(key)
    complete = defaultdict(set)
    for sid, root, cluster, rev, n in heads.values():
        if n is not None and len(seen[sid]) == n:
            complete[cluster, root].add(rev)
    out = []
    for (cluster, key), by in states.items():
        runs = []
        for rev in sorted(by):
            create, value, mod, root = by[rev]
            if runs and runs[-1][:2] == [create, value]:
                runs[-1][2] = min(runs[-1][2], mod)
                runs[-1][3] = rev
            else:
                runs.append([create, value, mod, rev, root])
        for i, (_, _, start, last, root) in enumerate(runs):
            ends = [runs[i + 1][2]] if i + 1 < len(runs) else []
            ends += [r for r in sorted(complete[cluster, root]) if r > last and r not in by][:1]
            out.append((cluster, key, start, min(ends) if ends else -1))
    return sorted(out, key=repr)


def made(seed, keys=6, snaps=40, hot=False):
    rnd = random.Random(seed)
    headers, kvs, live, rev = [], [], {}, 0
    for sid in range(snaps):
        for _ in range(rnd.randrange(4)):
            rev += 1
            k = "hot" if hot and rnd.random() < 0.7 else f"k{rnd.randrange(keys)}"
            if k in live and rnd.random() < 0.3:
                del live[k]
            elif k in live:
                live[k] = (rnd.choice("abc"), live[k][1], rev)
            else:
                live[k] = (rnd.choice("abc"), rev, rev)
        rev += 1
        headers.append((sid, "/r", 1, rev, len(live)))
        for k, (v, c, m) in live.items():
            if rnd.random() < 0.95:  # some snapshots arrive incomplete
                kvs += [(sid, k, v, c, m)] * rnd.choice((1, 1, 2))
                if rnd.random() < 0.1:
                    kvs.append((sid, k, None, c, m))
    return headers + headers[:3], kvs


def run(spark, headers, kvs, **kw):
    got = snapshot_history(spark.createDataFrame(headers, HEADERS), spark.createDataFrame(kvs, KVS), **kw)
    return sorted((tuple(r) for r in got.select("cluster_id", "kv_key", "valid_from_rev", "valid_to_rev").collect()), key=repr)


def test_against_brute_force(spark):
    for seed in range(3):
        h, k = made(seed)
        assert run(spark, h, k) == brute(h, k) == run(spark, h, k, broadcast_snapshots=0)


def test_hot_entity_spans_partitions(spark):
    h, k = made(7, snaps=120, hot=True)
    assert run(spark, h, k) == brute(h, k)


def test_complete_snapshot_without_rows_ends_versions(spark):
    h = [(1, "/r", 1, 10, 1), (2, "/r", 1, 20, 0)]
    assert run(spark, h, [(1, "a", "", 5, 5)]) == [(1, "a", 5, 20)]


def test_incomplete_snapshot_ends_nothing(spark):
    h = [(1, "/r", 1, 10, 1), (2, "/r", 1, 20, 3)]
    assert run(spark, h, [(1, "a", "x", 5, 5)]) == [(1, "a", 5, -1)]


def test_nulls_and_empty_tables(spark):
    h = [(1, None, None, 10, 1), (2, None, None, 20, None), (None, "/r", 1, 5, 1), (3, "/r", 1, None, 1)]
    k = [(1, "a", "x" * 200_000, 5, 5), (1, None, "x", 1, 1), (None, "a", "y", 1, 1), (3, "a", "y", 1, 1), (9, "a", "z", 1, 1)]
    assert run(spark, h, k) == [(None, "a", 5, -1)]
    assert run(spark, [], []) == []
    assert run(spark, [(1, "/r", 1, 10, 0)], []) == []


def test_extra_columns_with_clashing_names(spark):
    h = spark.createDataFrame([(1, "/r", 1, 10, 1, "x")], HEADERS + ", kv_key string")
    k = spark.createDataFrame([(1, "a", "v", 5, 5, 99)], KVS + ", revision bigint")
    assert [tuple(r)[:4] for r in snapshot_history(h, k).collect()] == [(1, "a", 5, -1)]
