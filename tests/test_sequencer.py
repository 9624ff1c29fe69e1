from __future__ import annotations

import random

import pytest

from tidemark.operators.sequencer import Automaton, committed, committed_ascending, producer_states, prune_states

SCHEMA = "journal string, producer string, begin_offset bigint, clock bigint, flags int"
FLAG = {"o": 0, "c": 1, "k": 2, "u": 0x100}

#: Batches of messages (producer, flag, clock) and what each batch commits.
STORY = [
    ("Ac1 Ac2 Ac1 Ac2 Ak3", "c1 c2 k3"),
    ("Ak4", "k4"),
    ("Ac5 Ac7 Ak6", "c5 k6"),
    ("Ac7 Bc1 Ac7 Ac8 Bc2 Ak6", ""),
    ("Bk3", "c1 c2 k3"),
    ("Bc4 Bc1 Bc4 Bc5 Bc6 Bc2 Bc7 Bk8", "c4 c5 c6 c7 k8"),
    ("Bc9 Bc11 Bc12 Bc13 Bk10", "c9 k10"),
    ("Bc11 Ac7 Ac8 Bc12 Ak9", "c7 c8 k9"),
    ("Bk13", "c11 c12 k13"),
    ("Bk8 Bc9 Bk10", "c9 k10"),
]
OUTSIDE = [("Ao1 Ao2", "o1 o2"), ("Ao1 Ao2", ""), ("Ac3 Ac4 Ao5", "o5"), ("Ac6 Au7", "u7"), ("Au7", "")]


def rows(story):
    out, at = [], 0
    for batch, _ in story:
        for m in batch.split():
            out.append(("test/journal", m[0], at, int(m[2:]), FLAG[m[1]]))
            at += 102
    return out


def expected(story):
    out, at = [], 0
    name = {v: k for k, v in FLAG.items()}
    for batch, want in story:
        msgs = batch.split()
        ends = [at + 102 * i for i in range(len(msgs))]
        at += 102 * len(msgs)
        out.append((want.split(), ends))
    return out, name


@pytest.mark.parametrize("story", [STORY, OUTSIDE])
def test_story(spark, story):
    got = committed(spark.createDataFrame(rows(story), SCHEMA)).orderBy("journal", "commit_begin", "begin_offset").collect()
    want, name = expected(story)
    at = 0
    for labels, ends in want:
        here = [r for r in got if r.commit_begin in ends]
        assert [f"{name[r.flags]}{r.clock}" for r in here] == labels
        at += len(here)
    assert at == len(got)


def test_zero_clock_commits_untracked(spark):
    got = committed(spark.createDataFrame([("j", None, 0, 0, 0), ("j", None, 5, 0, 0)], SCHEMA))
    assert got.count() == 2
    assert producer_states(spark.createDataFrame([("j", None, 0, 0, 0)], SCHEMA)).count() == 0


def brute(messages):
    out, state, pending = [], {}, {}
    for j, p, at, clock, flags in sorted(messages, key=lambda m: m[2]):
        a = state.setdefault((j, p), Automaton())
        held = pending.setdefault((j, p), [])
        o, low = a.step(clock, flags)
        if o in ("continue_begin_span", "continue_extend_span"):
            held.append((at, clock))
        elif not o.startswith("continue") and o != "outside_already_acked":
            if o == "ack_commit":
                out += [(x, at) for x, c in held if low < c <= clock]
            held.clear()
            if o != "ack_rollback":
                out.append((at, at))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_streams(spark, seed):
    rnd = random.Random(seed)
    ms = [(f"j{rnd.randrange(2)}", rnd.choice(("A", "B", None)), i * 10, rnd.randrange(1, 30) + i // 4, rnd.choice((0, 1, 1, 1, 2))) for i in range(400)]
    df = spark.createDataFrame(ms, SCHEMA)
    for bits in (26, 6):  # in one shard, and in many
        assert sorted((r.begin_offset, r.commit_begin) for r in committed(df, shard_bits=bits).collect()) == brute(ms)


def test_window_form_agrees_where_clocks_ascend(spark):
    rnd = random.Random(5)
    ms = [("j", rnd.choice("AB"), i, i + 1, rnd.choice((0, 1, 1, 2))) for i in range(300)]
    df = spark.createDataFrame(ms, SCHEMA)
    cols = ["producer", "begin_offset", "commit_begin"]
    assert sorted(map(tuple, committed(df).select(*cols).collect())) == sorted(map(tuple, committed_ascending(df).select(*cols).collect()))


def test_states(spark):
    df = spark.createDataFrame(rows([("Ac1 Ak2 Ac3 Ac4 Bc7", "")]), SCHEMA)
    states = producer_states(df)
    assert sorted(map(tuple, states.select("producer", "last_ack", "begin_offset").collect())) == [("A", 2, 204), ("B", 6, 408)]
    assert [r.producer for r in prune_states(states, 3).collect()] == ["B"]


def test_empty_and_nulls(spark):
    assert committed(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = [(None, "A", 1, 1, 0), ("j", "A", None, 1, 0), ("j", "A", 1, None, 0), ("j", "A", 2, 9, None)]
    assert [r.begin_offset for r in committed(spark.createDataFrame(bad, SCHEMA)).collect()] == [2]
