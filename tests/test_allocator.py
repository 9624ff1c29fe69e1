from __future__ import annotations

import random
from collections import Counter
from contextlib import contextmanager

from tidemark.operators import allocator
from tidemark.operators.allocator import Item, Member, allocate, allocate_frame, converge, fair_share


def check(items, members, got):
    zone = {m.id: m.zone for m in members}
    load = Counter(m for _, m in got)
    assert all(load[m.id] <= m.limit for m in members)
    by = {i.id: [m for x, m in got if x == i.id] for i in items}
    for i in items:
        assert len(by[i.id]) == len(set(by[i.id])) == i.replication
        if i.replication > 1:
            assert len({zone[m] for m in by[i.id]}) > 1
    return load


def test_balanced_replicated_over_zones():
    items = [Item(f"i{k}", 1 + k % 3) for k in range(30)]
    members = [Member(f"m{k}", f"z{k % 2}", 20) for k in range(4)]
    load = check(items, members, allocate(items, members))
    assert max(load.values()) - min(load.values()) <= 1


def test_few_moves_when_a_member_leaves():
    items = [Item(f"i{k:02d}", 2) for k in range(24)]
    members = [Member(f"m{k}", f"z{k % 2}", 20) for k in range(6)]
    before = allocate(items, members)
    assert allocate(items, members, before) == before
    left = [Member(m.id, m.zone, m.limit, m.id == "m0") for m in members]
    after = allocate(items, left, before)
    check(items, left[1:], after)
    assert len(before - after) <= sum(m == "m0" for _, m in before) + 4


def test_limits_win_over_demand():
    got = allocate([Item("a", 2), Item("b", 2)], [Member("m", "z", 1), Member("n", "y", 2)])
    assert Counter(m for _, m in got) == {"m": 1, "n": 2}
    assert allocate([], [Member("m", "z", 1)]) == set() and allocate([Item("a", 1)], []) == set()


def test_networks():
    rnd = random.Random(1)
    items = [Item(f"i{k:03d}", rnd.choice((1, 2, 3))) for k in range(60)]
    members = [Member(f"m{k}", f"z{k % 3}", 30) for k in range(6)]
    check(items, members, allocate(items, members, network=20))


def test_converge_adds_before_it_removes():
    steps = converge({("a", "x"), ("gone", "x")}, {("a", "y")}, [Item("a", 1)])
    assert steps == [("add", "a", "y"), ("remove", "a", "x"), ("remove", "gone", "x")]


def test_fair_share():
    assert [fair_share(10, 5, 20), fair_share(10, 50, 20), fair_share(7, 1, 100), fair_share(0, 1, 0)] == [3, 10, 1, 0]


def test_any_number_of_members(spark):
    """More members than were once allowed: all copies are placed within limits and over zones, and stay where they are when solved again."""
    items = spark.range(300).selectExpr("cast(id as string) as id", "cast(id % 3 + 1 as int) as replication")
    members = spark.range(10_050).selectExpr("cast(id as string) as id", "cast(id % 3 as string) as zone", "1 as limit", "false as exiting")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    got = allocate_frame(items, members, network=50)
    everyone = [Member(str(k), str(k % 3), 1) for k in range(10_050)]
    check([Item(str(k), k % 3 + 1) for k in range(300)], everyone, pairs(got))
    assert pairs(allocate_frame(items, members, got, network=50)) == pairs(got)


def test_parts_of_limits_add_up(spark):
    """With as many places as copies in each zone, fair parts of the limits leave little out."""
    items = spark.range(400).selectExpr("cast(id as string) as id", "1 as replication")
    for limit, members in ((1, 400), (40, 10)):
        of = spark.range(members).selectExpr("cast(id as string) as id", "'z' as zone", f"{limit} as limit", "false as exiting")
        load = Counter(r.member for r in allocate_frame(items, of, network=50).collect())
        assert max(load.values()) <= limit and sum(load.values()) > 0.85 * 400


def test_dealing_is_no_worse_than_a_flow():
    rnd = random.Random(4)
    for _ in range(60):
        items = [Item(f"i{k:02d}", rnd.choice((1, 2, 3))) for k in range(rnd.randint(1, 12))]
        members = [Member(f"m{k}", f"z{rnd.randint(0, 2)}", rnd.randint(1, 6)) for k in range(rnd.randint(1, 7))]
        limits = {m.id: m.limit for m in members}
        current = {(i.id, m.id) for i in items for m in members if rnd.random() < 0.2}
        for now in (set(), current):
            got = allocator._solve(items, list(members), now, limits, limits)
            with without_dealing() as plain:
                want = plain(items, list(members), now, limits, limits)
            assert len(got) == len(want) and (not now or len(got & now) >= len(want & now))
            zones = {m.id: m.zone for m in members}
            assert all(n <= limits[m] for m, n in Counter(m for _, m in got).items())
            for i in items:
                mine = [zones[m] for x, m in got if x == i.id]
                assert len(mine) <= i.replication and (i.replication == 1 or len(set(zones.values())) == 1 or len(mine) < i.replication or len(set(mine)) > 1)


@contextmanager
def without_dealing():
    """_solve without dealing."""
    deal = allocator._deal
    allocator._deal = lambda *_: None
    try:
        yield allocator._solve
    finally:
        allocator._deal = deal
