"""Assign items to members: replicated, spread over zones, balanced, with as few moves as possible.

allocate() solves on the driver, one network of `network` items after the other; allocate_frame() takes tables and
solves the networks in parallel, each with its own part of the members' limits. In each, a flow goes from every item (as much as
its replication) over one edge per zone (at most replication - 1 where two zones are to be had) to
the members, whose capacity is their fair share first and their limit where that is not enough.
Existing assignments are tried first, so that a flow which can stay does. Where copies can be dealt out one after the other
within the fair shares, that is done, and no edges are made.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, width


@dataclass(frozen=True)
class Item:
    id: str
    replication: int


@dataclass(frozen=True)
class Member:
    id: str
    zone: str
    limit: int
    exiting: bool = False


class _Flow:
    """Maximum flow by blocking flows along shortest paths; edges are tried in the order they were added."""

    def __init__(self) -> None:
        self.edges: dict[object, list[list]] = {}

    def edge(self, a, b, capacity: int) -> list:
        there, back = [b, capacity, None], [a, 0, None]
        there[2], back[2] = back, there
        self.edges.setdefault(a, []).append(there)
        self.edges.setdefault(b, []).append(back)
        return there

    def augment(self, source, sink) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                at = queue.popleft()
                for to, capacity, _ in self.edges.get(at, ()):
                    if capacity and to not in level:
                        level[to] = level[at] + 1
                        queue.append(to)
            if sink not in level:
                return
            # All paths of this length: what an edge did not lead to once, it does not lead to later either.
            tried = dict.fromkeys(level, 0)
            path: list[list] = []
            at = source
            while True:
                edges, k = self.edges.get(at, ()), tried[at]
                while k < len(edges) and not (edges[k][1] and level.get(edges[k][0], -1) == level[at] + 1):
                    k += 1
                tried[at] = k
                if k < len(edges):
                    path.append(edges[k])
                    at = edges[k][0]
                    if at == sink:
                        for e in path:
                            e[1] -= 1
                            e[2][1] += 1
                        path, at = [], source
                elif path:
                    at = path.pop()[2][0]
                    tried[at] += 1
                else:
                    break


def fair_share(limit: int, wanted: int, capacity: int) -> int:
    """ceil(limit * min(wanted / capacity, 1))"""
    return -(-limit * min(wanted, capacity) // capacity) if capacity else 0


def _deal(ordered: list[Item], zones: dict[str, list[Member]], share: dict[str, int], placed: set[tuple[str, str]]) -> set[tuple[str, str]] | None:
    """placed and all other copies, each to the zone and there to the member with most of its share left; None if one copy finds no place."""
    zone_of = {m.id: z for z, ms in zones.items() for m in ms}
    left = {m: share[m] for m in zone_of}
    had: dict[str, list[str]] = {}
    for i, m in placed:
        left[m] -= 1
        had.setdefault(i, []).append(m)
    turns = {z: [(-left[m.id], at, m.id) for at, m in enumerate(ms) if left[m.id] > 0] for z, ms in zones.items()}
    order = [(sum(t[0] for t in ts), z) for z, ts in turns.items() if ts]
    for heap in (order, *turns.values()):
        heapify(heap)
    out = set(placed)
    for i in ordered:
        most = i.replication - 1 if len(zones) > 1 and i.replication > 1 else i.replication
        mine = had.get(i.id, [])
        used: dict[str, int] = {}
        for m in mine:
            used[zone_of[m]] = used.get(zone_of[m], 0) + 1
        aside: list[tuple[list, tuple]] = []  # what this item may not take again, and where it belongs
        for _ in range(i.replication - len(mine)):
            while order:
                total, z = heappop(order)
                ts = turns[z]
                while ts and ts[0][2] in mine:
                    aside.append((ts, heappop(ts)))
                if ts and used.get(z, 0) < most:
                    break
                aside.append((order, (total, z)))
            else:
                return None
            n, at, m = heappop(ts)
            out.add((i.id, m))
            used[z] = used.get(z, 0) + 1
            if n < -1:
                aside.append((ts, (n + 1, at, m)))
            if total < -1:
                heappush(order, (total + 1, z))
        for heap, x in aside:
            heappush(heap, x)
    return out


def _solve(items: list[Item], members: list[Member], current: set[tuple[str, str]], room: dict[str, int], share: dict[str, int]) -> set[tuple[str, str]]:
    zones: dict[str, list[Member]] = {}
    for m in members:
        zones.setdefault(m.zone, []).append(m)
    ordered = sorted(items, key=lambda i: i.id)
    limits = {m.id: max(0, min(share[m.id], room[m.id])) for m in members}
    if not current and (dealt := _deal(ordered, zones, limits, set())) is not None:
        return dealt
    flow = _Flow()
    spread = len(zones) > 1
    sinks = {m.id: flow.edge(("member", m.id), "sink", 0) for m in members}
    links: dict[tuple[str, str], list] = {}
    for i in ordered:
        flow.edge("source", ("item", i.id), i.replication)
        for z in sorted(zones):
            flow.edge(("item", i.id), ("item", i.id, z), i.replication - 1 if spread and i.replication > 1 else i.replication)
    kept = {i.id for i in items}
    held: dict[tuple[str, str], list[Member]] = {}
    for z, ms in zones.items():
        ms.sort(key=lambda m: m.id)
        for i in ordered:
            if there := [m for m in ms if (i.id, m.id) in current] if current else []:
                held[z, i.id] = there
    for early in (True, False):  # existing assignments first, then all others
        for z in sorted(zones):
            for i in ordered:
                there = held.get((z, i.id), [])
                for m in there if early else [m for m in zones[z] if m not in there] if there else zones[z]:
                    links[i.id, m.id] = flow.edge(("item", i.id, z), ("member", m.id), 1)
        for capacity in (share, room):  # fair shares before limits
            for m in members:
                used = sinks[m.id][2][1]
                sinks[m.id][1] = max(0, min(capacity[m.id], room[m.id]) - used)
            flow.augment("source", "sink")
            if early:
                break
        if early and (dealt := _deal(ordered, zones, limits, {k for k, e in links.items() if e[2][1]})) is not None:
            return dealt
    return {k for k, e in links.items() if e[2][1] and k[0] in kept}


def allocate(items: list[Item], members: list[Member], current: set[tuple[str, str]] | None = None, network: int = 10_000) -> set[tuple[str, str]]:
    """(item, member) pairs. Exiting members get nothing; what cannot be placed within limits is left unplaced."""
    alive = [m for m in members if not m.exiting and m.limit > 0]
    known = {m.id for m in alive}
    current = {(i, m) for i, m in current or set() if m in known}
    wanted, capacity = sum(i.replication for i in items), sum(m.limit for m in alive)
    room = {m.id: m.limit for m in alive}
    out: set[tuple[str, str]] = set()
    ordered = sorted(items, key=lambda i: i.id)
    for at in range(0, len(ordered), network):
        part = ordered[at : at + network]
        some = sum(i.replication for i in part)
        share = {m.id: fair_share(m.limit, some if len(ordered) > network else wanted, capacity) for m in alive}
        got = _solve(part, alive, current, room, share)
        for _, m in got:
            room[m] -= 1
        out |= got
    return out


def converge(current: set[tuple[str, str]], desired: set[tuple[str, str]], items: list[Item]) -> list[tuple[str, str, str]]:
    """Steps ('add' or 'remove', item, member), additions of an item before its removals, so that it never has too few."""
    added, removed = {}, {}
    for into, pairs in ((added, desired - current), (removed, current - desired)):
        for k in sorted(pairs):
            into.setdefault(k[0], []).append(k)
    steps = []
    for i in sorted(items, key=lambda i: i.id):
        steps += [("add", *k) for k in added.get(i.id, ())]
        steps += [("remove", *k) for k in removed.get(i.id, ())]
    known = {i.id for i in items}
    return steps + [("remove", *k) for k in sorted(current) if k[0] not in known]


def allocate_frame(items: DataFrame, members: DataFrame, current: DataFrame | None = None, network: int = 2_000) -> DataFrame:
    """item, member. items: id, replication; members: id, zone, limit, exiting; current: item, member.

    Items fall into networks by a hash of their ids. Of n networks each may use limit // n places of a member, and some
    one more, beginning at another network for each member of a zone; so limits hold for all of them together, and a network gets
    only the members of which it has a place. There may be any number of members: none are gathered on the driver.
    """
    spark = items.sparkSession
    n = max(1, -(-items.count() // network))
    wide = width(spark)
    net = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = (current if current is not None else spark.createDataFrame([], "item string, member string")).groupBy(F.col("item").alias("id")).agg(F.collect_set("member").alias("held"))
    rows = items.select("id", F.col("replication").cast("int").alias("replication")).dropDuplicates(["id"]).join(held, "id", "left").withColumn("network", net)
    alive = members.where("not coalesce(exiting, false) and limit > 0").select("id", "zone", F.col("limit").cast("bigint").alias("limit"), F.pmod(F.xxhash64("id"), F.lit(wide)).alias("bucket"))
    nth = F.row_number().over(Window.partitionBy("zone", "bucket").orderBy("id")).cast("bigint")
    begun = alive.withColumn("begin", nth + F.col("bucket") * n / wide + F.pmod(F.xxhash64("zone"), F.lit(n)))
    each = begun.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("limit", F.lit(n)) - 1)).alias("k"))
    network_of = F.pmod(F.col("begin").cast("bigint") + F.col("k"), F.lit(n)).cast("int")
    places = F.floor(F.col("limit") / n) + F.when(F.col("k") < F.col("limit") % n, 1).otherwise(0)
    # In each network another order, so that members of as many places are not always taken in that of their ids.
    split = each.select("id", "zone", places.cast("bigint").alias("limit"), network_of.alias("network"), F.xxhash64("id", network_of).alias("turn"))

    def solve(wanted, offered):
        import pyarrow as pa

        order = offered.sort_by([("turn", "ascending"), ("id", "ascending")])
        part = [Member(m, zone, limit) for m, zone, limit in zip(*(order[c].to_pylist() for c in ("id", "zone", "limit")), strict=True)]
        ids, replication, before = (wanted[c].to_pylist() for c in ("id", "replication", "held"))
        now = {(i, m) for i, h in zip(ids, before, strict=True) for m in h or ()}
        got = sorted(allocate([Item(i, r) for i, r in zip(ids, replication, strict=True)], part, now, network=len(ids) + 1))
        return pa.table({"item": pa.array([i for i, _ in got], pa.string()), "member": pa.array([m for _, m in got], pa.string())})

    # One network a partition as far as the session is wide: rows are few, so that they would else be put together into one task.
    spread = [d.repartition(min(n, wide), "network").groupBy("network") for d in (rows, split)]
    return materialize(spread[0].cogroup(spread[1]).applyInArrow(solve, "item string, member string"), "allocation")


def converge_frame(current: DataFrame, desired: DataFrame) -> DataFrame:
    """item, member, step, at: what to do, and in which order for each item; additions come before removals. In: item, member."""
    a = current.select("item", "member").distinct().withColumn("_a", F.lit(True))
    b = desired.select("item", "member").distinct().withColumn("_b", F.lit(True))
    steps = a.join(b, ["item", "member"], "full_outer").where("_a is null or _b is null").select("item", "member", F.when(F.col("_a").isNull(), "add").otherwise("remove").alias("step"))
    return steps.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy("step", "member")))
