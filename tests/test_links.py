"""Orphan references and merge hierarchies against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.hierarchy import hierarchy
from ledgerloom.operators.orphans import ARRIVALS, REFS, OrphanTracker

T0 = datetime(2024, 1, 1)
day = lambda n: T0 + timedelta(days=n)


def ref(child, key, at, parent="p"):
    return ("f", parent, child, key, key, at)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cases(state):
    return {(r.child, r.key) for r in state.waiting.union(state.resolved.drop("resolved_at")).collect()}


def test_batches_find_what_brute_force_finds(spark):
    rnd = random.Random(3)
    refs = [ref(f"c{rnd.randrange(40)}", rnd.choice(["hot", f"k{rnd.randrange(30)}", None]), rnd.choice([day(rnd.randrange(90)), None])) for _ in range(400)]
    came = [("p", rnd.choice([f"k{rnd.randrange(20)}", "hot"]), rnd.choice([day(rnd.randrange(90)), None])) for _ in range(30)]
    want = set()
    for _, _, child, key, _, at in refs:
        if key is None:
            continue
        times = [t for _, k, t in came if k == key]
        known = [t for t in times if t]
        if not times or (known and at and at < min(known)):
            want.add((child, key))
    tracker = OrphanTracker(spark, ["p"])
    cuts = [None, day(30), day(60), None]
    for low, high in zip(cuts, cuts[1:]):
        inside = lambda t: (t is None and high is None) or (t is not None and (low is None or t >= low) and (high is None or t < high))  # noqa: E731,B023
        state = tracker.advance(spark.createDataFrame([r for r in refs if inside(r[5])], REFS), spark.createDataFrame([c for c in came if inside(c[2])], ARRIVALS))
    assert cases(state) == want


def test_late_parent_resolves_and_deletion_reopens(spark):
    t = OrphanTracker(spark, ["p"])
    refs = spark.createDataFrame([ref("a", "x", day(1)), ref("b", "y", day(1)), ref("b", "y", day(1))], REFS)
    s = t.advance(refs, spark.createDataFrame([("p", "y", day(0))], ARRIVALS))
    assert [(r.child, r.reason) for r in s.waiting.collect()] == [("a", "missing")]
    s = t.advance(None, spark.createDataFrame([("p", "x", day(3))], ARRIVALS))
    assert s.waiting.count() == 0 and [(r.child, r.resolved_at) for r in s.resolved.collect()] == [("a", day(3))]
    s = t.advance(None, None, spark.createDataFrame([("p", "y", day(5))], ARRIVALS), history=refs)
    assert [(r.child, r.reason) for r in s.waiting.collect()] == [("b", "deleted")]
    s = t.advance(spark.createDataFrame([ref("c", "y", day(6))], REFS), None)
    assert sorted((r.child, r.reason) for r in s.waiting.collect()) == [("b", "deleted"), ("c", "deleted")]
    s = t.advance(None, spark.createDataFrame([("p", "y", day(7))], ARRIVALS))
    assert s.waiting.count() == 0


def test_empty_batches(spark):
    s = OrphanTracker(spark, ["p"]).advance(None, None)
    assert s.waiting.count() == 0 and s.resolved.count() == 0


def brute(parent):
    out = {}
    for n in parent:
        path, at = [n], n
        while parent.get(at) is not None and parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        nxt = parent.get(at)
        loop = nxt is not None and nxt in parent
        out[n] = (min(path[path.index(nxt):]) if loop else at, len(path) - 1, loop, path[1:])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_is_what_walking_gives(spark, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), 120)
    parent = {i: rnd.choice([None, rnd.choice(ids), rnd.choice(ids), i if seed else 7, 5000]) for i in ids}
    chain = list(range(2000, 2070))
    parent |= {a: b for a, b in zip(chain, chain[1:])} | {chain[-1]: None}
    data = [("k", a, b, "x") for a, b in parent.items()] + [("other", 1, 1, "x"), ("k", None, 3, "x")]
    h = hierarchy(spark, spark.createDataFrame(data, "kind string, id bigint, parent bigint, root string"), paths=True)
    got = {r.id: (r.root, r.depth, r.in_loop, list(r.path)) for r in h.nodes.where("kind = 'k'").collect()}
    assert got == brute(parent)
    below = {(r.id, r.descendant) for r in h.descendants().where("kind = 'k'").collect()}
    assert below == {(a, n) for n, (_, _, _, p) in brute(parent).items() for a in p}
    assert h.nodes.where("kind = 'other'").first().root == 1
    flat = {r.id: r.root for r in hierarchy(spark, spark.createDataFrame(data, "kind string, id bigint, parent bigint, root string")).nodes.where("kind = 'k'").collect()}
    assert flat == {n: v[0] for n, v in got.items()}


def test_hierarchy_of_nothing(spark):
    h = hierarchy(spark, spark.createDataFrame([], "kind string, id bigint, parent bigint"), paths=True)
    assert rows(h.nodes) == [] and rows(h.loops) == [] and rows(h.descendants()) == []


def test_hot_keys_join_like_others(spark, monkeypatch):
    from ledgerloom.operators import joins

    monkeypatch.setattr(joins, "HOT_FROM_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 9)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 7)], "k int, r string")
    got = rows(joins.lookup_join(left, right, ["k"], "left", left_rows=58).selectExpr("v", "coalesce(k, -1)", "coalesce(r, '')"))
    assert got == rows(left.join(right, "k", "left").selectExpr("v", "coalesce(k, -1)", "coalesce(r, '')"))


def test_deletion_reopens_from_state(spark):
    t = OrphanTracker(spark, ["p"], deletions=True)
    came = lambda key, at: spark.createDataFrame([("p", key, at)], ARRIVALS)
    t.advance(spark.createDataFrame([ref("a", "x", day(1)), ref("b", "y", day(1)), ref("b", "y", day(1)), ref("n", None, day(1))], REFS), came("y", day(0)))
    t.advance(None, came("x", day(3)))
    s = t.advance(None, None, spark.createDataFrame([("p", "y", day(5)), ("p", "x", day(5)), ("p", "z", day(5))], ARRIVALS))
    assert sorted((r.child, r.reason) for r in s.waiting.collect()) == [("a", "deleted"), ("b", "deleted")]
    s = t.advance(spark.createDataFrame([ref("c", "y", day(6))], REFS), came("x", day(7)))
    assert sorted((r.child, r.reason) for r in s.waiting.collect()) == [("b", "deleted"), ("c", "deleted")]
    s = t.advance(None, came("y", day(8)), spark.createDataFrame([("p", "x", day(9))], ARRIVALS))
    assert sorted((r.child, r.reason) for r in s.waiting.collect()) == [("a", "deleted")]


def test_many_batches_merge_the_index(spark, monkeypatch):
    from ledgerloom.operators import orphans

    monkeypatch.setattr(orphans, "COMPACT", 2)
    t = OrphanTracker(spark, ["p"])
    for i in range(5):
        s = t.advance(spark.createDataFrame([ref(f"c{i}", f"k{i - 1}", day(i))], REFS), spark.createDataFrame([("p", f"k{i}", day(i))], ARRIVALS))
        assert len(s.index) <= 2
    assert cases(s) == {("c0", "k-1")}


def test_paths_do_not_go_round_loops(spark):
    parent = {i: i ^ 1 for i in range(400)} | {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000: 1003, 2001: 2000, 3000: 3000, 3001: 3000}
    h = hierarchy(spark, spark.createDataFrame([("k", a, b) for a, b in parent.items()], "kind string, id bigint, parent bigint"), paths=True)
    assert {r.id: (r.root, r.depth, r.in_loop, list(r.path)) for r in h.nodes.collect()} == brute(parent)


def test_work_folders_are_removed(spark, tmp_path):
    import os

    from ledgerloom.session import Workspace, clean_up

    with Workspace(spark, "w") as w:
        w.table(spark.range(3))
        assert os.path.isdir(w.root)
    assert not os.path.isdir(w.root)
    kept = Workspace(spark, "k")
    parts = kept.split(spark.range(10), F.col("id") % 3, 4)
    assert [n for _, n in parts] == [4, 3, 3, 0] and rows(parts[1][0]) == [(1,), (4,), (7,)]
    clean_up(spark)
    assert not os.path.isdir(kept.root)
