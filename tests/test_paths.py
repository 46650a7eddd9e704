"""Pairs with a path condition: the cases of free, malloc and branches by hand, and random graphs against a search for each pair."""

import random
from collections import deque

import pytest

from evidark.operators import paths

EVENT = "fn string, node long, symbol string, kind string, id string, ordinal int"


def pairs(spark, edges, definitions, events):
    frames = [spark.createDataFrame(x, k) for x, k in ((edges, "fn string, src long, dst long"), (definitions, "fn string, node long, symbol string"), (events, EVENT))]
    return sorted(tuple(r) for r in paths.lifetime_pairs(*frames).collect())


def chain(n):
    return [("f", i, i + 1) for i in range(n)]


def test_release_then_access(spark):
    events = [("f", 1, "p", "release", "r", 1), ("f", 3, "p", "access", "a", 2), ("f", 1, "p", "access", "same node", 3), ("f", 3, "q", "access", "other", 4)]
    assert pairs(spark, chain(4), [], events) == [("use_after_release", "f", "p", "r", "a", 1, 3, [1, 2, 3])]
    assert pairs(spark, chain(4), [("f", 2, "p")], events) == []  # defined anew between
    assert pairs(spark, chain(4), [("f", 2, "q"), ("g", 2, "p")], events) != []
    assert pairs(spark, chain(4), [("f", 3, "p"), ("f", 1, "p")], events) != []  # at the ends only
    around = chain(4) + [("f", 1, 3)]
    assert pairs(spark, around, [("f", 2, "p")], events) == [("use_after_release", "f", "p", "r", "a", 1, 3, [1, 3])]


def test_order_of_releases_and_loops(spark):
    events = [("f", 1, "p", "release", "r1", 1), ("f", 3, "p", "release", "r2", 2), ("f", 2, "p", "check", "c", 3), ("f", 0, "p", "use", "u", 4)]
    back = chain(3) + [("f", 3, 0)]
    assert pairs(spark, back, [], events) == [("double_release", "f", "p", "r1", "r2", 1, 3, [1, 2, 3]), ("toctou_check_use", "f", "p", "c", "u", 2, 0, [2, 3, 0])]


def brute(edges, definitions, events):
    near, kills, out = {}, set(definitions), []
    for f, a, b in edges:
        near.setdefault((f, a), set()).add(b)

    def path(f, a, b, symbol):
        queue, seen = deque([(a, [a])]), {a}
        while queue:
            x, p = queue.popleft()
            if x == b:
                return p
            for y in sorted(near.get((f, x), ())):
                if y not in seen and (y == b or (f, y, symbol) not in kills):
                    seen.add(y)
                    queue.append((y, [*p, y]))
        return None

    for fact, (first, second, later) in paths.LIFETIME.items():
        for a in events:
            for b in events:
                if (a[0], a[2]) == (b[0], b[2]) and (a[3], b[3]) == (first, second) and a[1] != b[1] and (not later or a[5] < b[5]):
                    if p := path(a[0], a[1], b[1], a[2]):
                        out.append((fact, a[0], a[2], a[4], b[4], a[1], b[1], p))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    fns = [f"f{i}" for i in range(6)]
    edges = [(f, rng.randint(0, 9), rng.randint(0, 9)) for f in fns for _ in range(14)]
    definitions = [(f, rng.randint(0, 9), rng.choice("pq")) for f in fns for _ in range(4)]
    kinds = ["release", "access", "check", "use"]
    events = [(f, rng.randint(0, 9), rng.choice("pq"), rng.choice(kinds), f"{f}{i}", i) for f in fns for i in range(16)]
    got = pairs(spark, edges, definitions, events)
    assert got == brute(edges, definitions, events) and len(got) > 20


def test_nothing(spark):
    assert pairs(spark, [], [], []) == [] == pairs(spark, chain(3), [], [("f", 1, "p", "release", "r", 1)])
