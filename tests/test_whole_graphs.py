"""Paths over the directed flow of orders, against breadth-first search; components against union by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidark.operators import graph
from evidark.plans import catalog


def brute(edges, start, stop=lambda x: False):
    """Distance and first shortest path of every node."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    found, frontier = {start: (start,)}, [start]
    while frontier:
        step = {}
        for x in frontier:
            if x == start or not stop(x):
                for y in near[x]:
                    if y not in found:
                        step[y] = min(step.get(y, found[x] + (y,)), found[x] + (y,))
        found |= step
        frontier = list(step)
    return found


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("orders"))
    rows = [(k, rng.randint(1, 12), f"1995-01-{rng.randint(1, 28):02}") for k in range(1, 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{path}/orders.parquet")
    by = defaultdict(list)
    for k, c, d in rows:
        by[c].append((d, k))
    chains = [[k for _, k in sorted(x)] for x in by.values()]
    edges = [(c[i], c[j]) for c in chains for i in range(len(c)) for j in ([i + 1] * (c[i] % 5 != 0) + [i + 3] * (c[i] % 3 == 0)) if j < len(c)]
    return path, chains, edges


@pytest.mark.parametrize("name, stop", [("shortest_path", 0), ("path_without_definition", 7)])
def test_paths_by_brute_force(spark, orders, name, stop):
    path, chains, edges = orders
    want = [(c[0], n, len(p) - 1, ",".join(map(str, p))) for c in chains for n, p in brute(edges, c[0], lambda x: stop and x % stop == 0).items()]
    got = catalog.queries()[name](spark, path).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.distance for r in got) > 10


def test_backward_is_not_forward(spark, orders):
    path, chains, edges = orders
    back = [(b, a) for a, b in edges]
    want = [(c[-1], n, len(p) - 1) for c in chains for n, p in brute(back, c[-1]).items()]
    assert sorted(map(tuple, catalog.queries()["backward_slice"](spark, path).collect())) == sorted(want)


def test_depth_and_no_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    starts = spark.createDataFrame([(0,), (4,)], "node long")
    assert graph.distances(edges, starts, depth=2).count() == 6
    assert [r.path for r in graph.distances(edges.limit(0), starts).orderBy("node").collect()] == [[0], [4]]


def test_components(spark):
    rng = random.Random(9)
    pairs = [(f"v{rng.randint(0, 150):03}", f"v{rng.randint(0, 150):03}") for _ in range(90)] + [("alone", "alone"), ("h000", "h001")] + [("hub", f"s{i}") for i in range(50)]
    low = {v: v for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    edges = spark.createDataFrame(pairs, "a string, b string")
    assert {r.node: r.root for r in graph.components(edges).collect()} == low
    assert graph.components(edges.limit(0)).count() == 0
    assert graph.components(edges.where("a = b").withColumn("a", F.col("b"))).collect()[0].root == "alone"


def test_calls_resolve_to_one_function(spark):
    functions = spark.createDataFrame([(1, "f"), (2, "ns::f"), (3, "a::b::g"), (4, "h"), (5, "x::dup"), (6, "y::dup"), (7, "xh")], "key long, name string")
    calls = [("ns::f", None), ("f", None), ("g", 3), ("b::g", 3), ("o -> g", 3), ("o.p . h", 4), ("std:: h", 4), ("x::dup", None), ("z::dup", None), ("a::b::g", 3), ("nothing", None), ("", None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(calls)] + [(4, "g"), (99, None)], "caller long, callee string")
    got = sorted(map(tuple, graph.call_graph(functions, rows).collect()))
    assert got == sorted((i, k) for i, (_, k) in enumerate(calls) if k)
