"""Pairs of events on one symbol that a path joins on which nothing defines the symbol anew.

Flow graphs, definitions and events of all functions are three tables. A small function is one row and walked there; in
large ones many sources walk at once in one frontier table, so a round costs a join and not a graph search for each pair.
Pairs are made from nodes reached, never before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidark.operators.graph import large_graphs, small_walks
from evidark.sources.session import written

#: Facts, the kinds of their first and second event, and whether the second must stand later in the code.
LIFETIME = {"use_after_release": ("release", "access", False), "double_release": ("release", "release", True), "toctou_check_use": ("check", "use", False)}

STATE = ["fn", "symbol", "start"]


def reached(edges: DataFrame, definitions: DataFrame, sources: DataFrame) -> DataFrame:
    """fn, symbol, start, node, distance, path: all that each source (fn, symbol, start) reaches.

    A path may end at a node that defines the symbol, and start at one, but not pass one. Of shortest paths, the first in
    the nodes' order. ``edges``: fn, src, dst; ``definitions``: fn, node, symbol. Nodes are longs.
    """
    large = large_graphs(edges, sources, ["fn"])
    if large.isEmpty():
        return small_walks(edges, sources, definitions, ["fn"]).select(*STATE, "node", "distance", "path")
    few, rest = [[x.join(large, "fn", how) for x in (edges, definitions, sources)] for how in ("left_anti", "left_semi")]
    return small_walks(few[0], few[2], few[1], ["fn"]).select(*STATE, "node", "distance", "path").union(frontiers(*rest))


def frontiers(edges: DataFrame, definitions: DataFrame, sources: DataFrame) -> DataFrame:
    """What ``reached`` tells, by rounds of one step in all functions at once."""
    edges = written(edges.select("fn", F.col("src").alias("node"), "dst").distinct(), "edges")
    stops = written(definitions.select("fn", "symbol", "node").distinct(), "definitions")
    kept = [*STATE, "node", "distance", "path"]
    first = sources.select(*STATE).distinct().select(*STATE, F.col("start").alias("node"), F.lit(0).alias("distance"), F.array("start").alias("path"))
    found = frontier = written(first, "frontier0")
    d = 0
    while not frontier.isEmpty():
        leave = frontier if d == 0 else frontier.join(stops, ["fn", "symbol", "node"], "left_anti")
        d += 1
        step = leave.join(edges, ["fn", "node"]).groupBy(*STATE, F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        step = step.join(found.select(*STATE, "node"), [*STATE, "node"], "left_anti")
        frontier = written(step.select(*STATE, "node", F.lit(d).alias("distance"), F.array_append("path", F.col("node")).alias("path")).select(*kept), f"frontier{d}")
        found = found.union(frontier)
    return found


def lifetime_pairs(edges: DataFrame, definitions: DataFrame, events: DataFrame, facts: dict[str, tuple[str, str, bool]] = LIFETIME) -> DataFrame:
    """fact, fn, symbol, first_id, second_id, source, sink, path for each pair of events that a fact asks for.

    ``events``: fn, node, symbol, kind, id, ordinal (their order in the code). Events of one node make no pair. Symbols
    without both kinds of a fact are not walked at all.
    """
    events = written(events.select("fn", "node", "symbol", "kind", "id", "ordinal").distinct(), "events")
    kinds = events.groupBy("fn", "symbol").agg(F.collect_set("kind").alias("kinds"))  # a few names a symbol
    has = lambda kind: F.array_contains("kinds", kind)
    asked = F.lit(False)
    for first, second, _ in facts.values():
        asked = asked | ((F.col("kind") == first) & has(first) & has(second))
    sources = events.join(kinds, ["fn", "symbol"]).where(asked).select("fn", "symbol", F.col("node").alias("start"))
    found = reached(edges, definitions, sources).where("start <> node")
    wanted = F.array(*[F.struct(F.lit(f).alias("fact"), F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(later).alias("later")) for f, (a, b, later) in facts.items()])
    met = found.withColumn("f", F.explode(wanted)).select(*STATE, "node", "path", "f.*")
    left = events.select("fn", "symbol", F.col("node").alias("start"), F.col("kind").alias("first"), F.col("id").alias("first_id"), F.col("ordinal").alias("_a"))
    right = events.select("fn", "symbol", "node", F.col("kind").alias("second"), F.col("id").alias("second_id"), F.col("ordinal").alias("_b"))
    pairs = met.join(right, ["fn", "symbol", "node", "second"]).join(left, [*STATE, "first"]).where(~F.col("later") | (F.col("_a") < F.col("_b")))
    return pairs.select("fact", "fn", "symbol", "first_id", "second_id", F.col("start").alias("source"), F.col("node").alias("sink"), "path")
