"""Connected components of an edge table by contraction; no vertex or edge leaves the executors.

Each round hashes vertices anew, points every vertex at the neighbour (or itself) with the smallest hash, and replaces
both ends of each edge by what they point at. A constant share of the vertices goes in each round, so the number of
rounds grows with the logarithm of the vertices. Each round is a written table; sums by vertex are combined before the
shuffle, and the joins on a hub's key are inner joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every vertex of ``edges`` (columns a, b: long); equal roots mean one component."""
    edges = written(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        near = edges.select("a", "b").union(edges.select("b", "a"))
        first = near.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("id"))
        to = written(spark, first.select(F.col("a").alias("node"), F.least("m", own)["id"].alias("root")), f"to{turn}")
        for end in ("a", "b"):
            moved = (edges if end == "a" else moved).join(to.select(F.col("node").alias(end), F.col("root").alias("new")), end).drop(end).withColumnRenamed("new", end)
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(spark, moved, f"edges{turn}")
        if labels is None:
            labels = to
        else:
            step = to.select(F.col("node").alias("at"), F.col("root").alias("next"))
            labels = written(spark, labels.join(step, labels.root == step.at, "left").select("node", F.coalesce("next", "root").alias("root")), f"labels{turn}")
        turn += 1
    return spark.createDataFrame([], "node long, root long") if labels is None else labels
