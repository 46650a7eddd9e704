"""Joins of code spans. Bounds are inclusive at both ends; every join has an equality key beside its range."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("case_id", "file")


def overlaps(a: str, b: str, keys: tuple[str, ...] = KEYS) -> Column:
    """Whether spans of the aliases ``a`` and ``b`` share a line of one file."""
    out = (F.col(f"{a}.line_start") <= F.col(f"{b}.line_end")) & (F.col(f"{a}.line_end") >= F.col(f"{b}.line_start"))
    for k in keys:
        out = (F.col(f"{a}.{k}") == F.col(f"{b}.{k}")) & out
    return out


def overlap_join(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """candidate_id, truth_id, case_id, file, score for each overlapping pair."""
    c, t = candidates.alias("c"), truths.alias("t")
    return c.join(t, overlaps("c", "t")).select(F.col("c.id").alias("candidate_id"), F.col("t.id").alias("truth_id"), "c.case_id", "c.file", "c.score")


def hits(truths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truths that some candidate overlaps."""
    return truths.alias("t").join(candidates.alias("c"), overlaps("t", "c"), "left_semi")


def misses(truths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truths that no candidate overlaps; they stay in every denominator."""
    return truths.alias("t").join(candidates.alias("c"), overlaps("t", "c"), "left_anti")


def label_candidates(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """candidate_id, labels: each truth labels its smallest overlapping candidate (then best score, then id)."""
    c, t = candidates.alias("c"), truths.alias("t")
    size = F.col("c.line_end") - F.col("c.line_start")
    best = F.min_by("c.id", F.struct(size, -F.col("c.score"), F.col("c.id"))).alias("candidate_id")
    first = c.join(t, overlaps("c", "t")).groupBy("t.id", "t.expert").agg(best)
    return first.groupBy("candidate_id").agg(F.array_sort(F.collect_set("expert")).alias("labels"))


def smallest_container(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """id, container_id: the smallest span of ``outer`` that holds the whole inner span (then first line, then id)."""
    i, o = inner.alias("i"), outer.alias("o")
    holds = (F.col("i.case_id") == F.col("o.case_id")) & (F.col("i.file") == F.col("o.file")) & (F.col("o.line_start") <= F.col("i.line_start")) & (F.col("o.line_end") >= F.col("i.line_end"))
    order = F.struct(F.col("o.line_end") - F.col("o.line_start"), F.col("o.line_start"), F.col("o.id"))
    return i.join(o, holds).groupBy(F.col("i.id").alias("id")).agg(F.min_by("o.id", order).alias("container_id"))


def point_in_interval(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """id, line, interval_id: the smallest interval that holds each point's line; points have id, line and the keys."""
    p, o = points.alias("p"), intervals.alias("o")
    inside = (F.col("p.case_id") == F.col("o.case_id")) & (F.col("p.file") == F.col("o.file")) & F.col("p.line").between(F.col("o.line_start"), F.col("o.line_end"))
    order = F.struct(F.col("o.line_end") - F.col("o.line_start"), F.col("o.line_start"), F.col("o.id"))
    return p.join(o, inside).groupBy("p.id", "p.line").agg(F.min_by("o.id", order).alias("interval_id"))


def nearest_match(points: DataFrame, targets: DataFrame) -> DataFrame:
    """id, target_id, distance: for each row the target of its case and file with the nearest first line.

    Two as-of lookups over one sorted union (last target at or before, first at or after), so a large case costs a sort
    instead of all pairs.
    """
    both = points.select("case_id", "file", F.col("line_start").alias("at"), F.col("id"), F.lit(None).cast("string").alias("target"))
    both = both.unionByName(targets.select("case_id", "file", F.col("line_start").alias("at"), F.lit(None).cast("string").alias("id"), F.col("id").alias("target")))
    by_line = Window.partitionBy("case_id", "file").orderBy("at")
    pair = F.when(F.col("target").isNotNull(), F.struct("at", "target"))
    # ties at a line go to the smallest id, so both sides look up (line, smallest id at it)
    at_line = Window.partitionBy("case_id", "file", "at")
    least = F.min(pair).over(at_line)
    found = both.withColumn("least", least)
    found = found.withColumn("before", F.last("least", True).over(by_line.rangeBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("after", F.first("least", True).over(by_line.rangeBetween(0, Window.unboundedFollowing)))
    sides = [F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{s}.at")).alias("distance"), F.col(f"{s}.target").alias("target_id"))) for s in ("before", "after")]
    best = F.array_min(F.filter(F.array(*sides), lambda x: x.isNotNull()))
    return found.where("id IS NOT NULL").withColumn("best", best).where("best IS NOT NULL").select("id", "best.target_id", "best.distance")


def near_span_pairs(spans: DataFrame, slack: int = 2) -> DataFrame:
    """Pairs (a < b) of one case and file whose spans come within ``slack`` lines of each other and share the expert."""
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.line_start") <= F.col("b.line_end") + slack) & (F.col("b.line_start") <= F.col("a.line_end") + slack)
    same = (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.file") == F.col("b.file")) & (F.col("a.expert") == F.col("b.expert"))
    return a.join(b, same & near & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def ordered_pairs(calls: DataFrame, symbol: str, place: str, first: Column, second: Column) -> DataFrame:
    """Pairs of one symbol, an event that is ``first`` before one that is ``second``; columns first_id, second_id."""
    a = calls.where(first).select(F.col(symbol).alias("symbol"), F.col(place).alias("pa"), F.col("id").alias("first_id"))
    b = calls.where(second).select(F.col(symbol).alias("symbol"), F.col(place).alias("pb"), F.col("id").alias("second_id"))
    return a.join(b, "symbol").where("pa < pb").select("symbol", "first_id", "second_id")


PAIRS = T.ArrayType(T.StructType([T.StructField("finding", T.IntegerType()), T.StructField("truth", T.IntegerType())]))


def first_free(findings: list[dict] | None, truths: list[dict] | None) -> list[dict]:
    """Places of matched findings and truths: each finding in order takes the first free truth it overlaps."""
    free, out = list(enumerate(truths or [])), []
    for i, x in enumerate(findings or []):
        for k, (j, y) in enumerate(free):
            if x["file"] == y["file"] and x["line_start"] <= y["line_end"] and x["line_end"] >= y["line_start"]:
                out.append({"finding": i, "truth": j})
                del free[k]
                break
    return out


@F.arrow_udf(PAIRS)
def match_first_free(findings: pa.Array, truths: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("finding", pa.int32()), ("truth", pa.int32())]))
    return pa.array([first_free(f, t) for f, t in zip(findings.to_pylist(), truths.to_pylist())], kind)


def greedy_match(findings: DataFrame, truths: DataFrame) -> DataFrame:
    """case_id, finding_id, truth_id: findings in order each take the first truth of their case that is still free.

    Sequential inside a case, whose spans are one array; cases run apart. Matches need an overlap in one file.
    """
    span = ["file", "line_start", "line_end", "id"]
    f = findings.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("id").alias("order"), *span))).alias("f"))
    t = truths.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_start").alias("at"), F.col("id").alias("order"), *span))).alias("t"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["file"].alias("file"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    both = f.join(t, "case_id").withColumn("m", match_first_free(bare("f"), bare("t")))
    return both.select("case_id", "f", "t", F.explode("m").alias("m")).select("case_id", F.col("f")[F.col("m.finding")]["id"].alias("finding_id"), F.col("t")[F.col("m.truth")]["id"].alias("truth_id"))
