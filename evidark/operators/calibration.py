"""Threshold sweeps as cumulative windows: one sort over the observed scores instead of one pass for each threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidark.operators import spans
from evidark.operators.metrics import ratio
from evidark.operators.ranking import running


def cumulative(df: DataFrame, by: list[str], score: str, descending: bool, **sums: Column) -> DataFrame:
    """For each distinct score of a group, the sums over all rows at it or beyond (ties together).

    Sums by score are made first, so the ordered windows hold one row for each distinct score; they run over 1,024ths of
    the scores' usual range, 0 to 1.
    """
    per = df.groupBy(*by, score).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    bins = F.least(F.greatest(F.floor(F.col(score) * 1024), F.lit(-1)), F.lit(1024))
    return running(per, by, F.col(score), bins, descending, **{k: k for k in sums}).select(*by, score, *[F.col(f"{k}_upto").alias(k) for k in sums])


def gate_calibration(candidates: DataFrame, truths: DataFrame, target: float = 0.98) -> DataFrame:
    """threshold, retention, kept, reduction of the gate (score >= threshold) that keeps fewest candidates.

    A truth survives while its best overlapping candidate does. Thresholds are the observed scores, 0 and 1. Feasible
    ones keep ``target`` of the truths that candidates hit; of these the fewest kept, then the highest threshold. If none
    is feasible: the best retention, fewest kept, lowest threshold. Without hits retention is 1.
    """
    c, t = candidates.alias("c"), truths.alias("t")
    best = c.join(t, spans.overlaps("c", "t")).groupBy("t.id").agg(F.max("c.score").alias("score")).select("score", F.lit(0).alias("kept"), F.lit(1).alias("held"))
    rows = candidates.select("score", F.lit(1).alias("kept"), F.lit(0).alias("held")).union(best)
    spark = candidates.sparkSession
    ends = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "score double, kept int, held int")
    sweep = cumulative(rows.union(ends), [], "score", True, kept=F.col("kept"), held=F.col("held"))
    totals = rows.agg(F.sum("kept").alias("all_kept"), F.sum("held").alias("all_held"))
    sweep = sweep.crossJoin(F.broadcast(totals))  # one row
    sweep = sweep.withColumn("retention", ratio(F.col("held"), F.col("all_held"), 1.0)).withColumn("reduction", 1 - ratio(F.col("kept"), F.col("all_kept")))
    fine = F.col("retention") >= target
    key = F.struct(F.when(fine, 0).otherwise(1), F.when(fine, 0.0).otherwise(-F.col("retention")), F.col("kept"), F.when(fine, -F.col("score")).otherwise(F.col("score")))
    return sweep.agg(F.min_by(F.struct(F.col("score").alias("threshold"), "retention", "kept", "reduction"), key).alias("best")).select("best.*")


def gate_evaluation(candidates: DataFrame, truths: DataFrame, threshold: float) -> DataFrame:
    """One row: recall before and after the gate, retention, kept and rejected."""
    c, t = candidates.alias("c"), truths.alias("t")
    best = t.join(c, spans.overlaps("t", "c"), "left").groupBy("t.id").agg(F.max("c.score").alias("best"))
    hit = best.agg(F.count(F.lit(1)).alias("truths"), F.count("best").alias("hit"), F.count_if(F.col("best") >= threshold).alias("held"))
    own = candidates.agg(F.count_if(F.col("score") >= threshold).alias("kept"), F.count_if(F.col("score") < threshold).alias("rejected"))
    row = hit.crossJoin(F.broadcast(own))
    return row.select("*", ratio(F.col("hit"), F.col("truths")).alias("recall"), ratio(F.col("held"), F.col("truths")).alias("gated_recall"), ratio(F.col("held"), F.col("hit"), 1.0).alias("retention"), ratio(F.col("rejected"), F.col("kept") + F.col("rejected")).alias("reduction"))


def rare_thresholds(rows: DataFrame, family: str, score: str, positive: Column, target: float = 0.95) -> DataFrame:
    """For each family: the threshold whose recall reaches ``target`` with fewest triggers (then the highest)."""
    sweep = cumulative(rows, [family], score, True, triggered=F.lit(1), found=positive.cast("int"))
    all_ = rows.groupBy(family).agg(F.count_if(positive).alias("positives"), F.count(F.lit(1)).alias("n"))
    sweep = sweep.join(all_, family).withColumn("recall", ratio(F.col("found"), F.col("positives"), 1.0))
    fine = sweep.where((F.col("recall") >= target) & (F.col("positives") > 0))
    best = F.min_by(F.struct(F.col(score).alias("threshold"), "triggered", "recall", ratio(F.col("triggered"), F.col("n")).alias("trigger_rate")), F.struct(F.col("triggered"), -F.col(score)))
    return fine.groupBy(family).agg(best.alias("b")).select(family, "b.*")


def escalation_calibration(groups: DataFrame, target: float = 0.95) -> DataFrame:
    """Confidence up to which groups escalate to all experts, at least cost for ``target`` recall.

    ``groups``: confidence, pair_cost, full_cost (whole micro-units), pair_hits, full_hits, truths. Groups at or below the
    threshold escalate. Of feasible thresholds: least cost, fewest escalations, lowest threshold; else the best recall.
    """
    gain, more = F.col("full_hits") - F.col("pair_hits"), F.col("full_cost") - F.col("pair_cost")
    none = groups.sparkSession.createDataFrame([(-1.0, 0, 0, 0)], "confidence double, gain long, more long, escalated long")
    rows = groups.select("confidence", gain.cast("long").alias("gain"), more.cast("long").alias("more"), F.lit(1).cast("long").alias("escalated")).union(none)
    sweep = cumulative(rows, [], "confidence", False, gain=F.col("gain"), more=F.col("more"), escalated=F.col("escalated"))
    base = groups.agg(F.sum("pair_cost").alias("base_cost"), F.sum("pair_hits").alias("base_hits"), F.sum("truths").alias("truths"))
    sweep = sweep.crossJoin(F.broadcast(base)).select("confidence", "escalated", (F.col("base_cost") + F.col("more")).alias("cost"), ratio(F.col("base_hits") + F.col("gain"), F.col("truths"), 1.0).alias("recall"))
    fine = F.col("recall") >= target
    key = F.struct(F.when(fine, 0).otherwise(1), F.when(fine, 0.0).otherwise(-F.col("recall")), F.col("cost"), F.col("escalated"), F.col("confidence"))
    return sweep.agg(F.min_by(F.struct("*"), key).alias("b")).select("b.*")


def policy_grid(rows: DataFrame, confidences: list[float], margins: list[float], most_entropy: float = float("inf"), most_experts: int = 2) -> DataFrame:
    """calls and coverage of the adaptive policy at each (confidence, margin); rows: top1, margin, entropy, top1_right, right.

    One expert is called where top1 and margin reach their bounds and entropy keeps within ``most_entropy``, else
    ``most_experts`` (of which ``right`` says whether one is right). The grid is a fixed small table; rows are first summed
    by what it can tell apart, so the cross join meets a bounded table whatever the input.
    """
    spark = rows.sparkSession
    grid = spark.createDataFrame([(c, m) for c in confidences for m in margins], "min_confidence double, min_margin double")
    place = lambda x, edges: F.size(F.filter(F.array(*map(F.lit, sorted(edges))), lambda e: e <= x))
    calm = F.col("entropy") <= most_entropy
    cells = rows.groupBy(F.when(calm, place(F.col("top1"), confidences)).otherwise(-1).alias("c"), place(F.col("margin"), margins).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if("top1_right").alias("one"), F.count_if("right").alias("more"))
    at = grid.select("*", place(F.col("min_confidence"), confidences).alias("gc"), place(F.col("min_margin"), margins).alias("gm"))
    single = (F.col("c") >= F.col("gc")) & (F.col("m") >= F.col("gm"))
    met = cells.crossJoin(F.broadcast(at)).groupBy("min_confidence", "min_margin").agg(F.sum("n").alias("n"), F.sum(F.when(single, F.col("n")).otherwise(most_experts * F.col("n"))).alias("calls"), F.sum(F.when(single, F.col("one")).otherwise(F.col("more"))).alias("covered"))
    return met.withColumn("coverage", ratio(F.col("covered"), F.col("n")))


def chosen_policy(grid: DataFrame, target: float = 0.95) -> DataFrame:
    """The grid's choice: of points that cover ``target``, fewest calls, best coverage, lowest bounds; else the best coverage,
    fewest calls, lowest bounds. One row, with average_experts and target_met."""
    fine = F.col("coverage") >= target
    key = F.struct(F.when(fine, 0).otherwise(1), F.when(fine, F.col("calls").cast("double")).otherwise(-F.col("coverage")), F.when(fine, -F.col("coverage")).otherwise(F.col("calls").cast("double")), F.col("min_confidence"), F.col("min_margin"))
    best = grid.agg(F.min_by(F.struct("*"), key).alias("b")).select("b.*")
    return best.select("*", ratio(F.col("calls"), F.col("n")).alias("average_experts"), (F.col("coverage") >= target).alias("target_met"))


def best_pair(outcomes: DataFrame) -> DataFrame:
    """Coverage and cost of every pair of assignments (a < b) over the groups, best first in ``place``.

    Outcomes of a group are joined with themselves: a group has one row for each of a few assignments.
    """
    a = outcomes.select("candidate_id", F.col("assignment").alias("a"), F.col("success").alias("sa"), F.col("cost").cast("decimal(18,6)").alias("ca"))
    b = outcomes.select("candidate_id", F.col("assignment").alias("b"), F.col("success").alias("sb"), F.col("cost").cast("decimal(18,6)").alias("cb"))
    pairs = a.join(b, "candidate_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("sa") | F.col("sb")).alias("covered"), F.sum(F.col("ca") + F.col("cb")).cast("double").alias("cost"))
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("covered"), "cost", "a", "b")))
