"""Ratios, calibration errors and stage metrics. What an empty denominator gives is a parameter, as callers differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidark.operators import spans


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float(empty)))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def analyzer_metrics(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """One row: counts, recall, candidates per case and truth, mean and median lines of a candidate."""
    hit = spans.hits(truths, candidates).agg(F.count(F.lit(1)).alias("truths_hit"))
    every = truths.agg(F.count(F.lit(1)).alias("truths"), F.countDistinct("case_id").alias("truth_cases"))
    lines = F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))
    own = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("case_id").alias("cases"), F.avg(lines).alias("mean_lines"), F.median(lines).alias("median_lines"))
    row = every.crossJoin(F.broadcast(hit)).crossJoin(F.broadcast(own))  # one row each
    return row.select("*", ratio(F.col("truths_hit"), F.col("truths")).alias("recall"), ratio(F.col("candidates"), F.col("cases")).alias("per_case"), ratio(F.col("candidates"), F.col("truths")).alias("per_truth"))


def precision_recall(pairs: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each group; empty denominators count as 1."""
    out = pairs.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def expected_calibration_error(rows: DataFrame, p: str, y: Column, bins: int = 10) -> DataFrame:
    """ece: bins [i/n, (i+1)/n), the last one closed; probabilities outside 0 to 1 only count in the denominator.

    Edges are literals, as p times n may round across one.
    """
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    place = F.when((F.col(p) >= 0) & (F.col(p) <= 1), F.size(F.filter(edges, lambda e: e <= F.col(p))) - 1)
    per = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(y.cast("double")).alias("accuracy"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).otherwise(0.0)
    return per.agg(ratio(F.sum(gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(rows: DataFrame, p: str, y: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(p) - y.cast("double"), F.lit(2.0))).alias("brier"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each actual label, a column for each predicted one, in the fixed order, zero filled."""
    return rows.groupBy(actual).pivot(predicted, labels).count().na.fill(0)


def stage_decomposition(candidates: DataFrame, truths: DataFrame, gate: float, selected: Column) -> DataFrame:
    """Where truths are lost, for each expert: analyser, gate, router.

    ``selected`` says whether a candidate's route (columns under ``c``) covers the truth's expert (under ``t``).
    Misses stay in the denominators; retention without hits is 1.
    """
    c, t = candidates.alias("c"), truths.alias("t")
    open_ = F.col("c.id").isNotNull() & (F.col("c.score") >= gate)
    flags = t.join(c, spans.overlaps("t", "c"), "left").groupBy("t.id", "t.expert").agg(
        F.max(F.col("c.id").isNotNull()).alias("hit"), F.max(open_).alias("kept"), F.max(F.coalesce(open_ & selected, F.lit(False))).alias("routed")
    )
    out = flags.groupBy("expert").agg(F.count(F.lit(1)).alias("truths"), *[F.count_if(F.col(x)).alias(x) for x in ("hit", "kept", "routed")])
    return out.select("expert", "truths", "hit", "kept", "routed", ratio(F.col("hit"), F.col("truths")).alias("recall"), ratio(F.col("kept"), F.col("hit"), 1.0).alias("retention"), ratio(F.col("kept"), F.col("truths")).alias("gated_recall"), ratio(F.col("routed"), F.col("kept")).alias("conditional"), ratio(F.col("routed"), F.col("truths")).alias("end_to_end"))


def reward(false_positive: float = 0.5, unsupported: float = 0.25, cost: float = 1.0) -> Column:
    """An outcome's worth: success less weighted false positive, unsupported claims and cost."""
    return F.col("success").cast("double") - false_positive * F.col("false_positive").cast("double") - unsupported * F.col("unsupported") - cost * F.col("cost")


def assignment_statistics(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("assignment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(F.col("false_positive").cast("double")).alias("false_positive_rate"),
        F.avg((F.col("unsupported") > 0).cast("double")).alias("unsupported_rate"),
        F.bround(F.sum(F.col("cost").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 9).alias("mean_cost"),
        F.avg("tokens").alias("mean_tokens"),
    )
