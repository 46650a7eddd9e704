"""Outcomes replayed through the stages: what the analyser, the gate, the matrix, an oracle and a route would find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidark.operators import spans
from evidark.operators.assertions import DataError
from evidark.operators.metrics import f1, ratio
from evidark.operators.policies import validated_counts
from evidark.operators.ranking import top_k
from evidark.sources.session import written

KEY = ["case_id", "candidate_id"]
#: Bits of the stages that a truth has reached.
STAGES = ("truth", "analyzer", "gated", "matrix", "oracle", "routed")
BIT = {name: 1 << i for i, name in enumerate(STAGES)}
MEASURES = (
    "case_count", "analysis_error_count", "ground_truth_count", "analyzer_candidate_count", "gated_candidate_count", "outcome_matrix_candidate_count",
    "analyzer_truth_hits", "gated_truth_hits", "outcome_matrix_truth_hits", "full5_oracle_truth_hits", "routed_truth_hits",
    "analyzer_candidate_recall", "candidate_gate_gt_retention", "post_gate_candidate_recall", "outcome_matrix_gt_coverage", "full5_oracle_detection_recall", "routed_detection_recall", "routing_retention_vs_full5",
    "validated_outcome_precision", "end_to_end_f1", "exact_case_coverage", "average_assignments_per_routed_candidate",
    "logical_expert_tasks", "research_physical_requests", "web_batched_requests", "prompt_tokens", "completion_tokens", "realized_cost",
)


def reached(truths: DataFrame, before: DataFrame, kept: DataFrame, rows: DataFrame, taken: DataFrame) -> DataFrame:
    """case_id, truth_id, mask: the stages (``BIT``) that each truth has reached, from one union summed by truth.

    ``before``: candidates; ``kept``: the keys of those that pass; ``rows`` and ``taken``: outcomes of kept candidates, and of those the route's.
    """
    t = truths.select("case_id", F.col("truth_id"), "file", "line_start", "line_end")
    seen = before.select(*KEY, "file", "line_start", "line_end").join(kept.withColumn("_kept", F.lit(True)), KEY, "left")
    met = t.alias("t").join(seen.alias("c"), spans.overlaps("t", "c")).select("t.case_id", "t.truth_id", F.when(F.col("c._kept"), BIT["analyzer"] | BIT["gated"]).otherwise(BIT["analyzer"]).alias("mask"))

    def named(outcomes: DataFrame, **stages: str) -> DataFrame:
        """Truths that columns of ids name, with their stages; of one table together, so that a task sums a truth's stages."""
        none = F.array().cast("array<string>")
        mark = lambda bit: lambda i: F.struct(i.alias("truth_id"), F.lit(bit).alias("mask"))
        marked = [F.transform(F.coalesce(F.col(ids).cast("array<string>"), none), mark(BIT[stage])) for stage, ids in stages.items()]
        return outcomes.select("case_id", F.inline(F.concat(*marked)))

    every = t.select("case_id", "truth_id", F.lit(BIT["truth"]).alias("mask"))
    for part in (met, named(rows, matrix="ground_truth_ids", oracle="matched_truth_ids"), named(taken, routed="matched_truth_ids")):
        every = every.unionByName(part)
    masks = every.groupBy("case_id", "truth_id").agg(F.bit_or("mask").alias("mask"))
    return masks.where(F.col("mask").bitwiseAND(BIT["truth"]) != 0)  # names that are no truth of the case count nowhere


def end_to_end(cases: DataFrame, truths: DataFrame, candidates: DataFrame, outcomes: DataFrame, routes: DataFrame, gate: float, gate_enabled: bool = True, most_per_case: int | None = None, check: bool = True) -> DataFrame:
    """One row of all ``MEASURES``: a matrix of measured outcomes replayed through every stage, without a model call.

    cases: case_id, error (the analyser failed there: its truths count, nothing else does). truths: truth_id, case_id,
    file, line_start, line_end. candidates: case_id, candidate_id, file, line_start, line_end, score. outcomes (one row a
    candidate and assignment): case_id, candidate_id, assignment, success, false_positive, validated_true,
    validated_false, matched_truth_ids, ground_truth_ids, prompt_tokens, completion_tokens, cost. routes: case_id,
    candidate_id, assignment.

    A kept candidate without outcomes is a loss of coverage, not a negative. Outcomes without a case, and routes of a kept
    candidate in the matrix to an assignment that it lacks there, raise. Costs are summed as decimals.
    """
    if check and not outcomes.where("case_id IS NULL").isEmpty():
        raise DataError("outcomes need a case_id")
    fine = cases.where(~F.coalesce("error", F.lit(False))).select("case_id")
    before = candidates.join(fine, "case_id", "left_semi")
    kept = before.where(F.col("score") >= gate) if gate_enabled else before
    if most_per_case is not None:
        kept = top_k(kept, ["case_id"], most_per_case, F.desc("score"), F.asc("file"), F.asc("line_start"), F.asc("candidate_id"))
    kept = written(kept.select(*KEY), "kept")  # both are read by several branches below
    rows = written(outcomes.join(kept, KEY, "left_semi"), "rows")
    known = rows.select(*KEY).distinct()
    asked = routes.select(*KEY, "assignment").distinct().join(known, KEY, "left_semi")
    if check:
        lacking = asked.join(rows, [*KEY, "assignment"], "left_anti").limit(5).collect()
        if lacking:
            raise DataError("outcomes lack routed assignments: " + ", ".join(sorted(f"{r.case_id}/{r.candidate_id}: {r.assignment}" for r in lacking)))
    taken = rows.join(asked, [*KEY, "assignment"], "left_semi")
    masks = reached(truths, before, kept, rows, taken)
    bit = lambda name: F.count_if(F.col("mask").bitwiseAND(BIT[name]) != 0)
    by_case = masks.groupBy("case_id").agg(*[bit(s).alias(s) for s in STAGES])
    whole = cases.select("case_id", F.coalesce("error", F.lit(False)).alias("error")).join(by_case, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = [
        whole.agg(F.count(F.lit(1)).alias("case_count"), F.count_if("error").alias("analysis_error_count"), *[zero(F.sum(s)).alias(s) for s in STAGES], F.count_if(~F.col("error") & (zero(F.col("routed")) == zero(F.col("truth")))).alias("_exact")),
        before.agg(F.count(F.lit(1)).alias("analyzer_candidate_count")),
        kept.agg(F.count(F.lit(1)).alias("gated_candidate_count")),
        known.agg(F.count(F.lit(1)).alias("outcome_matrix_candidate_count")),
        spent(taken),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(F.broadcast(part))  # one row each
    truth, precision, recall = F.col("truth"), ratio(F.col("_true"), F.col("_true") + F.col("_false"), 1.0), ratio(F.col("routed"), F.col("truth"), 1.0)
    told: dict[str, Column] = {
        "ground_truth_count": truth, "analyzer_truth_hits": F.col("analyzer"), "gated_truth_hits": F.col("gated"), "outcome_matrix_truth_hits": F.col("matrix"), "full5_oracle_truth_hits": F.col("oracle"), "routed_truth_hits": F.col("routed"),
        "analyzer_candidate_recall": ratio(F.col("analyzer"), truth, 1.0), "candidate_gate_gt_retention": ratio(F.col("gated"), F.col("analyzer"), 1.0), "post_gate_candidate_recall": ratio(F.col("gated"), truth, 1.0),
        "outcome_matrix_gt_coverage": ratio(F.col("matrix"), truth, 1.0), "full5_oracle_detection_recall": ratio(F.col("oracle"), truth, 1.0), "routed_detection_recall": recall, "routing_retention_vs_full5": ratio(F.col("routed"), F.col("oracle"), 1.0),
        "validated_outcome_precision": precision, "end_to_end_f1": f1(precision, recall), "exact_case_coverage": ratio(F.col("_exact"), F.col("case_count"), 1.0),
        "average_assignments_per_routed_candidate": ratio(F.col("logical_expert_tasks"), F.col("outcome_matrix_candidate_count")), "research_physical_requests": F.col("logical_expert_tasks"),
    }
    return one.select(*[told.get(m, F.col(m)).alias(m) for m in MEASURES])


def spent(taken: DataFrame) -> DataFrame:
    """One row: tasks, cases with tasks, tokens, cost, validated true and false findings of the outcomes taken."""
    true, false = validated_counts(F.col("validated_true"), F.col("validated_false"), F.col("success"), F.col("false_positive"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return taken.agg(
        F.count(F.lit(1)).alias("logical_expert_tasks"), F.countDistinct("case_id").alias("web_batched_requests"), total(F.col("prompt_tokens")).alias("prompt_tokens"), total(F.col("completion_tokens")).alias("completion_tokens"),
        total(F.col("cost").cast("decimal(18,6)")).cast("double").alias("realized_cost"), total(true).alias("_true"), total(false).alias("_false"),
    )


def family_support(samples: DataFrame, supported: list[str]) -> DataFrame:
    """Accuracy apart for labels that the model knows and those left to the fallback: label, selected (array), fallback."""
    known = F.col("label").isin(supported)
    right = F.array_contains("selected", F.col("label"))
    return samples.agg(
        F.count_if(known).alias("supported"), F.count_if(~known).alias("unsupported"), ratio(F.count_if(known & right), F.count_if(known)).alias("supported_coverage"),
        ratio(F.count_if(~known & right), F.count_if(~known)).alias("unsupported_coverage"), F.count_if("fallback").alias("fallbacks"), F.avg(F.size("selected")).alias("mean_experts"),
    )


def all_experts_baseline(samples: DataFrame, n: int = 6) -> DataFrame:
    """Calling every expert covers everything at the full number of calls."""
    return samples.agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("coverage"), F.lit(float(n)).alias("mean_experts"), F.lit(0.0).alias("saved"))


def tradeoff_points(policies: DataFrame, x: str = "cost", y: str = "coverage", pad: float = 0.08) -> DataFrame:
    """policy, x, y scaled to 0..1 with ``pad`` left free on each side; a constant axis sits in the middle."""
    ends = policies.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), pad + (1 - 2 * pad) * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.5)
    return policies.crossJoin(F.broadcast(ends)).select("policy", at(x).alias("x"), at(y).alias("y"))
