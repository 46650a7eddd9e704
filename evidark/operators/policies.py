"""What a routing policy reaches and costs on a matrix of outcomes.

Outcomes have a row for each candidate (``KEY``) and assignment: success, false_positive, unsupported, cost, probability,
matched_truth_ids, ground_truth_ids, prompt_tokens, completion_tokens, latency_seconds, validated_true, validated_false. A
policy's choice has rows (policy, candidate_id, assignment). All sums are by candidate first, then over candidates, so
nothing larger than one candidate's rows meets in one group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidark.functions.scores import independence_of
from evidark.operators.assertions import DataError
from evidark.operators.metrics import expected_calibration_error, f1, ratio
from evidark.sources.session import written

KEY = ["candidate_id"]
#: Weights of false positives, unsupported claims and cost against a success.
WEIGHTS = (0.5, 0.25, 1.0)


def validated_counts(true: Column, false: Column, success: Column, false_positive: Column) -> tuple[Column, Column]:
    """Validated true and false findings; where neither was counted, the outcome's own marks."""
    t, f = F.coalesce(true, F.lit(0)), F.coalesce(false, F.lit(0))
    counted = (t != 0) | (f != 0)
    return F.when(counted, t).otherwise(success.cast("int")), F.when(counted, f).otherwise(false_positive.cast("int"))


def restrict_to_model(assignments: DataFrame, model_id: str, experts: list[str]) -> DataFrame:
    """The assignments (expert, model_id) of one model; an error if it lacks one of ``experts``."""
    own = assignments.where(F.col("model_id") == model_id)
    have = {r[0] for r in own.where(F.col("expert").isin(experts)).select("expert").distinct().collect()}  # at most all experts
    if missing := sorted(set(experts) - have):
        raise DataError(f"{model_id} has no assignment for: {', '.join(missing)}")
    return own


def ranked(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` with place: 1, 2, ... by probability, ties by assignment."""
    return outcomes.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("probability"), "assignment")))


def baselines(outcomes: DataFrame, fixed: list[str], threshold: float, gate: DataFrame | None = None, single: str | None = None, pair: list[str] | None = None, anchor_rare: DataFrame | None = None) -> DataFrame:
    """policy, candidate_id, assignment of the policies a router is compared with.

    full5: all; utility_top2: the best two; fixed_top2: two named ones; formula_escalation: the best two, or all where the
    chance that one of them is right is below ``threshold``; adaptive_gate: all where ``gate`` (candidate_id, escalate)
    says so, else the best two; best_single and best_fixed2: as named; anchor_rare: what that router chose
    (candidate_id, assignment), of what has an outcome.
    """
    r = ranked(outcomes)
    top = F.col("place") <= 2
    by_key = Window.partitionBy(*KEY)
    chance = independence_of(F.collect_list(F.when(top, F.col("probability"))).over(by_key))
    r = r.withColumn("chance", chance)
    if gate is not None:
        r = r.join(gate.select(*KEY, "escalate"), KEY, "left").withColumn("escalate", F.coalesce("escalate", F.lit(False)))
    named = [F.lit("full5"), F.when(top, "utility_top2"), F.when(F.col("assignment").isin(fixed), "fixed_top2"), F.when(top | (F.col("chance") < threshold), "formula_escalation")]
    if gate is not None:
        named.append(F.when(top | F.col("escalate"), "adaptive_gate"))
    if single is not None:
        named.append(F.when(F.col("assignment") == single, "best_single"))
    if pair is not None:
        named.append(F.when(F.col("assignment").isin(pair), "best_fixed2"))
    if anchor_rare is not None:
        r = r.join(anchor_rare.select(*KEY, "assignment").distinct().withColumn("_anchored", F.lit(True)), [*KEY, "assignment"], "left")
        named.append(F.when(F.col("_anchored"), "anchor_rare"))
    return r.select(F.explode(F.array_compact(F.array(*named))).alias("policy"), *KEY, "assignment")


def require_complete(outcomes: DataFrame, choice: DataFrame) -> None:
    """An error if a policy chose an assignment that has no outcome on that candidate."""
    missing = choice.join(outcomes.select(*KEY, "assignment"), [*KEY, "assignment"], "left_anti").select("assignment").distinct().limit(5).collect()
    if missing:
        raise DataError(f"outcomes lack chosen assignments: {', '.join(sorted(str(r[0]) for r in missing))}")


def reward_of(success: Column, false_positive: Column, unsupported: Column, cost: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """In decimals, so that sums of it are the same in any order; costs have six places."""
    part = lambda w, x, places: F.lit(Decimal(repr(w))).cast("decimal(8,4)") * x.cast(f"decimal(12,{places})")
    return success.cast("int").cast("decimal(12,0)") - part(weights[0], false_positive, 0) - part(weights[1], unsupported, 0) - part(weights[2], cost, 6)


def evaluate(outcomes: DataFrame, choice: DataFrame, top: int = 2, weights: tuple[float, float, float] = WEIGHTS, check: bool = True, full: int | None = None, expected: DataFrame | None = None) -> DataFrame:
    """One row for each policy with all its measures; costs are summed as decimals, so order does not matter.

    A policy counts as escalated where it takes ``full`` assignments (all of the candidate's, if that is not given); the
    best ``top`` suffice where they match every truth of the candidate. ``expected``: assignment, average_cost, of the rows
    that a router was trained on; else of these outcomes. Candidates for which a policy chose nothing count with nothing
    chosen.
    """
    outcomes, choice = written(outcomes.select([c for c in outcomes.columns if c != "place"]), "outcomes"), written(choice, "choice")  # each is read by several branches
    if check:
        require_complete(outcomes, choice)
    empty = F.array().cast("array<string>")
    true, false = validated_counts(F.col("validated_true"), F.col("validated_false"), F.col("success"), F.col("false_positive"))
    o = ranked(outcomes).withColumns({"cost": F.col("cost").cast("decimal(18,6)"), "true_n": true, "false_n": false, "matched": F.coalesce("matched_truth_ids", empty), "truths": F.coalesce("ground_truth_ids", empty)})
    o = written(o, "ranked")
    average = expected if expected is not None else o.groupBy("assignment").agg((F.sum("cost").cast("double") / F.count(F.lit(1))).alias("average_cost"))  # a row an assignment
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    own = reward_of(F.col("success"), F.col("false_positive").cast("int"), F.col("unsupported"), F.col("cost"), weights)
    every = o.groupBy(*KEY).agg(
        F.max("success").alias("any_success"), union("truths").alias("truths"), F.count(F.lit(1)).alias("assignments"), F.max(own).alias("best"),
        union(F.when(F.col("place") <= top, F.col("matched")).otherwise(empty)).alias("top_matched"), independence_of(F.collect_list(F.when(F.col("place") <= top, F.col("probability")))).alias("gate_confidence"),
        *[F.max(c).alias(c) for c in ("case_id",) if c in outcomes.columns],
    )
    every = written(every.withColumn("sufficient", F.size(F.array_except("truths", "top_matched")) == 0), "candidates")
    taken = choice.join(o.join(average, "assignment"), [*KEY, "assignment"]).groupBy("policy", *KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("success").alias("success"), F.sum(F.col("false_positive").cast("int")).alias("fp"), F.sum("unsupported").alias("unsupported"), F.sum("cost").alias("cost"),
        F.sum(F.col("average_cost").cast("decimal(24,12)")).alias("expected"), union("matched").alias("matched"), F.sum("true_n").alias("true_n"), F.sum("false_n").alias("false_n"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens")], F.sum(F.col("latency_seconds").cast("decimal(18,6)")).alias("latency_seconds"),
    )
    names = choice.select("policy").distinct()
    grid = every.crossJoin(F.broadcast(names))  # a row a policy: a handful
    zero = lambda c: F.coalesce(c, F.lit(0))
    g = grid.join(taken, ["policy", *KEY], "left").withColumns({"matched": F.array_intersect(F.coalesce("matched", empty), F.col("truths")), "n": zero("n"), "success": F.coalesce("success", F.lit(False))})
    escalated, reward = F.col("n") >= (F.col("assignments") if full is None else F.lit(full)), reward_of(F.col("success"), zero("fp"), zero("unsupported"), zero("cost"), weights)
    g = g.withColumns({"escalated": escalated, "reward": reward})
    total = lambda c: F.sum(c.cast("decimal(26,12)")).cast("double")
    case = F.col("case_id") if "case_id" in outcomes.columns else F.col(KEY[0])
    out = g.groupBy("policy").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if("success").alias("_success"), F.count_if("any_success").alias("_oracle"), F.sum("n").alias("logical_expert_tasks"), total(F.col("expected")).alias("_expected"), total(F.col("reward")).alias("_reward"), total(F.col("best")).alias("_best"),
        F.sum(F.size("truths")).alias("_truths"), F.sum(F.size("matched")).alias("_matched"), F.count_if(F.size(F.array_except("truths", "matched")) == 0).alias("_exact"), F.sum(zero("true_n")).alias("_true"), F.sum(zero("false_n")).alias("_false"),
        F.count_if("escalated").alias("_full"), total(zero("cost")).alias("_cost"), F.sum(zero("prompt_tokens")).alias("_prompt"), F.sum(zero("completion_tokens")).alias("_completion"), total(zero("latency_seconds")).alias("_latency"),
        F.countDistinct(F.when(F.col("n") > 0, case)).alias("web_batched_requests"),
        F.count_if(~F.col("sufficient") & F.col("escalated")).alias("_tp"), F.count_if(~F.col("sufficient") & ~F.col("escalated")).alias("_fn"), F.count_if(F.col("sufficient") & F.col("escalated")).alias("_fp"), F.count_if(F.col("sufficient") & ~F.col("escalated")).alias("_tn"),
    )
    n = F.col("candidate_count")
    per = lambda c: F.col(c) / n
    precision, recall = ratio(F.col("_true"), F.col("_true") + F.col("_false"), 1.0), ratio(F.col("_matched"), F.col("_truths"), 1.0)
    calibration = brier_and_error(o.select("probability", "success"), "probability", F.col("success"), "brier_score", "expected_calibration_error")
    gate = brier_and_error(every.select("gate_confidence", "sufficient"), "gate_confidence", F.col("sufficient"), "gate_brier_score", "gate_expected_calibration_error")
    out = out.crossJoin(F.broadcast(calibration)).crossJoin(F.broadcast(gate))  # one row each
    return out.select(
        "policy", "candidate_count", per("_success").alias("success_coverage"), per("_oracle").alias("oracle_coverage"), per("logical_expert_tasks").alias("average_assignments"), per("_expected").alias("average_expected_cost"),
        per("_reward").alias("average_realized_reward"), per("_best").alias("average_oracle_reward"), (F.greatest(F.lit(0.0), F.col("_best") - F.col("_reward")) / n).alias("average_regret"),
        recall.alias("truth_recall"), per("_exact").alias("exact_coverage"), precision.alias("outcome_precision"), f1(precision, recall).alias("outcome_f1"), per("_full").alias("full5_rate"),
        per("_cost").alias("average_realized_cost"), per("_prompt").alias("average_prompt_tokens"), per("_completion").alias("average_completion_tokens"), per("_latency").alias("average_latency_seconds"),
        "logical_expert_tasks", F.col("logical_expert_tasks").alias("research_physical_requests"), "web_batched_requests", F.col("web_batched_requests").alias("estimated_api_requests"),
        "brier_score", "expected_calibration_error", ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"), 1.0).alias("escalation_recall"), ratio(F.col("_fn"), F.col("_tp") + F.col("_fn")).alias("missed_escalation_rate"),
        ratio(F.col("_fp"), F.col("_fp") + F.col("_tn")).alias("unnecessary_escalation_rate"), "gate_brier_score", "gate_expected_calibration_error",
    )


def brier_and_error(rows: DataFrame, p: str, y: Column, brier: str, error: str) -> DataFrame:
    """One row: both measures, to nine places."""
    square = rows.agg(F.round(F.coalesce(F.avg(F.pow(F.col(p) - y.cast("double"), F.lit(2.0))), F.lit(0.0)), 9).alias(brier))
    off = expected_calibration_error(rows, p, y).select(F.round("ece", 9).alias(error))
    return square.crossJoin(F.broadcast(off))


def false_alarms(outcomes: DataFrame, choice: DataFrame) -> DataFrame:
    """policy, negative_candidate_count, false_positive_candidate_count, false_positive_rate, validated_false_finding_count
    and selected_outcome_count, over the candidates none of whose outcomes has a truth (ground_truth_ids empty or null).

    A candidate is a false positive of a policy if an outcome that the policy chose has a false finding (validated, or the
    outcome's own mark where none was counted). Policies that chose nothing there have zeros, as all have without negatives.
    """
    true = F.coalesce(F.size("ground_truth_ids"), F.lit(0)) > 0
    negatives = outcomes.groupBy(*KEY).agg(F.max(true).alias("_true")).where(~F.col("_true")).select(*KEY)
    _, false = validated_counts(F.col("validated_true"), F.col("validated_false"), F.col("success"), F.col("false_positive"))
    taken = choice.join(outcomes.select(*KEY, "assignment", false.alias("_false")), [*KEY, "assignment"]).join(negatives, KEY, "left_semi")
    by_candidate = taken.groupBy("policy", *KEY).agg(F.sum("_false").alias("f"), F.count(F.lit(1)).alias("n"))
    sums = by_candidate.groupBy("policy").agg(F.count_if(F.col("f") > 0).alias("hit"), F.sum("f").alias("f"), F.sum("n").alias("n"))
    total = negatives.agg(F.count(F.lit(1)).alias("negative_candidate_count"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return choice.select("policy").distinct().join(sums, "policy", "left").crossJoin(F.broadcast(total)).select(  # one row of totals
        "policy", "negative_candidate_count", whole("hit").alias("false_positive_candidate_count"), F.coalesce(F.try_divide(whole("hit"), F.col("negative_candidate_count")), F.lit(0.0)).alias("false_positive_rate"),
        whole("f").alias("validated_false_finding_count"), whole("n").alias("selected_outcome_count"),
    )


def fixed_choices(outcomes: DataFrame) -> DataFrame:
    """kind, policy, candidate_id, assignment of every single assignment and every pair of two experts' assignments.

    A policy is named by its assignments, joined by "|" in their order. ``expert`` is the assignment itself if not there.
    Pairs are made from the assignments, a handful, and each outcome takes its place in those that hold its own.
    """
    o = outcomes.withColumn("_expert", F.col("expert") if "expert" in outcomes.columns else F.col("assignment"))
    own = o.select("assignment", "_expert").distinct()
    other = own.select(F.col("assignment").alias("_other"), F.col("_expert").alias("_of"))
    pairs = own.join(F.broadcast(other), F.col("_expert") != F.col("_of"))  # the assignments are few
    two = F.array_sort(F.array("assignment", "_other"))
    pairs = pairs.select("assignment", F.lit("best_fixed2").alias("kind"), F.array_join(two, "|").alias("policy"))
    named = pairs.union(own.select("assignment", F.lit("best_single"), "assignment")).distinct()
    return o.select(*KEY, "assignment").join(F.broadcast(named), "assignment").select("kind", "policy", *KEY, "assignment")


def chosen_baselines(outcomes: DataFrame) -> DataFrame:
    """kind (best_single, best_fixed2), policy and all measures of the best of ``fixed_choices``: highest truth recall, then
    outcome F1, then lowest realized cost, then name. To be called on development data, never on a test split.
    """
    choice = fixed_choices(outcomes)
    m = evaluate(outcomes, choice.drop("kind")).withColumn("kind", F.when(F.contains("policy", F.lit("|")), "best_fixed2").otherwise("best_single"))
    best = m.groupBy("kind").agg(F.min_by(F.struct(*m.drop("kind").columns), F.struct(-F.col("truth_recall"), -F.col("outcome_f1"), F.col("average_realized_cost"), F.col("policy"))).alias("b"))
    return best.select("kind", "b.*")
