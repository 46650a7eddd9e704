"""Fixed baselines and false alarms by hand."""

from evidark.operators import policies

SCHEMA = "candidate_id long, assignment string, expert string, success boolean, false_positive boolean, unsupported int, cost double, probability double, matched_truth_ids array<string>, ground_truth_ids array<string>, prompt_tokens long, completion_tokens long, latency_seconds double, validated_true int, validated_false int"


def outcome(candidate, assignment, expert, matched=(), truths=("t1", "t2"), cost=1.0, false=0, mark=False):
    return candidate, assignment, expert, bool(matched), mark, 0, cost, 0.5, list(matched), None if truths is None else list(truths), 1, 1, 1.0, len(matched) if false else 0, false


ROWS = [
    outcome(1, "a1", "A", ["t1"], cost=2.0), outcome(1, "a2", "A", ["t2"], cost=2.0), outcome(1, "b", "B", ["t1"], cost=1.0), outcome(1, "c", "C", [], cost=0.5),
    outcome(2, "a1", "A", [], ()), outcome(2, "a2", "A", [], (), false=3), outcome(2, "b", "B", [], (), mark=True), outcome(2, "c", "C", [], ()),
    outcome(3, "a1", "A", [], None), outcome(3, "a2", "A", [], None), outcome(3, "b", "B", [], None), outcome(3, "c", "C", [], None),
]


def test_pairs_are_of_two_experts_and_ties_go_to_the_cheaper(spark):
    o = spark.createDataFrame(ROWS, SCHEMA)
    names = {r.policy for r in policies.fixed_choices(o).select("policy").distinct().collect()}
    assert names == {"a1", "a2", "b", "c", "a1|b", "a1|c", "a2|b", "a2|c", "b|c"}
    best = {r.kind: r for r in policies.chosen_baselines(o.where("candidate_id = 1")).collect()}
    assert best["best_single"].policy == "b" and best["best_single"].truth_recall == 0.5
    assert best["best_fixed2"].policy == "a2|b" and best["best_fixed2"].truth_recall == 1.0


def test_false_alarms_count_candidates_without_truths(spark):
    o = spark.createDataFrame(ROWS, SCHEMA)
    choice = policies.fixed_choices(o).drop("kind")
    got = {r.policy: (r.negative_candidate_count, r.false_positive_candidate_count, r.false_positive_rate, r.validated_false_finding_count, r.selected_outcome_count) for r in policies.false_alarms(o, choice).collect()}
    assert got["a1"] == (2, 0, 0.0, 0, 2) and got["a2"] == (2, 1, 0.5, 3, 2) and got["b"] == (2, 1, 0.5, 1, 2) and got["a2|b"] == (2, 1, 0.5, 4, 4)
    none = {tuple(r)[1:] for r in policies.false_alarms(o.where("candidate_id = 1"), choice).collect()}
    assert none == {(0, 0, 0.0, 0, 0)}
    assert policies.false_alarms(o.limit(0), choice.limit(0)).count() == 0
