"""Queries over the outcome matrix and labels: policies, calibration errors, audits, latest states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidark.functions import scores
from evidark.operators import calibration, metrics, policies, ranking, replay, splits
from evidark.plans.registry import query
from evidark.sources.session import written
from evidark.sources.tables import LABELLED, OUTCOMES, SPANS, candidates, labelled, outcomes, read, spans, truths

REWARD = "CAST(success AS DOUBLE) - 0.5 * CAST(false_positive AS DOUBLE) - 0.25 * unsupported - 1.0 * cost"


@query("reward", f"WITH {OUTCOMES} SELECT candidate_id, assignment, {REWARD} AS reward FROM outcomes")
def reward(spark, sf):
    return outcomes(spark, sf).select("candidate_id", "assignment", metrics.reward().alias("reward"))


@query("assignment_stats", f"""WITH {OUTCOMES} SELECT assignment, count(*) AS n, avg(CAST(success AS DOUBLE)) AS success_rate, avg(CAST(false_positive AS DOUBLE)) AS false_positive_rate,
  avg(CAST(unsupported > 0 AS DOUBLE)) AS unsupported_rate, round_even(CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS mean_cost, avg(tokens) AS mean_tokens FROM outcomes GROUP BY assignment""")
def assignment_stats(spark, sf):
    return metrics.assignment_statistics(outcomes(spark, sf))


@query("utility_score", f"WITH {OUTCOMES} SELECT candidate_id, assignment, probability - 0.5 * CAST(false_positive AS DOUBLE) - 0.25 * unsupported - 1.0 * cost AS utility FROM outcomes")
def utility_score(spark, sf):
    u = scores.utility(F.col("probability"), F.col("false_positive").cast("double"), F.col("unsupported"), F.col("cost"))
    return outcomes(spark, sf).select("candidate_id", "assignment", u.alias("utility"))


@query("rank_families", f"WITH {OUTCOMES} SELECT candidate_id, assignment AS family, probability, row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS rank FROM outcomes")
def rank_families(spark, sf):
    rows = outcomes(spark, sf).select("candidate_id", F.col("assignment").alias("family"), "probability")
    return ranking.ranked(rows, ["candidate_id"], F.desc("probability"), F.asc("family"))


@query("best_per_family", """WITH w AS (SELECT user_id AS candidate_id, event_type AS family, event_id, value FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, family ORDER BY value DESC, event_id) AS n FROM w)
SELECT candidate_id, family, event_id, value, row_number() OVER (PARTITION BY candidate_id ORDER BY value DESC, event_id) AS rank FROM b WHERE n = 1""")
def best_per_family(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("family"), "event_id", "value")
    return ranking.best_per_family(e, "candidate_id", "family", F.desc("value"), F.asc("event_id"))


_P = """p AS (SELECT candidate_id, assignment AS family, CASE WHEN sum(probability) OVER (PARTITION BY candidate_id) > 0 THEN probability / sum(probability) OVER (PARTITION BY candidate_id) ELSE 0 END AS p FROM outcomes),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY p DESC, family) AS n FROM p),
a AS (SELECT candidate_id, max(p) FILTER (n = 1) AS top1, max(p) FILTER (n = 1) - coalesce(max(p) FILTER (n = 2), 0) AS margin, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, string_agg(family, ',' ORDER BY n) FILTER (n <= 2) AS two, max(family) FILTER (n = 1) AS one FROM r GROUP BY candidate_id)"""


@query("adaptive_topk", f"WITH {OUTCOMES}, {_P} SELECT candidate_id, round(top1, 9) AS top1, round(margin, 9) AS margin, round(entropy, 9) AS entropy, CASE WHEN top1 >= 0.25 AND margin >= 0.02 AND entropy <= 1.6 THEN one ELSE two END AS selected FROM a")
def adaptive_topk(spark, sf):
    s = outcomes(spark, sf).select("candidate_id", F.col("assignment").alias("family"), F.col("probability").alias("score"))
    out = ranking.adaptive_top_k(s, "candidate_id", 0.25, 0.02, 1.6)
    return out.select("candidate_id", *[F.round(c, 9).alias(c) for c in ("top1", "margin", "entropy")], F.array_join("selected", ",").alias("selected"))


@query("independence_conf", f"WITH {OUTCOMES}, r AS (SELECT candidate_id, probability, row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS n FROM outcomes) SELECT candidate_id, 1 - (1 - max(probability) FILTER (n = 1)) * (1 - max(probability) FILTER (n = 2)) AS confidence FROM r GROUP BY candidate_id")
def independence_conf(spark, sf):
    top = ranking.top_k(outcomes(spark, sf), ["candidate_id"], 2, F.desc("probability"), F.asc("assignment"))
    two = top.groupBy("candidate_id").agg(F.max(F.when(F.col("rank") == 1, F.col("probability"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("probability"))).alias("b"))
    return two.select("candidate_id", scores.independence(F.col("a"), F.col("b")).alias("confidence"))


@query("binary_entropy", f"WITH {OUTCOMES} SELECT candidate_id, assignment, CASE WHEN probability <= 0 OR probability >= 1 THEN 0.0 ELSE -probability * log2(probability) - (1 - probability) * log2(1 - probability) END AS bits FROM outcomes")
def binary_entropy(spark, sf):
    return outcomes(spark, sf).select("candidate_id", "assignment", scores.binary_entropy(F.col("probability")).alias("bits"))


@query("score_fusion", f"""WITH {OUTCOMES}, f AS (SELECT candidate_id, assignment, greatest(probability, CASE WHEN tokens > 12 THEN 0.3 ELSE 0.0 END) AS s FROM outcomes)
SELECT candidate_id, assignment AS family, round(CASE WHEN sum(s) OVER (PARTITION BY candidate_id) > 0 THEN s / sum(s) OVER (PARTITION BY candidate_id) ELSE s END, 9) AS score FROM f""")
def score_fusion(spark, sf):
    """Learned scores and rule scores, the larger of both, made to sum to 1."""
    o = outcomes(spark, sf)
    maps = o.groupBy("candidate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("assignment", "probability"))).alias("learned"),
        F.map_from_entries(F.collect_list(F.struct("assignment", F.when(F.col("tokens") > 12, 0.3).otherwise(0.0).alias("r")))).alias("rules"),
    )
    fused = maps.select("candidate_id", F.explode(scores.fused_scores(F.col("learned"), F.col("rules"))).alias("family", "score"))
    return fused.withColumn("score", F.round("score", 9))


@query("rule_trigger", f"WITH {OUTCOMES}, t AS (SELECT candidate_id, bool_or(success) AS any_success, max(unsupported) AS u, sum(tokens) AS n FROM outcomes GROUP BY candidate_id) SELECT candidate_id, CASE WHEN any_success THEN 0.3 ELSE 0.0 END AS taint_api, CASE WHEN u > 1 THEN 0.3 ELSE 0.0 END AS control_state FROM t")
def rule_trigger(spark, sf):
    t = outcomes(spark, sf).groupBy("candidate_id").agg(F.max("success").alias("any"), F.max("unsupported").alias("u"))
    m = t.withColumn("m", scores.rule_trigger({"taint_api": F.col("any"), "control_state": F.col("u") > 1, "memory_bounds": F.lit(True)}, ["memory_bounds"]))
    return m.select("candidate_id", F.col("m")["taint_api"].alias("taint_api"), F.col("m")["control_state"].alias("control_state"))


@query("truth_coverage", f"""WITH {OUTCOMES} SELECT candidate_id, string_agg(assignment, ',' ORDER BY assignment) FILTER (success) AS covered, count(*) FILTER (NOT success) AS left_out, bool_and(success OR assignment <> 'purchase') AS complete FROM outcomes GROUP BY candidate_id""")
def truth_coverage(spark, sf):
    """Union of what the rows match, and whether it holds all that is asked."""
    g = outcomes(spark, sf).groupBy("candidate_id").agg(F.array_sort(F.collect_set(F.when(F.col("success"), F.col("assignment")))).alias("have"), F.collect_set("assignment").alias("all"))
    asked = F.array_intersect("all", F.array(F.lit("purchase")))
    joined = F.when(F.size("have") > 0, F.array_join("have", ","))
    return g.select("candidate_id", joined.alias("covered"), F.size(F.array_except("all", "have")).cast("long").alias("left_out"), (F.size(F.array_except(asked, "have")) == 0).alias("complete"))


_POLICIES = """ranked AS (SELECT candidate_id, assignment, row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS n FROM outcomes),
policy AS (SELECT 'all' AS policy, candidate_id, assignment FROM ranked UNION ALL SELECT 'top1', candidate_id, assignment FROM ranked WHERE n = 1 UNION ALL SELECT 'top2', candidate_id, assignment FROM ranked WHERE n <= 2
  UNION ALL SELECT 'single:' || assignment, candidate_id, assignment FROM ranked)"""


def choices(o):
    r = ranking.ranked(o, ["candidate_id"], F.desc("probability"), F.asc("assignment"))
    named = F.filter(F.array(F.lit("all"), F.when(F.col("rank") == 1, "top1"), F.when(F.col("rank") <= 2, "top2"), F.concat(F.lit("single:"), F.col("assignment"))), lambda p: p.isNotNull())
    return r.select(F.explode(named).alias("policy"), "candidate_id", "assignment")


def full_outcomes(spark, sf):
    """``outcomes`` with truths, matches, tokens, seconds and validated findings, made from the events' own numbers."""
    names = lambda *cs: F.array_compact(F.array(*cs))
    first, second = F.concat(F.lit("t"), (F.col("candidate_id") % 4).cast("string")), F.when(F.col("candidate_id") % 3 == 0, F.lit("t9"))
    return outcomes(spark, sf).select(
        "*", names(first, second).alias("ground_truth_ids"), names(F.when(F.col("success"), first), F.when(F.col("tokens") % 3 == 0, F.lit("t9")), F.when(F.col("tokens") % 7 == 0, F.lit("t8"))).alias("matched_truth_ids"),
        (F.col("tokens") * 10).alias("prompt_tokens"), F.col("tokens").alias("completion_tokens"), (F.col("cost") * 2).alias("latency_seconds"),
        F.when(F.col("unsupported") > 0, (F.col("tokens") % 4).cast("int")).otherwise(0).alias("validated_true"), F.when(F.col("unsupported") > 1, (F.col("tokens") % 2).cast("int")).otherwise(0).alias("validated_false"),
    )


_FIXED, _ESCALATE, _SINGLE = ["click", "purchase"], 0.45, "purchase"


def compared(o, anchor_rare=None):
    gate = o.select("candidate_id", (F.col("candidate_id") % 5 == 0).alias("escalate")).distinct()
    return policies.baselines(o, _FIXED, _ESCALATE, gate, _SINGLE, ["signup", "view"], anchor_rare)


_FULL = """full_ AS (SELECT *, list_filter(['t' || candidate_id % 4, CASE WHEN candidate_id % 3 = 0 THEN 't9' END], lambda x: x IS NOT NULL) AS truths,
  list_filter([CASE WHEN success THEN 't' || candidate_id % 4 END, CASE WHEN tokens % 3 = 0 THEN 't9' END, CASE WHEN tokens % 7 = 0 THEN 't8' END], lambda x: x IS NOT NULL) AS matched,
  CASE WHEN unsupported > 0 THEN tokens % 4 ELSE 0 END AS vt, CASE WHEN unsupported > 1 THEN tokens % 2 ELSE 0 END AS vf,
  row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS place FROM outcomes)"""
_BASELINES = f"""chance AS (SELECT candidate_id, 1 - (1 - max(probability) FILTER (place = 1)) * (1 - coalesce(max(probability) FILTER (place = 2), 0)) AS chance FROM full_ GROUP BY candidate_id),
choice AS (SELECT 'full5' AS policy, candidate_id, assignment FROM full_ UNION ALL SELECT 'utility_top2', candidate_id, assignment FROM full_ WHERE place <= 2
  UNION ALL SELECT 'fixed_top2', candidate_id, assignment FROM full_ WHERE assignment IN ('click', 'purchase')
  UNION ALL SELECT 'formula_escalation', candidate_id, assignment FROM full_ JOIN chance USING (candidate_id) WHERE place <= 2 OR chance < {_ESCALATE}
  UNION ALL SELECT 'adaptive_gate', candidate_id, assignment FROM full_ WHERE place <= 2 OR candidate_id % 5 = 0
  UNION ALL SELECT 'best_single', candidate_id, assignment FROM full_ WHERE assignment = '{_SINGLE}' UNION ALL SELECT 'best_fixed2', candidate_id, assignment FROM full_ WHERE assignment IN ('signup', 'view'))"""
_ECE = "len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= p)) - 1"


def _measures() -> str:
    real = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(26,12))) AS DOUBLE)"
    error = lambda name, rows: f"""{name}_b AS (SELECT CASE WHEN p >= 0 AND p <= 1 THEN {_ECE} END AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM {rows} GROUP BY 1),
{name} AS (SELECT (SELECT round(coalesce(avg(power(p - y, 2)), 0), 9) FROM {rows}) AS brier, round(sum(CASE WHEN bin IS NOT NULL THEN n * abs(c - a) ELSE 0 END) / sum(n), 9) AS ece FROM {name}_b)"""  # noqa: E731
    return f"""avg_ AS (SELECT assignment, CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS average FROM full_ GROUP BY assignment),
every AS (SELECT f.candidate_id, bool_or(success) AS any_success, list_distinct(flatten(list(truths))) AS truths, count(*) AS assignments,
  max(round_even(CAST(success AS DOUBLE) - 0.5 * CAST(false_positive AS INTEGER) - 0.25 * unsupported - 1.0 * CAST(cost AS DECIMAL(18,6))::DOUBLE, 6)) AS best,
  coalesce(list_distinct(flatten(list(matched) FILTER (place <= 2))), []) AS top_matched, any_value(chance) AS chance FROM full_ f JOIN chance c ON f.candidate_id = c.candidate_id GROUP BY f.candidate_id),
enough AS (SELECT *, list_has_all(top_matched, truths) AS sufficient FROM every),
taken AS (SELECT policy, candidate_id, count(*) AS n, bool_or(success) AS success, sum(CAST(false_positive AS INTEGER)) AS fp, sum(unsupported) AS un, sum(CAST(cost AS DECIMAL(18,6))) AS cost,
  sum(CAST(average AS DECIMAL(24,12))) AS expected, list_distinct(flatten(list(matched))) AS matched, sum(CASE WHEN vt <> 0 OR vf <> 0 THEN vt ELSE CAST(success AS INTEGER) END) AS tn, sum(CASE WHEN vt <> 0 OR vf <> 0 THEN vf ELSE CAST(false_positive AS INTEGER) END) AS fn,
  sum(tokens * 10) AS pt, sum(tokens) AS ct, sum(CAST(cost * 2 AS DECIMAL(18,6))) AS lat FROM choice JOIN full_ USING (candidate_id, assignment) JOIN avg_ USING (assignment) GROUP BY policy, candidate_id),
g AS (SELECT p.policy, e.*, coalesce(n, 0) AS n, coalesce(success, FALSE) AS success, list_intersect(coalesce(matched, []), truths) AS got, coalesce(n, 0) = assignments AS escalated,
  round_even(CAST(coalesce(success, FALSE) AS DOUBLE) - 0.5 * coalesce(fp, 0) - 0.25 * coalesce(un, 0) - 1.0 * coalesce(cost, 0)::DOUBLE, 6) AS reward, expected, coalesce(cost, 0) AS cost, tn, fn, pt, ct, lat
  FROM enough e CROSS JOIN (SELECT DISTINCT policy FROM choice) p LEFT JOIN taken t ON t.policy = p.policy AND t.candidate_id = e.candidate_id),
cal_rows AS (SELECT probability AS p, CAST(success AS DOUBLE) AS y FROM full_), gate_rows AS (SELECT chance AS p, CAST(sufficient AS DOUBLE) AS y FROM enough), {error("cal", "cal_rows")}, {error("gate", "gate_rows")},
s AS (SELECT policy, count(*) AS c, count(*) FILTER (success) AS suc, count(*) FILTER (any_success) AS ora, CAST(sum(n) AS BIGINT) AS tasks, {real("expected")} AS expected, {real("reward")} AS reward, {real("best")} AS best, sum(len(truths)) AS t, sum(len(got)) AS m,
  count(*) FILTER (list_has_all(got, truths)) AS exact, coalesce(sum(tn), 0) AS tn_, coalesce(sum(fn), 0) AS fn_, count(*) FILTER (escalated) AS esc, {real("cost")} AS cost, coalesce(sum(pt), 0)::DOUBLE AS pt, coalesce(sum(ct), 0)::DOUBLE AS ct, {real("coalesce(lat, 0)")} AS lat, count(DISTINCT CASE WHEN n > 0 THEN candidate_id END) AS web,
  count(*) FILTER (NOT sufficient AND escalated)::DOUBLE AS tp, count(*) FILTER (NOT sufficient AND NOT escalated)::DOUBLE AS fneg, count(*) FILTER (sufficient AND escalated)::DOUBLE AS fpos, count(*) FILTER (sufficient AND NOT escalated)::DOUBLE AS tneg FROM g GROUP BY policy),
r AS (SELECT *, CASE WHEN tn_ + fn_ = 0 THEN 1.0 ELSE tn_::DOUBLE / (tn_ + fn_) END AS precision, CASE WHEN t = 0 THEN 1.0 ELSE m::DOUBLE / t END AS recall FROM s),
m AS (SELECT policy, c AS candidate_count, suc::DOUBLE / c AS success_coverage, ora::DOUBLE / c AS oracle_coverage, tasks::DOUBLE / c AS average_assignments, expected / c AS average_expected_cost, reward / c AS average_realized_reward, best / c AS average_oracle_reward, greatest(0.0, best - reward) / c AS average_regret,
  recall AS truth_recall, exact::DOUBLE / c AS exact_coverage, precision AS outcome_precision, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS outcome_f1, esc::DOUBLE / c AS full5_rate, cost / c AS average_realized_cost, pt / c AS average_prompt_tokens, ct / c AS average_completion_tokens, lat / c AS average_latency_seconds,
  tasks AS logical_expert_tasks, tasks AS research_physical_requests, web AS web_batched_requests, web AS estimated_api_requests, cal.brier AS brier_score, cal.ece AS expected_calibration_error, CASE WHEN tp + fneg = 0 THEN 1.0 ELSE tp / (tp + fneg) END AS escalation_recall, CASE WHEN tp + fneg = 0 THEN 0.0 ELSE fneg / (tp + fneg) END AS missed_escalation_rate,
  CASE WHEN fpos + tneg = 0 THEN 0.0 ELSE fpos / (fpos + tneg) END AS unnecessary_escalation_rate, gate.brier AS gate_brier_score, gate.ece AS gate_expected_calibration_error FROM r, cal, gate)"""


@query("policy_metrics", f"WITH {OUTCOMES}, {_FULL}, {_BASELINES}, {_measures()} SELECT * FROM m WHERE policy = 'utility_top2'")
def policy_metrics(spark, sf):
    """All measures of the best two by probability."""
    o = full_outcomes(spark, sf)
    return policies.evaluate(o, compared(o).where("policy = 'utility_top2'"))


@query("policy_comparison", f"WITH {OUTCOMES}, {_FULL}, {_BASELINES}, {_measures()} SELECT * FROM m")
def policy_comparison(spark, sf):
    """All measures of the router's gate and the baselines."""
    o = full_outcomes(spark, sf)
    return policies.evaluate(o, compared(o), check=False)


_FIXED_CHOICES = f"""{_BASELINES[: _BASELINES.index("choice AS")]}a_ AS (SELECT DISTINCT assignment FROM outcomes),
choice AS (SELECT assignment AS policy, candidate_id, assignment FROM full_ UNION ALL SELECT least(f.assignment, a_.assignment) || '|' || greatest(f.assignment, a_.assignment), candidate_id, f.assignment FROM full_ f JOIN a_ ON f.assignment <> a_.assignment)"""


@query("chosen_baselines", f"""WITH {OUTCOMES}, {_FULL}, {_FIXED_CHOICES}, {_measures()}, o AS (SELECT *, CASE WHEN contains(policy, '|') THEN 'best_fixed2' ELSE 'best_single' END AS kind FROM m)
SELECT kind, policy, round(truth_recall, 9) AS truth_recall, round(outcome_f1, 9) AS outcome_f1, round(average_realized_cost, 9) AS average_realized_cost FROM o QUALIFY row_number() OVER (PARTITION BY kind ORDER BY truth_recall DESC, outcome_f1 DESC, average_realized_cost, policy) = 1""")
def chosen_baselines(spark, sf):
    """The single assignment and the pair that a router is compared with."""
    best = policies.chosen_baselines(full_outcomes(spark, sf))
    return best.select("kind", "policy", *[F.round(c, 9).alias(c) for c in ("truth_recall", "outcome_f1", "average_realized_cost")])


@query("policy_false_alarms", f"""WITH {OUTCOMES}, {_FULL}, {_BASELINES}, every_choice AS (SELECT * FROM choice UNION ALL SELECT 'anchor_rare', candidate_id, assignment FROM full_ WHERE assignment = 'view' OR (assignment = 'click' AND probability >= 0.2)),
negatives AS (SELECT DISTINCT candidate_id FROM full_ WHERE candidate_id % 4 = 1), total AS (SELECT count(*) AS n FROM negatives),
t AS (SELECT policy, candidate_id, sum(CASE WHEN vt <> 0 OR vf <> 0 THEN vf ELSE CAST(false_positive AS INTEGER) END) AS f, count(*) AS n FROM every_choice JOIN full_ USING (candidate_id, assignment) JOIN negatives USING (candidate_id) GROUP BY ALL)
SELECT policy, any_value(total.n) AS negative_candidate_count, count(*) FILTER (f > 0) AS false_positive_candidate_count, count(*) FILTER (f > 0)::DOUBLE / any_value(total.n) AS false_positive_rate, CAST(sum(f) AS BIGINT) AS validated_false_finding_count, CAST(sum(t.n) AS BIGINT) AS selected_outcome_count FROM t, total GROUP BY policy""")
def policy_false_alarms(spark, sf):
    """All eight policies on candidates without a truth, which every fourth is here; anchors are views, rare ones likely clicks."""
    o = full_outcomes(spark, sf).withColumn("ground_truth_ids", F.when(F.col("candidate_id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.col("ground_truth_ids")))
    o = written(o, "outcomes")
    anchored = o.where("assignment = 'view' OR (assignment = 'click' AND probability >= 0.2)").select("candidate_id", "assignment")
    return policies.false_alarms(o, compared(o, anchored))


@query("validated_counts", f"WITH {OUTCOMES}, {_FULL} SELECT candidate_id, assignment, CAST(CASE WHEN vt <> 0 OR vf <> 0 THEN vt ELSE CAST(success AS INTEGER) END AS INTEGER) AS validated_true, CAST(CASE WHEN vt <> 0 OR vf <> 0 THEN vf ELSE CAST(false_positive AS INTEGER) END AS INTEGER) AS validated_false FROM full_")
def validated_counts(spark, sf):
    t, f = policies.validated_counts(F.col("validated_true"), F.col("validated_false"), F.col("success"), F.col("false_positive"))
    return full_outcomes(spark, sf).select("candidate_id", "assignment", t.alias("validated_true"), f.alias("validated_false"))


@query("best_pair", f"""WITH {OUTCOMES}, p AS (SELECT x.assignment AS a, y.assignment AS b, count(*) AS groups, count(*) FILTER (x.success OR y.success) AS covered, CAST(sum(CAST(x.cost AS DECIMAL(18,6)) + CAST(y.cost AS DECIMAL(18,6))) AS DOUBLE) AS cost
  FROM outcomes x JOIN outcomes y USING (candidate_id) WHERE x.assignment < y.assignment GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY covered DESC, cost, a, b) AS place FROM p""")
def best_pair(spark, sf):
    return calibration.best_pair(outcomes(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("negative_fpr", f"""WITH {OUTCOMES}, {_POLICIES}, neg AS (SELECT candidate_id FROM outcomes GROUP BY candidate_id HAVING count(*) FILTER (success) < 5)
SELECT policy, count(DISTINCT candidate_id) AS negatives, count(DISTINCT CASE WHEN false_positive THEN candidate_id END) AS alarms FROM policy JOIN outcomes USING (candidate_id, assignment) WHERE candidate_id IN (SELECT candidate_id FROM neg) GROUP BY policy""")
def negative_fpr(spark, sf):
    o = outcomes(spark, sf)
    negatives = o.groupBy("candidate_id").agg(F.count_if("success").alias("s")).where("s < 5").select("candidate_id")
    chosen = choices(o).join(o, ["candidate_id", "assignment"]).join(negatives, "candidate_id", "left_semi")
    return chosen.groupBy("policy").agg(F.countDistinct("candidate_id").alias("negatives"), F.countDistinct(F.when(F.col("false_positive"), F.col("candidate_id"))).alias("alarms"))


@query("escalation_calibration", f"""WITH {OUTCOMES}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS n FROM outcomes),
g AS (SELECT candidate_id, round_even(1 - (1 - max(probability) FILTER (n = 1)) * (1 - max(probability) FILTER (n = 2)), 6) AS confidence, CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) FILTER (n <= 2) AS BIGINT) AS pair_cost,
  CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) AS BIGINT) AS full_cost, count(*) FILTER (n <= 2 AND success) AS pair_hits, count(*) FILTER (success) AS full_hits FROM r GROUP BY candidate_id),
th AS (SELECT DISTINCT confidence FROM g UNION SELECT -1.0),
s AS (SELECT th.confidence, count(*) FILTER (g.confidence <= th.confidence) AS escalated, sum(CASE WHEN g.confidence <= th.confidence THEN full_cost ELSE pair_cost END) AS cost, sum(CASE WHEN g.confidence <= th.confidence THEN full_hits ELSE pair_hits END)::DOUBLE / sum(full_hits) AS recall FROM th, g GROUP BY th.confidence)
SELECT confidence, escalated, CAST(cost AS BIGINT) AS cost, recall FROM s ORDER BY recall < 0.8, CASE WHEN recall >= 0.8 THEN 0 ELSE -recall END, cost, escalated, confidence LIMIT 1""")
def escalation_calibration(spark, sf):
    r = ranking.ranked(outcomes(spark, sf), ["candidate_id"], F.desc("probability"), F.asc("assignment"), name="n")
    micro, pair = F.round(F.col("cost") * 1_000_000).cast("long"), F.col("n") <= 2
    p = lambda k: F.max(F.when(F.col("n") == k, F.col("probability")))
    g = r.groupBy("candidate_id").agg(
        F.bround(scores.independence(p(1), p(2)), 6).alias("confidence"), F.sum(F.when(pair, micro)).alias("pair_cost"), F.sum(micro).alias("full_cost"),
        F.count_if(pair & F.col("success")).alias("pair_hits"), F.count_if("success").alias("full_hits"), F.count_if("success").alias("truths"),
    )
    return calibration.escalation_calibration(g, 0.8)


CONFIDENCES, MARGINS, ENTROPY = [0.2, 0.22, 0.24, 0.26, 0.28, 0.3], [0.0, 0.01, 0.02, 0.05], 1.6
_ONE = f"top1 >= min_confidence AND margin >= min_margin AND entropy <= {ENTROPY}"
_GRID = f"""q AS (SELECT a.candidate_id, a.top1, a.margin, round(a.entropy, 9) AS entropy, bool_or(o.success) FILTER (r.n = 1) AS one_right, bool_or(o.success) FILTER (r.n <= 2) AS two_right FROM a JOIN r USING (candidate_id) JOIN outcomes o ON o.candidate_id = r.candidate_id AND o.assignment = r.family GROUP BY 1, 2, 3, 4),
points AS (SELECT c AS min_confidence, m AS min_margin FROM (SELECT unnest({CONFIDENCES}::DOUBLE[]) AS c), (SELECT unnest({MARGINS}::DOUBLE[]) AS m)),
grid AS (SELECT min_confidence, min_margin, count(*) AS n, CAST(sum(CASE WHEN {_ONE} THEN 1 ELSE 2 END) AS BIGINT) AS calls, count(*) FILTER (CASE WHEN {_ONE} THEN one_right ELSE two_right END) AS covered,
  (count(*) FILTER (CASE WHEN {_ONE} THEN one_right ELSE two_right END))::DOUBLE / count(*) AS coverage FROM q, points GROUP BY 1, 2)"""


def _grid(spark, sf):
    o = outcomes(spark, sf)
    by = Window.partitionBy("candidate_id")
    p = o.withColumn("p", F.coalesce(F.try_divide("probability", F.sum("probability").over(by)), F.lit(0.0)))
    r = ranking.ranked(p, ["candidate_id"], F.desc("p"), F.asc("assignment"), name="n")
    entropy = F.round(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)), 9)
    q = r.groupBy("candidate_id").agg(F.max("p").alias("top1"), (F.max("p") - F.coalesce(F.max(F.when(F.col("n") == 2, F.col("p"))), F.lit(0.0))).alias("margin"), entropy.alias("entropy"), F.max(F.when(F.col("n") == 1, F.col("success"))).alias("top1_right"), F.max(F.when(F.col("n") <= 2, F.col("success"))).alias("right"))
    return calibration.policy_grid(q, CONFIDENCES, MARGINS, ENTROPY)


@query("policy_grid", f"WITH {OUTCOMES}, {_P}, {_GRID} SELECT * FROM grid")
def policy_grid(spark, sf):
    return _grid(spark, sf)


@query("policy_grid_choice", f"""WITH {OUTCOMES}, {_P}, {_GRID} SELECT *, calls::DOUBLE / n AS average_experts, coverage >= 0.9 AS target_met FROM grid
ORDER BY coverage < 0.9, CASE WHEN coverage >= 0.9 THEN calls ELSE -coverage END, CASE WHEN coverage >= 0.9 THEN -coverage ELSE calls END, min_confidence, min_margin LIMIT 1""")
def policy_grid_choice(spark, sf):
    """The point that calibration keeps."""
    return calibration.chosen_policy(_grid(spark, sf), 0.9)


@query("running_budget", """SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent,
  sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 500 AS admitted FROM events""")
def running_budget(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return ranking.running_budget(e, ["user_id"], "value", 500.0, F.asc("ts"), F.asc("event_id")).select("event_id", "user_id", F.col("spent").cast("double").alias("spent"), "admitted")


@query("budget_admission", """WITH RECURSIVE r AS (SELECT user_id, event_id AS id, CAST(event_id % 17 + 1 AS DOUBLE) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, value DESC, event_id) AS n FROM events),
s AS (SELECT user_id, n, id, CASE WHEN cost <= 120 THEN 120 - cost ELSE 120 END AS room, cost <= 120 AS admitted FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.id, CASE WHEN r.cost <= s.room THEN s.room - r.cost ELSE s.room END, r.cost <= s.room FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1) SELECT user_id, id, admitted FROM s""")
def budget_admission(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("first"), F.col("value").alias("priority"), (F.col("event_id") % 17 + 1).cast("double").alias("cost"))
    return ranking.budget_admission(e, "user_id", 120.0)


@query("even_share", "SELECT event_id, user_id, value / count(*) OVER (PARTITION BY user_id, event_type) AS share FROM events")
def even_share(spark, sf):
    """Cost of a shared call spread evenly over its tasks."""
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type"))
    return read(spark, sf, "events").select("event_id", "user_id", (F.col("value") / n).alias("share"))


@query("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated, count(*) AS changes FROM events GROUP BY user_id")
def latest_state(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("updated"), F.count(F.lit(1)).alias("changes"))


@query("json_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_extract(spark, sf):
    v = F.try_parse_json("props")
    return read(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("guard_classify", """WITH g AS (SELECT event_id, ['<', '<=', '>', '>=', '==', '!=', '&&', NULL][CAST(event_id % 8 + 1 AS INTEGER)] AS op, event_id % 4 = 1 AS sw, CASE WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END AS branch, event_id % 5 = 0 AS nul, event_id % 7 = 0 AS bang, event_id % 11 <> 0 AS inside FROM events),
b AS (SELECT *, CASE WHEN branch = 'false' THEN CASE op WHEN '<' THEN '>=' WHEN '<=' THEN '>' WHEN '>' THEN '<=' WHEN '>=' THEN '<' WHEN '==' THEN '!=' WHEN '!=' THEN '==' END ELSE op END AS o1 FROM g),
a AS (SELECT *, CASE WHEN sw THEN CASE o1 WHEN '<' THEN '>' WHEN '<=' THEN '>=' WHEN '>' THEN '<' WHEN '>=' THEN '<=' WHEN '==' THEN '==' WHEN '!=' THEN '!=' END ELSE o1 END AS o2 FROM b)
SELECT event_id, CASE WHEN op IS NULL THEN CASE WHEN NOT inside THEN 'generic' WHEN bang = (branch = 'false') THEN 'non_null' ELSE 'equality' END WHEN o2 = '!=' AND nul THEN 'non_null' WHEN o2 IN ('<', '<=') THEN 'upper_bound' WHEN o2 IN ('>', '>=') THEN 'lower_bound' ELSE 'equality' END AS guard FROM a""")
def guard_classify(spark, sf):
    e = read(spark, sf, "events")
    op = F.element_at(F.array(*map(F.lit, ["<", "<=", ">", ">=", "==", "!=", "&&", None])), (F.col("event_id") % 8 + 1).cast("int"))
    branch = F.when(F.col("event_id") % 3 == 0, "false").otherwise("true")
    unary = F.when(F.col("event_id") % 7 == 0, "!")
    return e.select("event_id", scores.guard_kind(op, F.col("event_id") % 4 == 1, branch, F.col("event_id") % 5 == 0, unary, F.col("event_id") % 11 != 0).alias("guard"))


@query("suspicion_score", f"""WITH f AS (SELECT user_id AS candidate_id, {', '.join(f"least(greatest(count(*) FILTER (event_id % 14 = {i} AND event_type <> 'view'), 0), 3.0)::DOUBLE AS c{i}" for i in range(14))} FROM events GROUP BY user_id)
SELECT candidate_id, round(1 - exp(-({' + '.join(f'{w} * c{i}' for i, w in enumerate(scores.SUSPICION_WEIGHTS.values()))})), 9) AS score FROM f""")
def suspicion_score(spark, sf):
    e = read(spark, sf, "events")
    counts = [F.count_if((F.col("event_id") % 14 == i) & (F.col("event_type") != "view")).cast("double").alias(f"c{i}") for i in range(14)]
    g = e.groupBy(F.col("user_id").alias("candidate_id")).agg(*counts)
    features = F.create_map(*[x for i, n in enumerate(scores.SUSPICION_WEIGHTS) for x in (F.lit(n), F.col(f"c{i}"))])
    return g.select("candidate_id", F.round(scores.suspicion(features), 9).alias("score"))


_WEIGHTS = list(scores.SUSPICION_WEIGHTS.items())


@query("suspicion_reasons", f"""WITH c AS (SELECT user_id AS candidate_id, CAST(event_id % 14 AS INTEGER) AS i, count(*) FILTER (event_type <> 'view') AS v FROM events GROUP BY 1, 2),
w AS (SELECT candidate_id, v, ({[n for n, _ in _WEIGHTS]})[i + 1] AS name, CAST({[w for _, w in _WEIGHTS]} AS DOUBLE[])[i + 1] * least(v, 3) AS x FROM c WHERE v > 0)
SELECT candidate_id, string_agg(name || '=' || v, ',' ORDER BY x DESC, name) AS reasons FROM w GROUP BY candidate_id""")
def suspicion_reasons(spark, sf):
    """Every feature that counts, with its value, the largest contribution first."""
    e = read(spark, sf, "events").where("event_type <> 'view'").groupBy(F.col("user_id").alias("candidate_id"), (F.col("event_id") % 14).cast("int").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _WEIGHTS]), F.col("i") + 1)
    features = e.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), "v"))).alias("f"))
    return features.select("candidate_id", F.array_join(scores.suspicion_reasons(F.col("f")), ",").alias("reasons"))


@query("matrix_cross_join", "WITH u AS (SELECT DISTINCT user_id AS candidate_id FROM events), a AS (SELECT DISTINCT event_type AS assignment FROM events) SELECT * FROM u, a")
def matrix_cross_join(spark, sf):
    e = read(spark, sf, "events")
    return splits.matrix(e.select(F.col("user_id").alias("candidate_id")).distinct(), e.select(F.col("event_type").alias("assignment")).distinct())


_WEEK = """cells AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INTEGER) AS week, event_type AS assignment FROM events),
a AS (SELECT DISTINCT assignment FROM cells), u AS (SELECT DISTINCT user_id, week FROM cells WHERE week % 5 <> 0), expected AS (SELECT user_id, week, assignment FROM u, a), found AS (SELECT DISTINCT * FROM cells WHERE week % 5 <> 1)"""


def _weeks(spark, sf):
    week = F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) / 7).cast("int")
    cells = read(spark, sf, "events").select("user_id", week.alias("week"), F.col("event_type").alias("assignment"))
    names = cells.select("assignment").distinct()
    return splits.matrix(cells.where("week % 5 <> 0").select("user_id", "week").distinct(), names), cells.where("week % 5 <> 1").distinct()


@query("remaining_work", f"WITH {_WEEK} SELECT * FROM expected EXCEPT SELECT * FROM found")
def remaining_work(spark, sf):
    return splits.remaining(*_weeks(spark, sf), ["user_id", "week", "assignment"])


@query("matrix_audit", f"""WITH {_WEEK}, e AS (SELECT user_id, week, count(*) AS expected FROM expected GROUP BY 1, 2), f AS (SELECT user_id, week, count(*) AS found FROM found GROUP BY 1, 2)
SELECT user_id, week, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN expected = found THEN 'complete' ELSE 'incomplete' END AS status FROM e FULL JOIN f USING (user_id, week)""")
def matrix_audit(spark, sf):
    return splits.matrix_audit(*_weeks(spark, sf), ["user_id", "week"], "assignment")


@query("matrix_plan", f"""WITH {_WEEK}, m AS (SELECT e.*, f.assignment IS NOT NULL AS done FROM expected e LEFT JOIN found f USING (user_id, week, assignment))
SELECT user_id, count(*) AS expected, count(*) FILTER (done) AS done, bool_and(done) AS complete FROM m GROUP BY user_id""")
def matrix_plan(spark, sf):
    expected, found = _weeks(spark, sf)
    m = expected.join(found.withColumn("have", F.lit(True)), ["user_id", "week", "assignment"], "left").withColumn("done", F.coalesce("have", F.lit(False)))
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("done").alias("done"), F.bool_and("done").alias("complete"))


@query("set_intersect", f"WITH {_WEEK} SELECT user_id, week FROM expected INTERSECT SELECT user_id, week FROM found")
def set_intersect(spark, sf):
    expected, found = _weeks(spark, sf)
    return expected.select("user_id", "week").intersect(found.select("user_id", "week"))


@query("set_except", f"WITH {_WEEK} SELECT user_id, week FROM found EXCEPT SELECT user_id, week FROM expected")
def set_except(spark, sf):
    expected, found = _weeks(spark, sf)
    return found.select("user_id", "week").subtract(expected.select("user_id", "week"))


@query("ece", f"""WITH {LABELLED}, b AS (SELECT len(list_filter([{', '.join(str(i / 10) for i in range(10))}]::DOUBLE[], lambda e: e <= p)) - 1 AS bin, count(*) AS n, avg(p) AS c, avg(quality::DOUBLE) AS a FROM labelled GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def ece(spark, sf):
    return metrics.expected_calibration_error(labelled(spark, sf), "p", F.col("quality")).withColumn("ece", F.round("ece", 9)).select("ece", "n")


@query("brier", f"WITH {LABELLED} SELECT lang, round(avg(power(p - quality, 2)), 9) AS brier, count(*) AS n FROM labelled GROUP BY lang")
def brier(spark, sf):
    return metrics.brier(labelled(spark, sf), "p", F.col("quality"), ["lang"]).select("lang", F.round("brier", 9).alias("brier"), "n")


@query("precision_recall_f1", f"""WITH {LABELLED}, c AS (SELECT source, count(*) FILTER (p >= 0.05 AND quality = 1) AS tp, count(*) FILTER (p >= 0.05 AND quality = 0) AS fp, count(*) FILTER (p < 0.05 AND quality = 1) AS fn FROM labelled GROUP BY source),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def precision_recall_f1(spark, sf):
    return metrics.precision_recall(labelled(spark, sf), ["source"], F.col("p") >= 0.05, F.col("quality") == 1)


@query("micro_macro_f1", f"""WITH {LABELLED}, c AS (SELECT source, count(*) FILTER (p >= 0.05 AND quality = 1) AS tp, count(*) FILTER (p >= 0.05 AND quality = 0) AS fp, count(*) FILTER (p < 0.05 AND quality = 1) AS fn FROM labelled GROUP BY source)
SELECT sum(tp)::DOUBLE / (sum(tp) + sum(fp)) AS micro_precision, sum(tp)::DOUBLE / (sum(tp) + sum(fn)) AS micro_recall, round(avg(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END), 9) AS macro_recall FROM c""")
def micro_macro_f1(spark, sf):
    c = metrics.precision_recall(labelled(spark, sf), ["source"], F.col("p") >= 0.05, F.col("quality") == 1)
    tp, fp, fn = (F.sum(x) for x in ("tp", "fp", "fn"))
    return c.agg(metrics.ratio(tp, tp + fp, 1.0).alias("micro_precision"), metrics.ratio(tp, tp + fn, 1.0).alias("micro_recall"), F.round(F.avg("recall"), 9).alias("macro_recall"))


@query("confusion_pivot", f"""WITH {LABELLED}, c AS (SELECT lang AS actual, CASE WHEN n_chars % 4 = 0 THEN 'en' WHEN n_chars % 4 = 1 THEN 'de' WHEN n_chars % 4 = 2 THEN 'fr' ELSE lang END AS predicted FROM labelled)
SELECT actual, count(*) FILTER (predicted = 'de') AS de, count(*) FILTER (predicted = 'en') AS en, count(*) FILTER (predicted = 'es') AS es, count(*) FILTER (predicted = 'fr') AS fr FROM c GROUP BY actual""")
def confusion_pivot(spark, sf):
    m = F.col("n_chars") % 4
    predicted = F.when(m == 0, "en").when(m == 1, "de").when(m == 2, "fr").otherwise(F.col("lang"))
    return metrics.confusion(labelled(spark, sf).select(F.col("lang").alias("actual"), predicted.alias("predicted")), "actual", "predicted", ["de", "en", "es", "fr"])


@query("multilabel_metrics", f"""WITH {LABELLED}, l AS (SELECT doc_id, 'quality' AS family, quality = 1 AS actual, p >= 0.05 AS predicted FROM labelled UNION ALL SELECT doc_id, 'toxic', toxic = 1, n_chars < 1000 FROM labelled)
SELECT family, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn, count(*) FILTER (NOT actual AND NOT predicted) AS tn FROM l GROUP BY family""")
def multilabel_metrics(spark, sf):
    pair = F.array(F.struct(F.lit("quality").alias("family"), (F.col("quality") == 1).alias("a"), (F.col("p") >= 0.05).alias("p")), F.struct(F.lit("toxic").alias("family"), (F.col("toxic") == 1).alias("a"), (F.col("n_chars") < 1000).alias("p")))
    rows = labelled(spark, sf).select(F.explode(pair).alias("x")).select("x.*")
    return rows.groupBy("family").agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if(~F.col("a") & F.col("p")).alias("fp"), F.count_if(F.col("a") & ~F.col("p")).alias("fn"), F.count_if(~F.col("a") & ~F.col("p")).alias("tn"))


@query("topk_coverage", f"""WITH {OUTCOMES}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY probability DESC, assignment) AS n FROM outcomes),
g AS (SELECT candidate_id, bool_or(success) FILTER (n = 1) AS one, bool_or(success) FILTER (n <= 2) AS two, bool_or(success) AS any_ FROM r GROUP BY candidate_id)
SELECT count(*) AS n, avg(CAST(one AS DOUBLE)) AS top1, avg(CAST(two AS DOUBLE)) AS top2, avg(CAST(any_ AS DOUBLE)) AS every FROM g""")
def topk_coverage(spark, sf):
    r = ranking.ranked(outcomes(spark, sf), ["candidate_id"], F.desc("probability"), F.asc("assignment"), name="n")
    g = r.groupBy("candidate_id").agg(F.max(F.when(F.col("n") == 1, F.col("success"))).alias("one"), F.max(F.when(F.col("n") <= 2, F.col("success"))).alias("two"), F.max("success").alias("any"))
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(a).cast("double")).alias(b) for a, b in (("one", "top1"), ("two", "top2"), ("any", "every"))])


@query("rare_threshold", f"""WITH {LABELLED}, s AS (SELECT source, p, count(*) AS t, count(*) FILTER (toxic = 1) AS f FROM labelled GROUP BY source, p),
c AS (SELECT source, p, CAST(sum(t) OVER w AS BIGINT) AS triggered, sum(f) OVER w AS found, sum(t) OVER (PARTITION BY source) AS n, sum(f) OVER (PARTITION BY source) AS positives FROM s WINDOW w AS (PARTITION BY source ORDER BY p DESC)),
k AS (SELECT *, found::DOUBLE / positives AS recall, row_number() OVER (PARTITION BY source ORDER BY triggered, -p) AS r FROM c WHERE positives > 0 AND found::DOUBLE / positives >= 0.8)
SELECT source, p AS threshold, triggered, recall, triggered::DOUBLE / n AS trigger_rate FROM k WHERE r = 1""")
def rare_threshold(spark, sf):
    return calibration.rare_thresholds(labelled(spark, sf), "source", "p", F.col("toxic") == 1, 0.8)


_EXPERTS = ["memory_bounds", "lifetime_resource", "integer_overflow", "taint_api", "control_state"]
_REPLAY = f"""cases AS (SELECT case_id, case_id % 17 = 0 AS error FROM (SELECT DISTINCT case_id FROM spans)), before AS (SELECT c.* FROM candidates c JOIN cases USING (case_id) WHERE NOT error),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, file, line_start, id) AS nth FROM before WHERE score >= 0.4) WHERE nth <= 6),
met AS (SELECT candidate_id, list(truth_id) AS truths, list(t_expert) AS experts FROM pairs GROUP BY candidate_id),
outcome AS (SELECT c.case_id, c.id AS candidate_id, a.assignment, c.line_start, c.line_end, c.expert, coalesce(truths, []) AS truths, coalesce(list_filter(truths, lambda t, i: experts[i] = a.assignment), []) AS matched
  FROM candidates c JOIN (SELECT unnest({_EXPERTS}) AS assignment) a ON c.project % 5 <> 0 LEFT JOIN met ON candidate_id = c.id),
matrix AS (SELECT o.*, len(matched) > 0 AS success, len(matched) = 0 AND o.line_start % 3 = 0 AS fp FROM outcome o JOIN kept k ON k.id = o.candidate_id),
taken AS (SELECT * FROM matrix WHERE assignment IN (expert, 'control_state')),
masks AS (SELECT case_id, truth_id, bit_or(mask) AS mask FROM (SELECT case_id, id AS truth_id, 1 AS mask FROM truths UNION ALL SELECT case_id, p.truth_id, 2 FROM pairs p JOIN before b USING (case_id) WHERE b.id = p.candidate_id UNION ALL SELECT p.case_id, p.truth_id, 4 FROM pairs p JOIN kept k ON k.id = p.candidate_id
  UNION ALL SELECT case_id, unnest(truths), 8 FROM matrix UNION ALL SELECT case_id, unnest(matched), 16 FROM matrix UNION ALL SELECT case_id, unnest(matched), 32 FROM taken) GROUP BY ALL),
counted AS (SELECT count(*) AS truth, count(*) FILTER (mask & 2 > 0) AS a, count(*) FILTER (mask & 4 > 0) AS g, count(*) FILTER (mask & 8 > 0) AS m, count(*) FILTER (mask & 16 > 0) AS o, count(*) FILTER (mask & 32 > 0) AS r FROM masks WHERE mask & 1 > 0),
exact_ AS (SELECT count(*) AS cases, count(*) FILTER (error) AS errors, count(*) FILTER (NOT error AND coalesce(n, 0) = 0) AS exact FROM cases LEFT JOIN (SELECT case_id, count(*) AS n FROM masks WHERE mask & 33 = 1 GROUP BY case_id) USING (case_id)),
spent AS (SELECT count(*) AS tasks, count(DISTINCT case_id) AS web, sum(line_end * 10) AS prompt, sum(line_start) AS completion, CAST(sum(CAST((line_end % 7) / 100 AS DECIMAL(18,6))) AS DOUBLE) AS cost, sum(CASE WHEN line_end % 4 = 0 THEN line_end % 3 + 1 ELSE CAST(success AS INTEGER) END) AS t, sum(CASE WHEN line_end % 4 = 0 THEN 0 ELSE CAST(fp AS INTEGER) END) AS f FROM taken)"""


@query("utility_end_to_end", f"""WITH {SPANS}, {_REPLAY}
SELECT cases AS case_count, errors AS analysis_error_count, truth AS ground_truth_count, (SELECT count(*) FROM before) AS analyzer_candidate_count, (SELECT count(*) FROM kept) AS gated_candidate_count, (SELECT count(DISTINCT candidate_id) FROM matrix) AS outcome_matrix_candidate_count,
  a AS analyzer_truth_hits, g AS gated_truth_hits, m AS outcome_matrix_truth_hits, o AS full5_oracle_truth_hits, r AS routed_truth_hits, a / truth AS analyzer_candidate_recall, g / a AS candidate_gate_gt_retention, g / truth AS post_gate_candidate_recall, m / truth AS outcome_matrix_gt_coverage,
  o / truth AS full5_oracle_detection_recall, r / truth AS routed_detection_recall, r / o AS routing_retention_vs_full5, t / (t + f) AS validated_outcome_precision, 2 * (t / (t + f)) * (r / truth) / (t / (t + f) + r / truth) AS end_to_end_f1, exact / cases AS exact_case_coverage,
  tasks / (SELECT count(DISTINCT candidate_id) FROM matrix) AS average_assignments_per_routed_candidate, tasks AS logical_expert_tasks, tasks AS research_physical_requests, web AS web_batched_requests, prompt AS prompt_tokens, completion AS completion_tokens, cost AS realized_cost FROM counted, exact_, spent""")
def utility_end_to_end(spark, sf):
    """All measures of a replay: spans as cases, truths and candidates; five experts' outcomes match the truths of their kind."""
    named = lambda df: df.withColumnRenamed("id", "candidate_id")
    t, c = truths(spark, sf).withColumnRenamed("id", "truth_id"), named(candidates(spark, sf))
    cases = spans(spark, sf).select("case_id").distinct().withColumn("error", F.col("case_id") % 17 == 0)
    # the truths of a case's file come to its candidates as one list, so candidates are dealt once
    told = t.groupBy("case_id", "file").agg(F.collect_list(F.struct("truth_id", "expert", "line_start", "line_end")).alias("told"))
    near = lambda x: (F.col("line_start") <= x["line_end"]) & (F.col("line_end") >= x["line_start"])
    some = F.transform(F.coalesce(F.filter("told", near), F.array().cast("array<struct<truth_id:string,expert:string,line_start:int,line_end:int>>")), lambda x: F.struct(x["truth_id"].alias("truth_id"), x["expert"].alias("expert")))
    rows = c.where("project % 5 <> 0").join(told, ["case_id", "file"], "left").withColumn("_met", some).drop("told").withColumn("assignment", F.explode(F.array(*map(F.lit, _EXPERTS))))
    some = F.col("_met")
    ids = lambda a: F.transform(a, lambda x: x["truth_id"])
    rows = rows.withColumns({"ground_truth_ids": ids(some), "matched_truth_ids": ids(F.filter(some, lambda x: x["expert"] == F.col("assignment")))})
    success = F.size("matched_truth_ids") > 0
    counted = F.col("line_end") % 4 == 0
    outcomes = rows.select(
        "case_id", "candidate_id", "assignment", success.alias("success"), (~success & (F.col("line_start") % 3 == 0)).alias("false_positive"), F.when(counted, F.col("line_end") % 3 + 1).otherwise(0).alias("validated_true"), F.lit(0).alias("validated_false"),
        "matched_truth_ids", "ground_truth_ids", (F.col("line_end") * 10).alias("prompt_tokens"), F.col("line_start").alias("completion_tokens"), (F.col("line_end") % 7 / 100).alias("cost"),
    )
    routes = c.select("case_id", "candidate_id", F.explode(F.array_distinct(F.array("expert", F.lit("control_state")))).alias("assignment")).where(F.col("assignment").isin(_EXPERTS))
    return replay.end_to_end(cases, t, c, outcomes, routes, 0.4, most_per_case=6)
