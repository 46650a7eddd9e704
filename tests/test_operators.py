"""Hand-made cases of the operators: gates, stages, routes, matches, splits, audits, graphs, scores."""

import random

import pytest
from pyspark.sql import functions as F

from evidark.functions import scores, taxonomy, text
from evidark.operators import calibration, graph, metrics, ranking, spans, splits
from evidark.plans import catalog

SPAN = "id string, case_id string, file int, line_start int, line_end int, score double, expert string"


def span_rows(spark, rows, expert="memory_bounds"):
    return spark.createDataFrame([(r[0], r[1], 0, r[2], r[2], float(r[3]), r[4] if len(r) > 4 else expert) for r in rows], SPAN)


def test_gate_calibration_golden(spark):
    t = span_rows(spark, [("t1", "a", 5, 0), ("t2", "b", 10, 0)])
    c = span_rows(spark, [("c1", "a", 5, 0.8), ("c2", "a", 2, 0.1), ("c3", "b", 10, 0.4), ("c4", "b", 3, 0.2)])
    assert calibration.gate_calibration(c, t).first().asDict() == {"threshold": 0.4, "retention": 1.0, "kept": 2, "reduction": 0.5}
    dev = span_rows(spark, [("c1", "a", 5, 0.6), ("c2", "a", 1, 0.2)])
    assert calibration.gate_calibration(dev, t.where("id = 't1'"), 1.0).first().threshold == 0.6
    test = calibration.gate_evaluation(span_rows(spark, [("c", "a", 5, 0.1)]), t.where("id = 't1'"), 0.6).first()
    assert (test.recall, test.gated_recall) == (1.0, 0.0)


def brute_gate(cands, best, target):
    found = []
    for t in {0.0, 1.0, *cands}:
        kept = sum(c >= t for c in cands)
        retention = sum(b >= t for b in best) / len(best) if best else 1.0
        found.append((kept, retention, t))
    fine = [x for x in found if x[1] >= target]
    k = min(fine, key=lambda x: (x[0], -x[2])) if fine else max(found, key=lambda x: (x[1], -x[0], -x[2]))
    return k[2], k[0]


@pytest.mark.parametrize("seed", range(4))
def test_gate_calibration_by_brute_force(spark, seed):
    rng = random.Random(seed)
    c = [(f"c{i}", rng.choice("ab"), rng.randint(1, 9), rng.randint(0, 10) / 10) for i in range(30)]
    t = [(f"t{i}", rng.choice("ab"), rng.randint(1, 9), 0) for i in range(8)]
    best = [max(x) for x in ([s for _, k, l, s in c if (k, l) == (tk, tl)] for _, tk, tl, _ in t) if x]
    got = calibration.gate_calibration(span_rows(spark, c), span_rows(spark, t), 0.8).first()
    assert (got.threshold, got.kept) == brute_gate([x[3] for x in c], best, 0.8)


def test_stage_decomposition_golden(spark):
    t = span_rows(spark, [("t1", "a", 1, 0), ("t2", "a", 10, 0), ("t3", "a", 20, 0)])
    c = span_rows(spark, [("c1", "a", 1, 0.9), ("c2", "a", 10, 0.1)])
    r = metrics.stage_decomposition(c, t, 0.5, F.lit(True)).first()
    assert (round(r.recall, 6), r.retention, round(r.gated_recall, 6), r.conditional, round(r.end_to_end, 6)) == (0.666667, 0.5, 0.333333, 1.0, 0.333333)


def test_misses_stay_in_the_denominator(spark):
    t = span_rows(spark, [(f"t{i}", f"case-{i}", 5, 0) for i in range(3)])
    r = metrics.analyzer_metrics(span_rows(spark, [("c", "case-0", 5, 1)]), t).first()
    assert (round(r.recall, 6), r.truths, r.truth_cases) == (0.333333, 3, 3)


def test_greedy_match_counts_a_second_hit_as_false(spark):
    t = span_rows(spark, [("t1", "a", 5, 0)])
    got = spans.greedy_match(span_rows(spark, [("f1", "a", 5, 0.5), ("f2", "a", 5, 0.9)]), t).collect()
    assert [(r.finding_id, r.truth_id) for r in got] == [("f2", "t1")]


def test_nearest_match_by_brute_force(spark):
    rng = random.Random(3)
    p = [(f"p{i}", rng.choice("abc"), rng.randint(1, 40), 0) for i in range(40)]
    t = [(f"t{i}", rng.choice("ab"), rng.randint(1, 40), 0) for i in range(15)]
    want = {i: min((abs(l - m), j) for j, d, m, _ in t if d == k) for i, k, l, _ in p if k != "c"}
    got = {r.id: (r.distance, r.target_id) for r in spans.nearest_match(span_rows(spark, p), span_rows(spark, t)).collect()}
    assert got == want


def test_adaptive_top_k_golden(spark):
    rows = [("one", "a", 0.82), ("one", "b", 0.10), ("one", "c", 0.08), ("two", "a", 0.46), ("two", "b", 0.42), ("two", "c", 0.12)]
    out = ranking.adaptive_top_k(spark.createDataFrame(rows, "g string, family string, score double"), "g", 0.70, 0.20, 10.0)
    assert {r.g: r.selected for r in out.collect()} == {"one": ["a"], "two": ["a", "b"]}


def test_hard_negatives_keep_a_place(spark):
    rows = [("g", f"p{i}", True, 1 - i / 10) for i in range(5)] + [("g", f"n{i}", False, i / 10) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id string, y boolean, s double")
    got = [r.id for r in ranking.hard_negatives(df, "g", F.col("y"), 4, 1, F.desc("s"), F.asc("id")).collect()]
    assert sorted(got) == ["n2", "p0", "p1", "p2"]


def test_budget_and_quota(spark):
    rows = [("u", 1, True, 1.0, 6.0), ("u", 2, False, 9.0, 5.0), ("u", 3, False, 1.0, 4.0), ("u", 4, True, 0.5, 7.0)]
    df = spark.createDataFrame(rows, "u string, id int, first boolean, priority double, cost double")
    assert {r.id for r in ranking.budget_admission(df, "u", 10.0).where("admitted").collect()} == {1, 3}
    df = spark.createDataFrame([("g", i, "ab"[i % 2], "x") for i in range(8)], "g string, id int, a string, b string")
    assert sorted(r.id for r in ranking.quota_sample(df, {"a": 2, "b": 3}, "g").collect()) == [0, 1, 2]


def test_largest_remainder_sums_to_total(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "k string, w int")
    assert {r.k: r.quota for r in ranking.largest_remainder(w, "k", "w", 10).collect()} == {"a": 4, "b": 3, "c": 3, "d": 0}


def test_splits_are_disjoint_and_complete(spark):
    keys = spark.createDataFrame([(f"p{i}",) for i in range(8)] * 2, "k string")
    got = splits.hash_split(keys, "k").collect()
    assert len(got) == 8 and {r.split for r in got} == {"train", "dev", "test"}
    again = {r.k: r.split for r in splits.hash_split(keys.orderBy(F.desc("k")), "k").collect()}
    assert again == {r.k: r.split for r in got}


def test_matrix_audit_finds_the_missing_group(spark):
    expected = splits.matrix(spark.createDataFrame([("a",), ("b",)], "c string"), spark.createDataFrame([("x",), ("y",)], "m string"))
    found = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "x")], "c string, m string")
    assert {r.c: r.status for r in splits.matrix_audit(expected, found, ["c"], "m").collect()} == {"a": "complete", "b": "missing", "z": "unexpected"}


def test_deficit_assignment_follows_shares(spark):
    c = spark.createDataFrame([("f", i, 1) for i in range(20)], "fam string, cluster int, size int")
    got = splits.deficit_assignment(c, "fam", {"train": 0.7, "dev": 0.15, "test": 0.15}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 14, "dev": 3, "test": 3}


@pytest.mark.parametrize("seed", range(3))
def test_components_by_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    group = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group


def test_distances_and_dominators(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.distance for r in graph.distances(e, start, 9).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2}
    assert {r.node for r in graph.distances(e, start, 9, F.col("node") != 3).collect()} == {0, 1, 2, 3}
    n = spark.createDataFrame([("f", i) for i in range(5)], "fn string, node long")
    dom = {(r.node, r.dominator) for r in graph.dominators(n, e.selectExpr("'f' AS fn", "src", "dst")).collect()}
    assert (4, 3) in dom and (3, 2) not in dom and (2, 1) in dom


def test_calibration_error_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 1), (1.0, 1), (2.0, 1)], "p double, y int")
    got = metrics.expected_calibration_error(rows, "p", F.col("y")).first()
    assert abs(got.ece - 0.9 / 4) < 1e-9 and got.n == 4
    assert metrics.expected_calibration_error(rows.where("false"), "p", F.col("y")).first().ece == 0.0


def test_taxonomy(spark):
    w = {n: (c, e) for n, c, e in taxonomy.weaknesses()}
    assert [w[n][1] for n in (401, 190, 78, 252, 367, 476)] == ["memory_bounds", "integer_overflow", "taint_api", "control_state", "concurrency", "memory_bounds"]
    assert w[457][0] == "control_state"
    df = spark.createDataFrame([("Heap-buffer-overflow WRITE 4",), ("Heap-use-after-free READ 8",), ("whatever",), (None,), ("heap use after free",), ("Null dereference",), ("signed integer overflow",)], "d string")
    got = [tuple(r.c) for r in df.select(taxonomy.crash_class(F.col("d")).alias("c")).collect()]
    assert got == [("memory_bounds", 787), ("lifetime_resource", 416), ("control_state", None), ("control_state", None), ("control_state", None), ("control_state", None), ("integer_overflow", 190)]
    names = spark.createDataFrame([("cwe-0190 x",), ("none",), ("CWE_78",)], "t string").select(taxonomy.normal_name(F.col("t"))).collect()
    assert [r[0] for r in names] == ["CWE-190", None, "CWE-78"]


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    f = F.create_map(F.lit("double_release_count"), F.lit(9.0), F.lit("memory_copy_count"), F.lit(-1.0))
    assert abs(value(scores.suspicion(f)) - (1 - 2.718281828459045**-3)) < 1e-12
    assert value(scores.suspicion_reasons(f)) == ["double_release_count=9"]
    many = F.create_map(*[F.lit(x) for kv in (("double_release_count", 1.0), ("use_after_release_count", 1.0), ("memory_copy_count", 2.5), ("array_access_count", 7.0)) for x in kv])
    assert value(scores.suspicion_reasons(many)) == ["double_release_count=1", "use_after_release_count=1", "memory_copy_count=2.5", "array_access_count=7"]
    assert value(scores.fused_confidence(F.lit(0.7), F.lit(2), F.lit(2))) == pytest.approx(0.75)
    assert value(scores.floor_score(F.lit(0.2), F.lit(0.95))) == 0.95
    assert value(scores.guard_kind(F.lit(">"), F.lit(False), F.lit("false"), F.lit(False))) == "upper_bound"
    assert value(scores.guard_kind(F.lit("=="), F.lit(False), F.lit("false"), F.lit(True))) == "non_null"
    none = F.lit(None).cast("string")
    kind = lambda op, right=False, branch="true", null=False, unary=None, inside=True: value(scores.guard_kind(none if op is None else F.lit(op), F.lit(right), F.lit(branch), F.lit(null), none if unary is None else F.lit(unary), F.lit(inside)))
    assert [kind("!="), kind("!=", null=True), kind("==", null=True), kind("&&", branch="false"), kind("<", right=True), kind("<", branch="false", right=True)] == ["equality", "non_null", "equality", "equality", "lower_bound", "upper_bound"]
    assert [kind(None), kind(None, branch="false"), kind(None, unary="!"), kind(None, unary="!", branch="false"), kind(None, inside=False)] == ["non_null", "equality", "equality", "non_null", "generic"]
    good = dict.fromkeys([*scores.HARD_CHECKS, *scores.SEMANTIC_CHECKS, "confidence_sufficient"], F.lit(True)) | {"contradicting_guard": F.lit(False)}
    said = lambda version="", **more: value(scores.verdict(good | {k: F.lit(v) for k, v in more.items()}, F.lit(version)))
    assert [said(), said(file_matches=False), said(contradicting_guard=True), said(confidence_sufficient=False), said(cwe_present=False), said("semantic-cwe-v2", cwe_present=False)] == ["validated", "rejected", "rejected", "uncertain", "validated", "rejected"]
    assert value(scores.independence(F.lit(1.5), F.lit(-1.0))) == 1.0 and value(scores.independence_of(F.array(F.lit(0.5), F.lit(0.5), F.lit(2.0)))) == 1.0
    route = scores.anchor_route(["m", "c"], F.create_map(F.lit("x"), F.lit(0.5), F.lit("y"), F.lit(0.9), F.lit("m"), F.lit(1.0)), {"x": 0.5, "y": 0.1})
    assert value(route) == ["m", "c", "y", "x"]
    fused = value(scores.fused_scores(F.create_map(F.lit("a"), F.lit(0.6)), F.create_map(F.lit("b"), F.lit(0.3))))
    assert fused == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}


def test_text(spark):
    code = 'int a; // x\n/* y\n z */ char *s = "// no";\n'
    assert text.without_comments(code) == 'int a;     \n    \n      char *s = "// no";\n'
    assert "x" in text.comments_only(code) and "no" not in text.comments_only(code) and len(text.comments_only(code)) == len(code)
    said = text.sanitized("void CWE190_bad(int good_x) { good_x = 1; }")
    assert "bad" not in said and "good" not in said and len(said) == len("void CWE190_bad(int good_x) { good_x = 1; }")
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("[1]",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(text.json_object(F.col("t"))).collect()] == ['{"a": 1}', None, None, None]
    assert df.select(text.strip_comments(F.col("t"))).count() == 4


def test_numbers_to_six_digits(spark):
    values = [1e-7, 12.3456789, 9.0, 2.5, 1234567.0, 0.0001234567, 999999.7, 999999.4, 0.00009999996, 100000.0, 3.0000001, 1e20, 0.1 + 0.2]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(scores.six_digits(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:g}" for v in values]


def test_pairs(spark):
    rows = [("c", "m", True, False, 0, 0.1), ("c", "i", False, True, 1, 0.2), ("d", "m", False, False, 0, 0.1), ("d", "i", True, False, 0, 0.3)]
    o = spark.createDataFrame(rows, "candidate_id string, assignment string, success boolean, false_positive boolean, unsupported int, cost double")
    best = calibration.best_pair(o).first()
    assert (best.a, best.b, best.covered, best.place) == ("i", "m", 2, 1)


def test_escalation_picks_the_cheapest_feasible(spark):
    rows = [(0.2, 10, 30, 0, 1, 1), (0.5, 10, 30, 1, 1, 1), (0.9, 10, 30, 1, 1, 1)]
    g = spark.createDataFrame(rows, "confidence double, pair_cost long, full_cost long, pair_hits long, full_hits long, truths long")
    r = calibration.escalation_calibration(g, 1.0).first()
    assert (r.confidence, r.escalated, r.cost, r.recall) == (0.2, 1, 50, 1.0)
    assert calibration.escalation_calibration(g, 0.5).first().confidence == -1.0


def test_no_task_orders_all_rows_of_an_expert(spark):
    """Six experts share all rows: none of them is one partition."""
    import re

    plan = catalog.queries()["round_robin"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    orders = re.findall(r"windowspecdefinition\(expert#\d+L?, (\w+)", plan)
    assert orders and set(orders) == {"_bin"}
