"""Replay of outcomes, assertions, the light analyser, the command line."""

import random

import pytest
from pyspark.sql import functions as F

from evidark.__main__ import main
from evidark.functions import lightweight
from evidark.operators import assertions, replay


SPAN = "case_id string, candidate_id string, file string, line_start int, line_end int, score double"
TRUTH = "case_id string, truth_id string, file string, line_start int, line_end int"
OUTCOME = "case_id string, candidate_id string, assignment string, success boolean, false_positive boolean, validated_true int, validated_false int, matched_truth_ids array<string>, ground_truth_ids array<string>, prompt_tokens int, completion_tokens int, cost double"
EXPERTS = ["memory_bounds", "integer_overflow", "taint_api", "control_state", "concurrency"]


def replayed(spark, cases, truths, candidates, outcomes, routes, gate=0.5, **more):
    frames = [spark.createDataFrame(x, kind) for x, kind in ((cases, "case_id string, error boolean"), (truths, TRUTH), (candidates, SPAN), (outcomes, OUTCOME), (routes, "case_id string, candidate_id string, assignment string"))]
    return replay.end_to_end(*frames, gate, **more)


def test_end_to_end_golden(spark):
    matrix = [("c1", "kept", e, e == "memory_bounds", False, 0, 0, ["t1"] if e == "memory_bounds" else [], ["t1"], 10, 2, 0.01) for e in EXPERTS]
    args = [("c1", False)], [("c1", "t1", "a.c", 4, 4), ("c1", "t2", "a.c", 20, 20)], [("c1", "kept", "a.c", 4, 4, 0.9), ("c1", "gated", "a.c", 20, 20, 0.1)], matrix, [("c1", "kept", "memory_bounds"), ("c1", "kept", "taint_api"), ("c1", "gated", "memory_bounds")]
    r = replayed(spark, *args).first()
    assert r.asDict() == {**r.asDict(), "case_count": 1, "analyzer_candidate_recall": 1.0, "candidate_gate_gt_retention": 0.5, "outcome_matrix_gt_coverage": 0.5, "full5_oracle_detection_recall": 0.5, "routed_detection_recall": 0.5, "logical_expert_tasks": 2, "research_physical_requests": 2, "web_batched_requests": 1, "exact_case_coverage": 0.0, "prompt_tokens": 20, "completion_tokens": 4, "average_assignments_per_routed_candidate": 2.0, "validated_outcome_precision": 1.0, "end_to_end_f1": pytest.approx(2 / 3), "realized_cost": pytest.approx(0.02)}
    assert len(r) == 28 and tuple(r.asDict()) == replay.MEASURES
    assert replayed(spark, *args, gate_enabled=False).first().gated_candidate_count == 2
    with pytest.raises(assertions.DataError):
        replayed(spark, *args[:4], [("c1", "kept", "none")])
    with pytest.raises(assertions.DataError):
        replayed(spark, *args[:3], [(None, *matrix[0][1:])], [])


def plain_replay(cases, truths, candidates, outcomes, routes, gate, most):
    """The stages one case after another."""
    out = dict.fromkeys(replay.MEASURES, 0)
    hits, exact, true, false = dict.fromkeys(replay.STAGES, 0), 0, 0, 0
    for case, error in cases:
        own = {t[1]: t for t in truths if t[0] == case}
        out["case_count"] += 1
        hits["truth"] += len(own)
        if error:
            out["analysis_error_count"] += 1
            continue
        before = [c for c in candidates if c[0] == case]
        after = sorted((c for c in before if c[5] >= gate), key=lambda c: (-c[5], c[2], c[3], c[1]))[:most]
        near = lambda cs: {k for k, t in own.items() if any(c[2] == t[2] and c[3] <= t[4] and c[4] >= t[3] for c in cs)}
        found = {s: set() for s in replay.STAGES} | {"analyzer": near(before), "gated": near(after)}
        web = False
        for c in after:
            rows = [o for o in outcomes if o[:2] == (case, c[1])]
            out["outcome_matrix_candidate_count"] += bool(rows)
            found["matrix"] |= {t for o in rows for t in o[8]}
            found["oracle"] |= {t for o in rows for t in o[7]}
            for o in [o for o in rows if (case, c[1], o[2]) in routes]:
                web = True
                found["routed"] |= set(o[7])
                counted = o[5] or o[6]
                true, false = true + (o[5] if counted else o[3]), false + (o[6] if counted else o[4])
                for name, x in (("logical_expert_tasks", 1), ("prompt_tokens", o[9]), ("completion_tokens", o[10]), ("realized_cost", o[11])):
                    out[name] += x
        out["analyzer_candidate_count"] += len(before)
        out["gated_candidate_count"] += len(after)
        out["web_batched_requests"] += web
        for s in replay.STAGES[1:]:
            hits[s] += len(found[s] & set(own))
        exact += set(own) <= found["routed"]
    div = lambda a, b, empty=1.0: a / b if b else empty
    n, p, r = hits["truth"], div(true, true + false), div(hits["routed"], hits["truth"])
    return out | {
        "ground_truth_count": n, "analyzer_truth_hits": hits["analyzer"], "gated_truth_hits": hits["gated"], "outcome_matrix_truth_hits": hits["matrix"], "full5_oracle_truth_hits": hits["oracle"], "routed_truth_hits": hits["routed"],
        "analyzer_candidate_recall": div(hits["analyzer"], n), "candidate_gate_gt_retention": div(hits["gated"], hits["analyzer"]), "post_gate_candidate_recall": div(hits["gated"], n), "outcome_matrix_gt_coverage": div(hits["matrix"], n), "full5_oracle_detection_recall": div(hits["oracle"], n),
        "routed_detection_recall": r, "routing_retention_vs_full5": div(hits["routed"], hits["oracle"]), "validated_outcome_precision": p, "end_to_end_f1": div(2 * p * r, p + r, 0.0), "exact_case_coverage": div(exact, len(cases)),
        "average_assignments_per_routed_candidate": div(out["logical_expert_tasks"], out["outcome_matrix_candidate_count"], 0.0), "research_physical_requests": out["logical_expert_tasks"],
    }


@pytest.mark.parametrize("seed, most", [(1, 2), (2, None), (3, 1)])
def test_end_to_end_against_plain_python(spark, seed, most):
    rng = random.Random(seed)
    cases = [(f"c{i}", rng.random() < 0.2) for i in range(12)]
    span = lambda: (rng.choice("ab"), a := rng.randint(1, 40), a + rng.randint(0, 5))
    truths = [(c, f"t{i}", *span()) for c, _ in cases[1:] for i in range(rng.randint(0, 4))]
    candidates = [(c, f"k{i}", *span(), rng.randint(0, 4) / 4) for c, _ in cases for i in range(rng.randint(0, 6))]
    names = lambda: [f"t{rng.randint(0, 5)}" for _ in range(rng.randint(0, 2))]
    outcomes = [(c[0], c[1], e, rng.random() < 0.5, rng.random() < 0.3, rng.choice([0, 0, 2]), rng.choice([0, 1]), names(), names(), rng.randint(0, 9), 1, rng.randint(0, 9) / 100) for c in candidates if rng.random() < 0.7 for e in EXPERTS]
    routes = [o[:3] for o in outcomes if rng.random() < 0.4] + [(c[0], c[1], "x") for c in candidates if not any(o[:2] == c[:2] for o in outcomes)]
    got = replayed(spark, cases, truths, candidates, outcomes, routes, 0.5, most_per_case=most).first().asDict()
    want = plain_replay(cases, truths, candidates, outcomes, set(routes), 0.5, most)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_end_to_end_of_nothing(spark):
    r = replayed(spark, [], [], [], [], []).first()
    assert (r.case_count, r.ground_truth_count, r.routed_detection_recall, r.exact_case_coverage, r.realized_cost, r.average_assignments_per_routed_candidate) == (0, 0, 1.0, 1.0, 0.0, 0.0)


def test_support_and_points(spark):
    s = spark.createDataFrame([("a", ["a"], False), ("b", ["a"], True), ("z", ["z", "a"], True)], "label string, selected array<string>, fallback boolean")
    r = replay.family_support(s, ["a", "b"]).first()
    assert (r.supported, r.unsupported, r.supported_coverage, r.unsupported_coverage, r.fallbacks) == (2, 1, 0.5, 1.0, 2)
    assert replay.all_experts_baseline(s).first().mean_experts == 6.0
    p = spark.createDataFrame([("x", 1.0, 0.5), ("y", 3.0, 0.5)], "policy string, cost double, coverage double")
    assert [(r.policy, round(r.x, 6), r.y) for r in replay.tradeoff_points(p).orderBy("policy").collect()] == [("x", 0.08, 0.5), ("y", 0.92, 0.5)]


def test_assertions(spark):
    a = spark.createDataFrame([("p", "1", "train")], "project_id string, case_id string, split string")
    b = spark.createDataFrame([("q", "2", "test")], "project_id string, case_id string, split string")
    assertions.disjoint(a, b, "project_id")
    assertions.unseen(b, a, a)
    assert assertions.merged({"x": a, "y": b}).count() == 2
    for bad in (lambda: assertions.disjoint(a, a, "project_id"), lambda: assertions.unique(a.union(a), "case_id"), lambda: assertions.merged({"x": a, "y": b.selectExpr("'p' AS project_id", "case_id", "split")})):
        with pytest.raises(assertions.DataError):
            bad()
    m = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "x")], "c string, m string")
    with pytest.raises(assertions.DataError):
        assertions.complete_matrix(m, ["c"], "m", ["x", "y"])
    assert assertions.complete_matrix(m.where("c = 'c'"), ["c"], "m", ["y", "x"]).count() == 2


def test_light_analyser(spark):
    code = "int calm(int a) {\n return a; }\nvoid f(char *p) {\n free(p);\n p[0] = 1;\n}\n"
    df = spark.createDataFrame([("c", "a.c", code), ("d", "b.c", None)], "case_id string, file string, source string")
    got = lightweight.analyse(df).collect()
    assert [(r.name, r.line_start, r.line_end) for r in got] == [("f", 3, 6)]  # calm has no signal
    assert (got[0].free_count, got[0].array_access_count, got[0].released_then_accessed, got[0].function_length, got[0].score) == (1.0, 1.0, 1.0, 4.0, 4.0)
    pair = "int g(char *n) {\n if (access(n, 0)) return 0;\n if (size < 3) lock_guard x; return fopen(n); }\n"
    [r] = lightweight.analyse(spark.createDataFrame([("e", "c.c", pair)], "case_id string, file string, source string")).collect()
    assert (r.toctou_pair, r.toctou_signal_count, r.bounds_guard_count, r.lock_signal_count, r.dangerous_sink_count, r.score) == (1.0, 1.0, 1.0, 1.0, 1.0, 4.0)
    told = spark.createDataFrame([("free(a); b = a->x;", True), ("free(a); a = 0;", False), ("free( q );\n free (q)", True), ("a->x; free(a);", False), ("free(ab); b[0]", False), ("free(a); free(b); b.c", True)], "t string, w boolean")
    assert all(r.v == r.w for r in told.select(lightweight.released_then_accessed(F.col("t")).alias("v"), "w").collect())


def test_light_evidence(spark):
    """Every match with its place, against finding them one by one; and a verdict that rests on them."""
    import re

    from evidark.operators import findings

    code = "int calm(int a) {\n return a; }\nvoid f(char *p, int size) {\n  if (size < 3 ||\n      size > 9) free(p); free(p);\n\tp[0] = access(p, 1); x\n  = fopen(p);\n}\n"
    [r] = lightweight.analyse(spark.createDataFrame([("c", "a.c", code)], "case_id string, file string, source string")).collect()
    want = []
    for signal, (kind, pattern) in lightweight.PATTERNS.items():
        for i, m in enumerate(re.finditer(pattern, r.code)):
            line = r.code[: m.start()].count("\n")
            want.append((f"EV-{r.candidate_id[2:]}-{len(want) + 1}", kind, "a.c", r.line_start + line, r.code.split("\n")[line].strip(), {"signal": signal, "match_index": str(i)}))
    assert [tuple(e) for e in r.evidence] == want and len(want) > 5
    assert sum(e.kind == "toctou" for e in r.evidence) == 1
    c = lightweight.analyse(spark.createDataFrame([("c", "a.c", code)], "case_id string, file string, source string")).withColumn("feature_schema_version", F.lit("light-v1"))
    release = [e.evidence_id for e in r.evidence if e.kind == "release"]
    rows = [(r.candidate_id, "a.c", "f", "memory_bounds", 5, 5, ["CWE-415"], ids, 0.9) for ids in (release, ["EV-none-1"])]
    f = spark.createDataFrame(rows, "candidate_id string, file string, function string, expert string, line_start int, line_end int, cwes array<string>, evidence_ids array<string>, confidence double")
    assert sorted(x.verdict for x in findings.validate(f, c).collect()) == ["rejected", "validated"]


def test_command_line(capsys):
    assert main(["list"]) == 0 and "span_overlap_join" in capsys.readouterr().out
    assert main(["sql", "softmax_router"]) == 0 and capsys.readouterr().out == "none\n"
