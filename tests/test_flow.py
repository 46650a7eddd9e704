"""Detection order, retrieval, packets, answers, fusion and verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from evidark.operators import findings
from evidark.plans.flow import FlowConfig, conclude, detect

CODE = "void f(char *p) { free(p); free(p); }\nvoid g(char *d, char *s, int n) { memcpy(d, s, n); }\nint quiet(int x) { return x; }\nvoid h(char *a) { int i = a[0]; }"


@pytest.fixture(scope="module")
def routed(spark):
    files = spark.createDataFrame([("c", "a.c", CODE)], "case_id string, file string, source string")
    decisions, routed = detect(files, FlowConfig(gate=0.3, most_candidates=1))
    return decisions.collect(), routed


def test_gate_and_cap_come_before_routing(routed):
    decisions, best = routed
    assert len(decisions) == 3 and sum(d.accepted for d in decisions) == 2
    [r] = best.collect()
    assert r.function == "f" and r.experts == ["memory_bounds", "control_state"]


def test_answers_to_verdicts(spark, routed):
    [r] = routed[1].collect()
    ids = [e.fact_id for e in r.evidence if e.kind == "double_release"]
    one = {"title": "t", "line_start": 1, "line_end": 1, "cwes": ["cwe 0415", "x"], "evidence_ids": ids, "sink": "free(p)", "trigger_path": ["p"], "confidence": 0.7}
    rows = [(r.candidate_id, "memory_bounds", "m1", json.dumps({"findings": [one]})), (r.candidate_id, "control_state", "m2", json.dumps({"findings": [one | {"confidence": 7, "evidence_ids": ids + ["no"]}, one | {"line_start": 90, "line_end": 80, "trigger_path": [], "evidence_ids": ["other"]}]})), (r.candidate_id, "x", "m", "not json")]
    out = conclude(spark.createDataFrame(rows, "candidate_id string, expert string, model_id string, content string"), routed[1]).collect()
    [a] = out  # the third is elsewhere, but on the same sink
    assert (a.merged, a.experts, a.models, a.confidence, a.cwes, a.verdict) == (3, ["control_state", "memory_bounds"], ["m1", "m2"], 1.0, ["CWE-415"], "rejected")
    assert (a.line_start, a.line_end, a.checks["evidence_ids_valid"], a.checks["file_matches"], len(a.checks)) == (1, 90, False, True, 9)
    fine = conclude(spark.createDataFrame(rows[:1], "candidate_id string, expert string, model_id string, content string"), routed[1])
    assert [x.verdict for x in findings.validated(fine).collect()] == ["validated"]


GUARDED = "void w(char *d, char *s, int n) {\n  if (n < 16) {\n    memcpy(d, s, n);\n  }\n  free(d);\n}\nvoid f(char *p) { free(p); free(p); }"
ANSWERS = "candidate_id string, expert string, model_id string, content string"


@pytest.fixture(scope="module")
def guarded(spark):
    files = spark.createDataFrame([("c", "a.c", GUARDED)], "case_id string, file string, source string")
    return detect(files, FlowConfig(gate=0.0))[1]


def concluded(spark, routed, function, kind, **changes):
    """Verdict and checks of one finding on the flow's own candidate, from detection on."""
    [r] = routed.where(f"function = '{function}'").collect()
    [e] = [e for e in r.evidence if e.kind == kind][:1]
    one = {"line_start": e.line, "line_end": max(e.line, e.sink_line), "evidence_ids": [e.fact_id], "confidence": 0.9} | changes
    [out] = conclude(spark.createDataFrame([(r.candidate_id, "memory_bounds", "m", json.dumps({"findings": [one]}))], ANSWERS), routed).collect()
    return out.verdict, out.checks


def test_the_flow_rejects_a_missing_or_foreign_weakness(spark, guarded):
    assert guarded.first().feature_schema_version == "semantic-cwe-v2"
    assert concluded(spark, guarded, "f", "double_release", cwes=["CWE-415"])[0] == "validated"
    verdict, checks = concluded(spark, guarded, "f", "double_release", cwes=[])
    assert (verdict, checks["cwe_present"]) == ("rejected", False)
    verdict, checks = concluded(spark, guarded, "f", "double_release", cwes=["CWE-78"])
    assert (verdict, checks["cwe_semantics_supported"]) == ("rejected", False)


def test_the_flow_sees_a_contradicting_guard(spark, guarded):
    verdict, checks = concluded(spark, guarded, "w", "memory_copy", cwes=["CWE-120"])
    assert verdict == "rejected" and checks["contradicting_guard"]
    assert not concluded(spark, guarded, "w", "memory_copy", cwes=["CWE-120"], line_start=5, line_end=5)[1]["contradicting_guard"]


def test_fusion_loses_no_finding_whatever_the_order(spark):
    """20,000 answers without a number, joined by sorted shuffles of many small parts, in several orders."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for k, v in zip(kept, ("-1", "16", "64k")):
        spark.conf.set(k, v)
    try:
        one = lambda i: json.dumps({"findings": [{"title": f"t{i}", "line_start": 10 * (i // 2 % 50) + 1, "line_end": 10 * (i // 2 % 50) + 1 + i % 2, "cwes": ["CWE-787"], "evidence_ids": [f"e{i // 2}"], "confidence": 0.5}]})
        answers = spark.createDataFrame([(f"c{i // 100}", "memory_bounds", f"m{i % 2}", one(i)) for i in range(20_000)], ANSWERS)
        places = spark.createDataFrame([(f"c{k}", "a.c", f"f{k}") for k in range(200)], "candidate_id string, file string, function string")
        told = set()
        for seed in range(3):
            rows = findings.findings_from_answers(answers.orderBy(F.rand(seed)).repartition(7 + seed)).join(places, "candidate_id")
            out = findings.fuse(rows).orderBy("finding_id").collect()
            assert len(out) == 10_000 and sum(r.merged for r in out) == 20_000 and len({r.finding_id for r in out}) == 10_000
            told.add(hash(tuple(map(repr, out))))
        assert len(told) == 1
        [twice] = findings.fuse(findings.findings_from_answers(answers.limit(1).union(answers.limit(1))).join(places, "candidate_id")).collect()
        assert twice.merged == 2  # a repeated answer is counted, and no row of its own
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


ONE = dict(candidate_id="c", file="a.c", function="f", expert="memory_bounds", model_id="m", title="t", root_cause="r", consequence="q", source="", sink="", missing_guard="", trigger_path=[], cwes=["CWE-787"], evidence_ids=[], confidence=0.6)
KIND = "finding_no long, candidate_id string, file string, function string, expert string, model_id string, title string, root_cause string, consequence string, source string, sink string, missing_guard string, trigger_path array<string>, cwes array<string>, evidence_ids array<string>, line_start int, line_end int, confidence double"


def rows_of(spark, *changes):
    return spark.createDataFrame([{**ONE, "finding_no": i, **c} for i, c in enumerate(changes)], KIND)


def test_each_cause_fuses(spark):
    lines = lambda a, b, **more: dict(line_start=a, line_end=b, **more)
    apart = [(lines(1, 2), lines(9, 9)), (lines(1, 2, sink=""), lines(9, 9, sink="")), (lines(1, 2, evidence_ids=["x"]), lines(9, 9, evidence_ids=["y"])), (lines(1, 2), lines(3, 4, function="g"))]
    together = [(lines(1, 5), lines(7, 9)), (lines(1, 2, sink="memcpy (d)"), lines(9, 9, sink="MEMCPY(d)")), (lines(1, 2, evidence_ids=["x"]), lines(9, 9, evidence_ids=["z", "x"])), (lines(1, 2, trigger_path=["p"]), lines(9, 9, trigger_path=["q", "p"]))]
    assert [findings.fuse(rows_of(spark, *p)).count() for p in apart] == [2] * 4
    assert [findings.fuse(rows_of(spark, *p)).count() for p in together] == [1] * 4
    chain = rows_of(spark, lines(1, 2, sink="s", expert="taint_api", model_id="n", cwes=["CWE-20"], trigger_path=["b", "a"]), lines(50, 51, sink="s", evidence_ids=["e"], confidence=0.9, title="best"), lines(90, 91, evidence_ids=["e"], cwes=["CWE-119"], trigger_path=["a", "c"]))
    [r] = findings.fuse(chain).collect()
    assert (r.merged, r.title, r.cwes, r.evidence_ids, r.trigger_path, r.experts, r.models, r.line_start, r.line_end) == (3, "best", ["CWE-119", "CWE-20", "CWE-787"], ["e"], ["b", "a", "c"], ["memory_bounds", "taint_api"], ["m", "n"], 1, 91)
    assert r.confidence == pytest.approx(0.95)


CANDIDATE = "candidate_id string, file string, function string, line_start int, line_end int, evidence array<struct<evidence_id:string,kind:string,facts:map<string,string>>>, features map<string,double>, feature_schema_version string"


def test_nine_checks(spark):
    guard = ("g", "guard_protects_sink", {"semantically_protective": "True", "sink_line": "12"})
    rows = [("c", "a.c", "f", 10, 20, [("e", "memory_copy_without_guard", {}), ("u", "use_after_release", {})], {}, "semantic-cwe-v2"), ("d", "a.c", "f", 10, 20, [("e", "memory_copy", {}), ("u", "double_release", {}), guard], {}, "semantic-cwe-v2"), ("old", "a.c", "f", 10, 20, [("e", "memory_sink", {})], {"bounds_guard_count": 1.0, "guard_density": 1.0}, "v1")]
    c = spark.createDataFrame(rows, CANDIDATE)
    one = dict(line_start=12, line_end=13, evidence_ids=["e"])
    cases = [({}, "validated"), ({"file": "b.c"}, "rejected"), ({"function": "g"}, "rejected"), ({"line_start": 21, "line_end": 22}, "rejected"), ({"line_start": 1, "line_end": 10}, "validated"), ({"evidence_ids": []}, "rejected"), ({"evidence_ids": ["e", "no"]}, "rejected"), ({"cwes": []}, "rejected"), ({"cwes": ["CWE-78"]}, "rejected"), ({"confidence": 0.5}, "uncertain"), ({"candidate_id": "none"}, "rejected"),
             ({"candidate_id": "d"}, "rejected"), ({"candidate_id": "d", "line_start": 14, "line_end": 15}, "validated"), ({"candidate_id": "d", "evidence_ids": ["u"], "cwes": ["CWE-415"]}, "validated"), ({"candidate_id": "d", "expert": "taint_api"}, "validated"), ({"candidate_id": "old"}, "rejected"), ({"candidate_id": "old", "cwes": [], "expert": "control_state"}, "validated")]
    got = findings.validate(rows_of(spark, *[{**one, **x} for x, _ in cases]), c).orderBy("finding_no").collect()
    assert [r.verdict for r in got] == [v for _, v in cases]
    assert all(len(r.checks) == 9 for r in got) and got[11].checks["contradicting_guard"]


def test_outcomes_match_by_place_evidence_and_meaning(spark):
    c = spark.createDataFrame([("c", "a.c", "f", 1, 99, [("e", "memory_copy", {}), ("i", "arithmetic_to_memory_sink", {}), ("t", "source_to_sink", {}), ("n", "unchecked_nullable_dereference", {})], {}, "v")], CANDIDATE)
    truths = spark.createDataFrame([("t", "k", "a.c", 10, 12, ["CWE-787"], ["memory_bounds"]), ("u", "k", "a.c", 30, 32, [], ["control_state"])], "truth_id string, case_id string, file string, line_start int, line_end int, cwes array<string>, experts array<string>")
    at, far = dict(line_start=11, line_end=40, evidence_ids=["e"]), dict(line_start=70, line_end=71, evidence_ids=["e"])
    cases = [(at, {"t"}), (far, None), ({**at, "evidence_ids": []}, set()), ({**at, "cwes": ["CWE-190"]}, set()), ({**at, "cwes": ["CWE-190"], "evidence_ids": ["i"]}, {"t"}), ({**at, "cwes": ["CWE-78"], "evidence_ids": ["t"]}, set()), ({**at, "cwes": ["CWE-78"], "evidence_ids": ["t"], "source": "s", "sink": "k"}, {"t", "u"}),
             ({**at, "cwes": [], "root_cause": "Unchecked return value"}, {"u"}), ({**at, "cwes": [], "evidence_ids": ["n"]}, {"u"}), ({**at, "cwes": []}, {"t"})]
    f = rows_of(spark, *[x for x, _ in cases]).selectExpr("*", "finding_no AS finding_id", "'k' AS case_id")
    got = findings.match_outcomes(f, truths, c).collect()
    for i, (_, want) in enumerate(cases):
        rows = [r for r in got if r.finding_id == i]
        assert (not rows) if want is None else ({r.truth_id for r in rows if r.matched} == want and len(rows) == 2)
    assert {r.reason for r in got} >= {"matched", "failed: evidence", "failed: semantics"}


def test_retrieval_and_packets(spark):
    q = spark.createDataFrame([(1, "taint_api", "call to system here")], "query_id int, family string, text string")
    e = spark.createDataFrame([("k1", "System calls", "never call", ["x"], ["Here"]), ("k2", "other", "nothing", ["taint_api"], None), ("k3", "a", "b", ["y"], [])], "knowledge_id string, title string, content string, families array<string>, tags array<string>")
    assert [(r.knowledge_id, r.score) for r in findings.retrieve(q, e).orderBy("rank").collect()] == [("k2", 4), ("k1", 3)]
    t = spark.createDataFrame([("c", i, 10) for i in range(5)], "case_id string, ordinal int, n_characters int")
    got = findings.packets(t, most_tasks=2, most_characters=1000).orderBy("ordinal").collect()
    assert [(r.task_id, r.packet) for r in got] == [("T00001", 0), ("T00002", 0), ("T00003", 1), ("T00004", 1), ("T00005", 2)]


def test_shown_evidence_and_repairs(spark, routed):
    [r] = routed[1].collect()
    a = spark.createDataFrame([(r.candidate_id, "memory_bounds"), (r.candidate_id, "taint_api")], "candidate_id string, expert string")
    got = {x.expert: x.evidence for x in findings.shown_evidence(routed[1], a).collect()}
    assert {e.kind for e in got["memory_bounds"]} == {"release", "double_release"} and len(got["taint_api"]) == len(r.evidence)
    tries = spark.createDataFrame([("f", 1, True, False), ("f", 2, True, True), ("g", 1, False, False)], "finding_id string, attempt int, applied boolean, verified boolean")
    assert findings.repair_summary(tries).first().asDict() == {"findings": 2, "repaired": 1, "applied": 1, "mean_first": 2.0, "repair_rate": 0.5}


def test_config_is_checked():
    with pytest.raises(ValueError):
        FlowConfig(gate=2)
