"""Commands over files, run in the test session."""

import json

import pytest

from evidark import __main__ as cli


def run(spark, *args):
    cli.run(spark, cli.parser().parse_args([str(a) for a in args]))


def case(n, family):
    truth = {"truth_id": f"t{n}", "file": "a.c", "function": "f", "line_start": 3, "line_end": 4, "experts": [family], "cwes": ["CWE-787"]}
    return {"case_id": f"c{n}", "project_id": f"p{n}", "source_files": {"a.c": "int f;"}, "ground_truth": [truth]}


def test_split_evaluate_and_calibrate(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text("".join(json.dumps(case(n, "ab"[n % 2])) + "\n" for n in range(20)))
    for more in ([], ["--family"]):
        run(spark, "split", tmp_path / "cases.jsonl", tmp_path / f"out{len(more)}", *more)
        got = {r.case_id: r.split for r in spark.read.json(f"{tmp_path}/out{len(more)}").collect()}
        assert len(got) == 20 and set(got.values()) == {"train", "dev", "test"}
    found = [(f"C{n}", f"c{n}", "a.c", 1, 5 if n < 15 else 2, n / 20) for n in range(20)]
    spark.createDataFrame(found, "candidate_id string, case_id string, file string, line_start int, line_end int, suspicion_score double").write.parquet(f"{tmp_path}/found")
    run(spark, "evaluate", tmp_path / "cases.jsonl", tmp_path / "found", tmp_path / "e.json")
    e = json.loads((tmp_path / "e.json").read_text())
    assert (e["truths"], e["truths_hit"], e["recall"]) == (20, 15, 0.75)
    run(spark, "calibrate", tmp_path / "cases.jsonl", tmp_path / "found", tmp_path / "g.json", "--target", "0.8")
    g = json.loads((tmp_path / "g.json").read_text())
    assert (g["threshold"], g["kept"], g["retention"]) == (0.15, 17, 0.8)


def test_policies_live_and_repairs(spark, tmp_path):
    rows = [(f"k{n}", a, n % 2 == 0 and a == "x", a == "y", 0, 0.5, 0.9 if a == "x" else 0.2, ["t"] if n % 2 == 0 and a == "x" else [], ["t"], 10, 5, 1.0, 0, 0) for n in range(4) for a in ("x", "y", "z")]
    spark.createDataFrame(rows, "candidate_id string, assignment string, success boolean, false_positive boolean, unsupported int, cost double, probability double, matched_truth_ids array<string>, ground_truth_ids array<string>, prompt_tokens long, completion_tokens long, latency_seconds double, validated_true int, validated_false int").write.parquet(f"{tmp_path}/o")
    run(spark, "policies", tmp_path / "o", tmp_path / "p", "--fixed", "x", "--single", "z", "--threshold", "0.5")
    got = {r.policy: r for r in spark.read.json(f"{tmp_path}/p").collect()}
    assert set(got) == {"full5", "utility_top2", "fixed_top2", "formula_escalation", "best_single"} and len(got["full5"]) == 1 + 28
    top, one, full = got["utility_top2"], got["best_single"], got["full5"]
    assert (top.candidate_count, top.success_coverage, top.oracle_coverage, top.average_assignments, top.truth_recall, top.exact_coverage) == (4, 0.5, 0.5, 2.0, 0.5, 0.5)
    # the penalties of both chosen outcomes count: 0.5 successes less 0.5 for the false positive less a cost of 1
    assert top.average_realized_reward == pytest.approx(-1.0) and top.average_oracle_reward == pytest.approx(0.0) and top.average_regret == pytest.approx(1.0)
    assert (one.success_coverage, one.truth_recall, full.full5_rate, full.escalation_recall, top.missed_escalation_rate) == (0.0, 0.0, 1.0, 1.0, 1.0)
    assert full.outcome_precision == pytest.approx(2 / 6) and full.web_batched_requests == 4 and full.logical_expert_tasks == 12
    (tmp_path / "l.jsonl").write_text(json.dumps({"case_id": "c", "ground_truth_ids": ["t"], "matched_truth_ids": ["t"], "validations": [{"finding_id": "f", "verdict": "validated"}], "matched_by_finding": {"f": ["t"]}, "usage": [{"cost": 0.25, "prompt_tokens": 3, "completion_tokens": 1}]}) + "\n")
    run(spark, "live", tmp_path / "l.jsonl", tmp_path / "l.json")
    assert json.loads((tmp_path / "l.json").read_text())["f1"] == 1.0
    (tmp_path / "r.jsonl").write_text(json.dumps({"finding_id": "f", "attempt": 1, "applied": True, "verified": False}) + "\n")
    run(spark, "repairs", tmp_path / "r.jsonl", tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["repaired"] == 0


def test_missing_choices_raise(spark):
    from evidark.operators import policies
    from evidark.operators.assertions import DataError

    o = spark.createDataFrame([("k", "x")], "candidate_id string, assignment string")
    with pytest.raises(DataError, match="y"):
        policies.require_complete(o, spark.createDataFrame([("p", "k", "y")], "policy string, candidate_id string, assignment string"))


def test_arguments():
    for bad in (["policies", "a", "b"], ["detect", "a", "b", "--gate", "2"], ["nothing"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
