"""Grouped fits against single ones, the gate's features and its estimator, saved and loaded."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidark.operators import fitting, models, policies

ROWS = "g string, y boolean, features map<string,double>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for g, slope in (("a", 2.0), ("b", -1.0), ("c", 0.0)):
        for _ in range(150):
            x, z = rng.gauss(0, 1), rng.gauss(3, 20)
            out.append((g, rng.random() < 1 / (1 + math.exp(-slope * x - 0.02 * z)), {"x": x, "z": z} if rng.random() < 0.9 else {"x": x}))
    out += [("all", True, {"x": 1.0})] * 5 + [("none", False, {"x": 1.0})] * 5 + [("flat", i % 3 == 0, {"x": 2.0}) for i in range(9)] + [(None, True, {"x": 1.0}), ("a", None, {"x": 1.0})]
    return spark.createDataFrame(out, ROWS)


def test_equal_to_single_fits(spark, rows):
    found = fitting.fit_groups(rows, ["x", "z"], "g", "y")
    assert found.constant == {"all": 1.0, "none": 0.0} and set(found.fitted) == {"a", "b", "c", "flat"}
    for g in "abc":
        own = rows.where((F.col("g") == g) & F.col("y").isNotNull())
        single = models.fit_binary(own, ["x", "z"], "y")
        both = found.predict(single.predict(own), F.col("g")).select("p", F.col("scores")["yes"].alias("q")).collect()
        assert max(abs(r.p - r.q) for r in both) < 1e-6
    assert found.predict(rows.where("g = 'flat'"), F.col("g")).first().p == pytest.approx(0.5)
    assert {(r.g, r.p) for r in found.predict(rows.where("g = 'all' OR g IS NULL"), F.col("g")).collect()} == {(None, None), ("all", 1.0)}


def test_saved_and_loaded(spark, rows, tmp_path):
    found = fitting.fit_groups(rows, ["x", "z"], "g", "y")
    found.save(str(tmp_path / "m"))
    assert fitting.GroupedModels.load(str(tmp_path / "m")) == found
    spark.createDataFrame([('{"version": "other"}',)], "value string").write.mode("overwrite").text(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        fitting.GroupedModels.load(str(tmp_path / "m"))


def test_rare_families(spark):
    rng = random.Random(3)
    data = []
    for _ in range(120):
        x = rng.random()
        data.append((["memory_bounds"] + ["taint_api"] * (x > 0.6) + ["concurrency"] * (x < 0.2), {"x": x}))
    s = spark.createDataFrame(data, "labels array<string>, features map<string,double>")
    model = fitting.fit_rare(s, ["x"], ["memory_bounds"])
    got = fitting.rare_scores(model, s).collect()
    assert sorted(model.fitted) == ["concurrency", "taint_api"]
    assert all((r.rare["taint_api"] > 0.5) == ("taint_api" in r.labels) for r in got if abs(r.features["x"] - 0.6) > 0.1)
    with pytest.raises(ValueError):
        fitting.fit_rare(s.select(F.array(F.lit("memory_bounds")).alias("labels"), "features"), ["x"], ["memory_bounds"])


def test_gate_features(spark):
    df = spark.createDataFrame([({"n": 2.0, "suspicion_score": 9.0}, 0.4, {"a": 0.9, "b": 0.5, "c": 2.0}, ["c", "a", "b"])], "f map<string,double>, s double, p map<string,double>, r array<string>")
    got = df.select(fitting.gate_features(F.col("f"), F.col("s"), F.col("p"), F.col("r"), ["a", "b", "c", "d"]).alias("g")).first().g
    want = {"candidate::n": 2.0, "candidate::suspicion_score": 0.4, "gate::p1": 1.0, "gate::p2": 0.9, "gate::margin": 0.1, "gate::independence_confidence": 1.0, "gate::mean_binary_entropy": (1.0 + 0.4689955935892812) / 4}
    want |= {"probability::a": 0.9, "probability::b": 0.5, "probability::c": 1.0, "probability::d": 0.0, "top1::c": 1.0, "top2::a": 1.0}
    assert {k: v for k, v in got.items() if v} == {k: pytest.approx(v) for k, v in want.items() if v} and len(got) == 19


KIND = "candidate_id string, assignment string, success boolean, false_positive boolean, unsupported int, cost double, probability double, matched_truth_ids array<string>, ground_truth_ids array<string>, prompt_tokens int, completion_tokens int, latency_seconds double, validated_true int, validated_false int"


def test_gate_learns_coverage_of_all_truths(spark, tmp_path):
    """Candidates with a second truth, which the third expert alone matches, are the ones to escalate."""
    data = []
    for i in range(40):
        hard = i % 4 == 0
        truths = ["t1", "t2"] if hard else ["t1"]
        for e, p, m in (("e1", 0.9, ["t1"]), ("e2", 0.8 if not hard else 0.5, []), ("e3", 0.3, ["t2"] if hard else [])):
            data.append((f"c{i}", e, bool(m), False, 0, 0.01, p, m, truths, 1, 1, 0.1, 0, 0))
    o = policies.ranked(spark.createDataFrame(data, KIND))
    by = o.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("assignment", "probability"))).alias("p"), F.transform(F.array_sort(F.collect_list(F.struct("place", "assignment"))), lambda x: x["assignment"]).alias("r"))
    rows = by.withColumn("gate", fitting.gate_features(F.create_map().cast("map<string,double>"), F.lit(0.0), F.col("p"), F.col("r"), ["e1", "e2", "e3"])).join(fitting.best_two_suffice(o, ["candidate_id"]), "candidate_id")
    assert rows.where("NOT sufficient").count() == 10
    model = fitting.EscalationGate().fit(rows)
    got = model.transform(rows)
    assert all((r.confidence >= 0.5) == r.sufficient for r in got.collect())
    model.save(str(tmp_path / "gate"))
    again = fitting.EscalationGateModel.load(str(tmp_path / "gate")).transform(rows)
    assert {r.candidate_id: r.confidence for r in again.collect()} == {r.candidate_id: r.confidence for r in got.collect()}
    choice = policies.baselines(o, [], 0.0, got.select("candidate_id", (F.col("confidence") < 0.5).alias("escalate")), anchor_rare=o.where("assignment = 'e2'"))
    out = {r.policy: r for r in policies.evaluate(o, choice).collect()}
    r = out["adaptive_gate"]
    assert (r.escalation_recall, r.missed_escalation_rate, r.unnecessary_escalation_rate, r.full5_rate, r.truth_recall) == (1.0, 0.0, 0.0, 0.25, 1.0)
    assert (out["anchor_rare"].average_assignments, out["anchor_rare"].truth_recall, out["utility_top2"].exact_coverage) == (1.0, 0.0, 0.75)
    assert r.average_realized_reward == pytest.approx(1 - 0.01 * (0.75 * 2 + 0.25 * 3)) and policies.evaluate(o, choice, full=2).where("policy = 'utility_top2'").first().full5_rate == 1.0
    with pytest.raises(ValueError):
        fitting.EscalationGate().fit(rows.where("false"))
