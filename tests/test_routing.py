"""Routes by hand: rules on features, fused and forced scores, bounds of the policy, odd rows."""

import pytest

from evidark.operators.routing import Policy, routes

SCHEMA = "candidate_id long, learned map<string,double>, features map<string,double>, feature_schema_version string"


def routed(spark, rows, **more):
    return {r["candidate_id"]: r for r in routes(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_rules_fire_for_unlearned_families_by_their_schema(spark):
    known = {"memory_bounds": 1.0}
    got = routed(spark, [
        (1, known, {"cast_to_size_sink_count": 1.0, "thread_spawn_count": 2.0}, "semantic-x"),
        (2, known, {"cast_to_size_sink_count": 1.0, "thread_spawn_count": 2.0}, "light"),
        (3, known, {"integer_size_arithmetic_count": 1.0}, "light"),
        (4, known, {"integer_size_arithmetic_count": 1.0, "allocation_count": 1.0}, "light"),
        (5, known, {"thread_signal_count": 1.0, "lock_signal_count": 0.0}, "light"),
        (6, {"memory_bounds": 0.5, "taint_api": 0.5}, {"source_sink_path": 1.0, "toctou_pair": 1.0}, "light"),
        (7, known, {"source_to_sink_count": None}, "semantic-x"),
    ])
    fired = {k: sorted(r["trigger_scores"]) for k, r in got.items()}
    assert fired == {1: ["concurrency", "integer_overflow"], 2: [], 3: [], 4: ["integer_overflow"], 5: [], 6: ["concurrency"], 7: []}
    assert got[1]["scores"] == pytest.approx({"memory_bounds": 1 / 1.6, "integer_overflow": 0.3 / 1.6, "concurrency": 0.3 / 1.6})
    assert got[1]["selected"] == ["memory_bounds", "concurrency"] and got[1]["available_families"] == ["concurrency", "integer_overflow", "memory_bounds"]
    assert [x.rpartition(" ")[2] for x in got[1]["reasons"] if x.startswith("rule")] == ["concurrency", "integer_overflow"]
    assert got[2]["selected"] == ["memory_bounds"] and got[2]["margin"] == 1.0 and got[2]["entropy"] == 0.0
    assert not any(r["trigger_scores"] for r in routed(spark, [(1, known, {"thread_spawn_count": 2.0}, "semantic-x")], rules=False).values())


def test_a_forced_rule_goes_first_with_the_best_learned_family(spark):
    rows = [(1, {"memory_bounds": 0.4, "control_state": 0.6}, {"thread_spawn_count": 1.0, "source_to_sink_count": 1.0}, "semantic-x"), (2, {"memory_bounds": 1.0}, {}, "semantic-x"), (3, {}, {"thread_spawn_count": 1.0}, "semantic-x")]
    got = routed(spark, rows, mode="forced_trigger")
    assert got[1]["selected"] == ["taint_api", "control_state"] and got[1]["reasons"][-1] == "forced trigger selected unlearned family: taint_api"
    assert got[2]["selected"] == ["memory_bounds"] and got[3]["selected"] == ["concurrency"]
    assert routed(spark, rows, mode="forced_trigger", policy=Policy(most_experts=1))[1]["selected"] == ["taint_api"]


def test_bounds_reasons_and_odd_rows(spark):
    rows = [(1, {"a": 0.5, "b": 0.5}, None, None), (2, None, None, None), (3, {"a": 0.0, "b": 0.0}, {}, ""), (4, {"a": None, "b": 0.2}, {}, "x"), (4, {"a": None, "b": 0.2}, {}, "x")]
    got = routed(spark, rows)
    assert got[1]["selected"] == ["a", "b"] and len(got[1]["reasons"]) == 3
    assert (got[2]["selected"], got[2]["reasons"], got[2]["top1"]) == ([], [], 0.0)
    assert got[3]["selected"] == ["a", "b"] and got[4]["selected"] == ["b"]
    assert routes(spark.createDataFrame(rows, SCHEMA)).count() == 5 and routes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert routed(spark, rows, policy=Policy(most_experts=1))[1]["selected"] == ["a"]
    for bad in ({"confidence": 1.1}, {"margin": -0.1}, {"most_entropy": -1.0}, {"most_experts": 3}):
        with pytest.raises(ValueError):
            Policy(**bad)
    with pytest.raises(ValueError):
        routes(spark.createDataFrame(rows, SCHEMA), mode="other")
    with pytest.raises(Exception, match="the router reads semantic-x"):
        routed(spark, rows, schema="semantic-x")
