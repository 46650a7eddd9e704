"""Matrices keep every event type, however many there are."""

from evidark.plans import catalog


def test_seventy_types(spark, tmp_path):
    spark.sql("SELECT id AS event_id, id % 3 AS user_id, TIMESTAMP '2024-01-09 00:00:00' AS ts, concat('t', id) AS event_type FROM range(70)").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert len({(r.candidate_id, r.assignment) for r in run("matrix_cross_join")}) == 3 * 70
    assert {r.expected for r in run("matrix_audit")} <= {0, 70}
    spark.sql("SELECT id AS event_id, id % 3 AS user_id, TIMESTAMP '2024-01-16 00:00:00' AS ts, concat('t', id) AS event_type FROM range(70)").write.parquet(f"{tmp_path}/two/events.parquet")
    audit = catalog.queries()["matrix_audit"](spark, f"{tmp_path}/two").collect()
    assert {(r.expected, r.found) for r in audit} == {(70, 24), (70, 23)}
