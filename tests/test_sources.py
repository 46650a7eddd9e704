"""Readers' defaults, round trips, SARIF, diffs, scopes, models on disk and stream replay."""

import json

import pytest
from pyspark.sql import functions as F

from evidark.functions import patches
from evidark.functions.cfront.candidates import analyse_files
from evidark.operators import models
from evidark.sources import files, schemas
from evidark.streaming import replay

CASES = [
    {"case_id": "a", "project_id": "p", "source_files": {"f.c": "void f(char *p) { free(p); free(p); }"}, "ground_truth": [{"truth_id": "t", "file": "f.c", "line_start": 1, "line_end": 1, "experts": ["memory_bounds"]}]},
    {"case_id": "b", "source_files": {}, "split": "test"},
]


@pytest.fixture()
def case_file(tmp_path):
    path = tmp_path / "in" / "cases.jsonl"
    path.parent.mkdir()
    path.write_text("\n\n".join(map(json.dumps, CASES)) + "\n")
    return str(path)


def test_cases(spark, case_file):
    c = {r.case_id: r for r in files.cases(spark, case_file).collect()}
    assert (c["a"].split, c["b"].split, c["b"].project_id, c["b"].ground_truth, c["b"].metadata) == ("dev", "test", "b", [], {})
    assert [r.truth_id for r in files.truths(files.cases(spark, case_file)).collect()] == ["t"]
    with open(case_file, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="Malformed|malformed|FAILFAST"):
        files.cases(spark, case_file).collect()


def test_outcomes_defaults_and_compact(spark, tmp_path):
    rows = [{"case_id": "a", "candidate": {"candidate_id": "c", "static_score": 0.4, "code": "x"}, "assignment": {"expert": "e", "model_id": "m", "prompt_version": "1"}, "success": True, "cost": 0.1},
            {"case_id": "a", "candidate": {"candidate_id": "d", "suspicion_score": 0.2}, "assignment": {"expert": "e", "model_id": "m", "prompt_version": "1"}, "ground_truth_ids": ["t"]}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, rows)))
    o = files.outcome_samples(spark, str(tmp_path / "o.jsonl"))
    got = o.orderBy("candidate.candidate_id").collect()
    assert [r.candidate.suspicion_score for r in got] == [0.4, 0.2] and [r.truth_labels_available for r in got] == [False, True]
    assert got[0].unsupported_claims == 0 and got[0].assignment_id == "e::m::1" and got[0].matched_truth_ids == []
    files.write_jsonl(files.compact(o), str(tmp_path / "out"), "case_id")
    back = files.outcome_samples(spark, str(tmp_path / "out"))
    assert back.count() == 2 and back.where("candidate.code IS NOT NULL").count() == 0


def test_sarif(spark, tmp_path):
    doc = {"runs": [{"artifacts": [{"location": {"uri": "x/a.c"}}], "results": [
        {"ruleId": "CWE-0078", "locations": [{"physicalLocation": {"artifactLocation": {"index": 0}, "region": {"startLine": 3}}}]},
        {"ruleId": "none", "taxa": [{"id": "190"}], "locations": [{"physicalLocation": {"artifactLocation": {"uri": "b.c"}, "region": {"startLine": 4, "endLine": 6}}}]}]}]}
    (tmp_path / "m.sarif").write_text(json.dumps(doc, indent=1))
    got = sorted((r.cwe, r.uri, r.line_start, r.line_end) for r in files.sarif_locations(spark, str(tmp_path / "m.sarif")).collect())
    assert got == [("CWE-190", "b.c", 4, 6), ("CWE-78", "x/a.c", 3, 3)]


def test_project_sources_and_store(spark, tmp_path):
    for name, body in (("a.c", "int x;"), ("b.txt", "no"), (".git/c.c", "no"), ("sub/d.HPP", "int y;"), ("big.c", "x" * 99)):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(body)
    got = files.project_sources(spark, str(tmp_path / "p"), 50).collect()
    assert sorted(r.source for r in got) == ["int x;", "int y;"]
    s = spark.createDataFrame([("b", "e", "dev", "a"), ("a", "e", "dev", ""), ("c", "f", "test", None)], "case_id string, expert string, split string, duplicate_of string")
    files.store_scenarios(s, str(tmp_path / "s"))
    assert [r.case_id for r in files.scenarios(spark, str(tmp_path / "s")).collect()] == ["a", "c"]
    files.write_report(spark.sql("SELECT 1 AS b, 'x' AS a"), str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n  "a": "x",\n  "b": 1\n}\n'
    crash = spark.createDataFrame([(2, 1, 1, 0, "c", "https://github.com/x"), (1, 1, 1, 0, "c++", "https://github.com/y"), (3, 0, 1, 0, "c", "https://github.com/z")], "local_id int, reproduced int, patch_located int, submodule_bug int, language string, repo_addr string")
    assert [r.local_id for r in files.crash_records(crash, ["c", "c++"]).collect()] == [1, 2]
    assert schemas.FINDING


DIFF = "--- a/src/x.c\n+++ b/src/x.c\n@@ -1,3 +1,3 @@ f\n a\n-unsafe\n+safe\n b\n"


def test_patches(spark):
    df = spark.createDataFrame([("zero\na\nsafe\nb\nc", DIFF), ("other", DIFF), (None, DIFF)], "fixed string, diff string")
    assert [r[0] for r in df.select(patches.reverse_apply("fixed", "diff")).collect()] == ["zero\na\nunsafe\nb\nc", None, None]
    [h] = df.select(patches.parse_hunks("diff").alias("h")).first().h
    assert (h.path, h.old_start, h.new_count, h.context, h.lines) == ("src/x.c", 1, 3, "f", [" a", "-unsafe", "+safe", " b"])
    near = df.select(patches.nearest_hunk(patches.parse_hunks("diff"), F.lit("/work/src/x.c"), F.lit(9)).alias("n")).first().n
    assert near.distance == 8
    out = spark.createDataFrame([("x\n #0 0x1f in foo /a/b.c:12:3\n #1 0x2 in bar::baz c.cc:7\n",)], "t string").select(patches.stack_frames(F.col("t")).alias("f")).first().f
    assert [(f.depth, f.function, f.file, f.line) for f in out] == [(0, "foo", "/a/b.c", 12), (1, "bar::baz", "c.cc", 7)]
    ok = df.select(files.patch_in_scope(F.col("diff"), F.array(F.lit("src/x.c"))), files.patch_in_scope(F.col("diff"), F.array(F.lit("y"))), files.patch_in_scope(F.concat(F.lit("rename from a\n"), "diff"), F.array(F.lit("src/x.c")))).first()
    assert tuple(ok) == (True, False, False)
    paths = spark.createDataFrame([("a/b.c",), ("../x",), ("/abs",), ("c:/x",), ("a/CON",), (None,)], "p string").select(files.safe_relative(F.col("p"))).collect()
    assert [r[0] for r in paths] == [True, False, False, False, False, False]


def test_models(spark, tmp_path):
    rows = [(k, {"x": float(i % 7) + 5 * (k == "b"), "y": float(i % 3) - 4 * (k == "c")}, "v1") for i in range(60) for k in "abc"]
    df = spark.createDataFrame(rows, "label string, features map<string,double>, feature_schema_version string")
    assert models.one_version(df) == "v1"
    with pytest.raises(ValueError):
        models.one_version(df.withColumn("feature_schema_version", F.col("label")))
    m = models.fit(df, ["x", "y"], "label", most_iterations=60)
    m.save(str(tmp_path / "m"))
    back = models.RoutingModel.load(str(tmp_path / "m"))
    for model in (m, back):
        got = model.predict(df).select("label", F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"], e["key"])))["key"].alias("k"), F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
        assert sum(r.label == r.k for r in got) / len(got) > 0.75 and all(abs(r.s - 1) < 1e-9 for r in got)
    one = models.fit_binary(df.withColumn("y1", F.lit(True)), ["x"], "y1").predict(df).first().scores
    assert one["yes"] == 1.0
    assert models.importance(m, 1).count() == 6


def test_stream_equals_batch(spark, case_file, tmp_path):
    def per_case(df):
        found = analyse_files(files.source_files(df).select("case_id", "file", "source")).groupBy("case_id").agg(F.count("candidate_id").cast("int").alias("candidates"), F.max("error").alias("error"))
        return df.select("case_id", F.size("ground_truth").alias("truths")).join(found, "case_id", "left").withColumn("hits", F.least("candidates", "truths"))

    cases = lambda df: df.withColumn("ground_truth", F.coalesce("ground_truth", F.array().cast(df.schema["ground_truth"].dataType)))
    run = lambda: replay.analyse_stream(cases(replay.case_stream(spark, case_file.rsplit("/", 1)[0])), per_case, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    run()  # nothing new: the checkpoint knows the files
    got = replay.replay_metrics(spark, str(tmp_path / "out")).first()
    assert (got.cases, got.errors, got.candidates, got.truths, got.recall) == (2, 0, 1, 1, 1.0)
