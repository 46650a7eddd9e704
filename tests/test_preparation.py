"""Filters, truths, splits, caches and small texts of case preparation, against small tables by hand."""

import json

import pytest
from pyspark.sql import functions as F

from evidark.functions import names
from evidark.operators import policies, preparation, splits
from evidark.operators.assertions import DataError


def test_paths(spark):
    rows = [("/src/lib/a/../b.c", "lib"), ("/src/other/x.c", "lib"), ("\\src\\lib\\c.c", "lib"), ("//x/y.c", None), ("a/./b.c", "q"), (None, "q")]
    got = spark.createDataFrame(rows, "p string, q string").select(names.frame_path("p", "q").alias("v")).collect()
    assert [r.v for r in got] == ["b.c", "other/x.c", "c.c", "x/y.c", "a/b.c", None]
    rows = [("a/b.c", "/b.c", True), ("b.c", "a/b.c", True), ("ab.c", "b.c", False), ("./a//b.c", "a\\b.c", True), (None, "a", None)]
    got = spark.createDataFrame(rows, "a string, b string, w boolean").select(names.same_path("a", "b").alias("v"), "w").collect()
    assert all(r.v == r.w for r in got)


def test_names(spark):
    rows = [("int ns::Klass::run (int a)", "run"), ("static void go", "go"), ("f(x::y z)", "f"), ("", ""), ("(x)", "")]
    assert all(r.v == r.w for r in spark.createDataFrame(rows, "s string, w string").select(names.function_name(F.col("s")).alias("v"), "w").collect())
    rows = [("static int ~x::y (a) { f(", "f"), ("class A", ""), (None, "")]
    assert all(r.v == r.w for r in spark.createDataFrame(rows, "s string, w string").select(names.hunk_function(F.col("s")).alias("v"), "w").collect())
    one = spark.createDataFrame([("--- a/f1\n+++ b/f10\n", {"f1": "x.c", "f10": "y.c"}, "@@ -12,3 +12,4 @@ f")], "d string, m map<string,string>, h string")
    r = one.select(names.remap_diff("d", "m").alias("d"), names.first_old_line(F.col("h")).alias("n"), names.xml_escaped(F.lit('a<b & "c">')).alias("x")).first()
    assert (r.d, r.n, r.x) == ("--- a/x.c\n+++ b/y.c\n", 12, "a&lt;b &amp; &quot;c&quot;&gt;")
    none = spark.createDataFrame([([],)], "e array<struct<knowledge_id:string,title:string,source:string,content:string>>").select(names.knowledge_text(F.col("e"), 9).alias("v")).first().v
    assert none == "No retrieved security knowledge."


def test_functions_and_truths(spark):
    f = spark.createDataFrame([("a", "x_BAD", ["g"], 0, 0), ("a", "goodSink", ["goodG2B"], 0, 0), ("a", "good1", ["goodB", "memcpy"], 0, 0), ("a", "good2", [], 0, 0), ("a", "good3", ["good"], 1, 0)], "file string, function string, calls array<string>, n int, m int")
    got = f.select("function", preparation.is_bad(F.col("function")).alias("b"), preparation.is_good(F.col("function"), F.col("calls"), F.col("n"), F.col("m")).alias("g")).collect()
    assert [(r.b, r.g) for r in got] == [(True, False), (False, False), (False, True), (False, True), (False, True)]
    files = spark.createDataFrame([("a", "x\r\n/* FLAW: here */\n\n// flaw again\nflawless")], "file string, source string")
    lines = preparation.marked_lines(files, ["file"], "source")
    assert sorted(r.line for r in lines.collect()) == [2, 4]
    spans = spark.createDataFrame([("a", "f", 1, 4), ("a", "g", 5, 5), ("b", "f", 1, 9)], "file string, function string, line_start int, line_end int")
    got = preparation.truth_spans(spans, lines, ["file"]).orderBy("file", "function", "ordinal").collect()
    assert [tuple(r) for r in got] == [("a", "f", 2, 2, 1), ("a", "f", 4, 4, 2), ("a", "g", 5, 5, 1), ("b", "f", 1, 9, 1)]
    regions = spark.createDataFrame([("a\nb\n", 1, 2, True), ("a\nb\n", 1, 3, False), ("", 1, 1, True), (None, 1, 1, False), ("a", 0, 1, False), ("a\nb", 2, 1, False)], "s string, x int, y int, w boolean")
    assert all(r.v == r.w for r in regions.select(preparation.valid_region(F.col("s"), F.col("x"), F.col("y")).alias("v"), "w").collect())


def test_labels_models_and_routes(spark):
    s = spark.createDataFrame([(1, ["taint_api"]), (2, ["memory_bounds"]), (3, ["a", "b"]), (4, [])], "id int, labels array<string>")
    one = preparation.single_label(s)
    assert {r.id: r.label for r in one.collect()} == {1: "taint_api", 2: "memory_bounds"}
    assert preparation.available_families(one) == ["memory_bounds", "taint_api"]
    with pytest.raises(DataError):
        preparation.available_families(s)
    a = spark.createDataFrame([("x", "m"), ("y", "m"), ("x", "n")], "expert string, model_id string")
    assert policies.restrict_to_model(a, "m", ["x", "y"]).count() == 2
    with pytest.raises(DataError, match="y"):
        policies.restrict_to_model(a, "n", ["x", "y"])
    assert preparation.one_model([" m ", "m", ""]) == "m"
    with pytest.raises(DataError):
        preparation.one_model(["m", "n"])
    c, r = spark.createDataFrame([("a",), ("b",)], "candidate_id string"), spark.createDataFrame([("b", 1), ("a", 2)], "candidate_id string, route int")
    assert preparation.routed(c, r).count() == 2
    for bad in (r.where("route = 1"), r.union(r)):
        with pytest.raises(DataError):
            preparation.routed(c, bad)


def test_splits(spark):
    rows = spark.createDataFrame([(f, f"{f}{i}") for f in "ab" for i in range(40)] + [("b", "a0"), ("b", "a1")], "family string, project string")
    got = {r.project: r.split for r in splits.stratified_split(rows, "family", "project").collect()}
    assert len(got) == 80 and all(5 <= sum(s == x and p[0] == f for p, s in got.items()) <= 7 for f in "ab" for x in ("dev", "test"))
    with pytest.raises(DataError):
        splits.stratified_split(rows.where("project < 'a1'"), "family", "project")
    d = spark.createDataFrame([(1, None, "train", "g"), (2, 1, "test", "h"), (3, 9, "dev", "k")], "id int, duplicate_of int, split string, leakage string")
    got = splits.inherited(d, "id", "duplicate_of", "split", "leakage").orderBy("id").collect()
    assert [(r.split, r.leakage) for r in got] == [("train", "g"), ("train", "g"), ("dev", "k")]
    manifest = lambda **more: {"splits": {s: {"case_count": 1, "projects": [s]} | more.get(s, {}) for s in ("train", "dev", "test")}}
    assert splits.frozen_manifest(manifest())["dev"] == {"dev"}
    for bad in ({"splits": {}}, manifest(dev={"projects": ["train"]}), manifest(test={"case_count": 0}), manifest(train={"projects": []})):
        with pytest.raises(DataError):
            splits.frozen_manifest(bad)


def test_caches_and_files(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for settings in ({"size": 1}, {"size": 1}, {"size": 2}):
        assert preparation.cached(spark, f"{tmp_path}/cache", settings, make).count() == 3
    assert len(made) == 2
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    cache = spark.createDataFrame([("a", "C1", 0.2, "f", 1), ("a", "C2", 0.9, "f", 1), ("z", "C3", 0.1, "f", 1)], "case_id string, candidate_id string, suspicion_score double, file string, line_start int")
    got = {r.case_id: [c.candidate_id for c in r.candidates] for r in preparation.with_cache(cases, cache).collect()}
    assert got == {"a": ["C2", "C1"], "b": []}
    (tmp_path / "cases").mkdir()
    for n, rows in (("b", [{"x": 3}]), ("a", [{"x": 1}, {"x": 2}])):
        (tmp_path / "cases" / f"{n}.json").write_text(json.dumps({"rows": rows, "detection": "d" if n == "a" else None}))
    rows, found = preparation.consolidated(spark, f"file://{tmp_path}/cases", "x:int")
    assert [r.x for r in rows.orderBy("file", "ordinal").collect()] == [1, 2, 3] and found.count() == 1
    for n in ("p2", "p1", "none"):
        (tmp_path / "packages" / n).mkdir(parents=True)
        if n != "none":
            (tmp_path / "packages" / n / "manifest.sarif").write_text("{}")
    assert [r.name for r in preparation.packages(spark, f"file://{tmp_path}/packages").collect()] == ["p1", "p2"]
    assert [r.name for r in preparation.packages(spark, f"file://{tmp_path}/packages", 1).collect()] == ["p1"]
    assert preparation.index_summary(spark.createDataFrame([("n", "3"), ("s", '{"a": 1}')], "key string, value string")) == {"n": 3, "s": {"a": 1}}
    sheet = preparation.review_sheet(cases.withColumn("more", F.lit(1)))
    assert sheet.columns == preparation.REVIEW and sheet.count() == 2
    big = spark.createDataFrame([("a", {"f": "x" * 10, "g": "é"}), ("b", {})], "case_id string, source_files map<string,string>")
    assert [tuple(r) for r in preparation.large_cases(big, 11).collect()] == [("a", 12)]
    assert preparation.compact(big.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))).where("size(source_files) = 0 AND size(metadata) = 0").count() == 2


def test_mapping(spark, tmp_path):
    path = tmp_path / "m.toml"
    path.write_text('schema_version = "1"\n[experts]\nE1 = "memory"\nE4 = "taint"\n[cwe]\n0121 = "E1"\n78 = "E4"\n')
    mapping, digest = preparation.load_mapping(str(path))
    assert mapping == {"121": "E1", "78": "E4"} and len(digest) == 64
    rows = spark.createDataFrame([("CWE-121", "E1"), ("cwe 0078", "E4"), ("CWE-1", None), ("none", None)], "c string, w string")
    assert all(r.v == r.w for r in rows.select(preparation.mapped_expert(F.col("c"), mapping).alias("v"), "w").collect())
    path.write_text('[experts]\nE1 = "memory"\n[cwe]\n1 = "E9"\n')
    with pytest.raises(DataError):
        preparation.load_mapping(str(path))


def test_audit_finds_each_problem(spark):
    cases = [(e, f"p{i}", "train", e, f"x{i}", f"c{i}") for i, e in enumerate(preparation.ACTIVE)]
    regions = [(e, k, "a\nb", 1, 2, {"memory_bounds": "CWE-787", "integer_overflow": "CWE-190", "taint_api": "CWE-78", "control_state": "CWE-252", "concurrency": "CWE-362"}[e], e) for e in preparation.ACTIVE for k in ("positive", "negative")]

    def run(cases, regions, leaks=()):
        c = spark.createDataFrame(cases, "case_id string, project_id string, split string, expert string, exact_hash string, canonical_hash string")
        r = spark.createDataFrame(regions, "case_id string, kind string, source string, line_start int, line_end int, cwe string, expert string")
        return {x.check: x.problems for x in preparation.audit_cohort(c, r, spark.createDataFrame([(x,) for x in leaks], "case_id string"), 1).collect() if x.problems}

    assert run(cases, regions) == {}
    assert run(cases + [("z", "p0", "test", "taint_api", "x0", "c9")], regions, ["z"]) == {"project_overlap": 1, "exact_hash_crosses_splits": 1, "family_count": 1, "oracle_leak": 1, "missing_negative_regions": 1}
    assert run(cases, [regions[0][:4] + (9,) + regions[0][5:6] + ("taint_api",), *regions[1:]]) == {"mapping_mismatch": 1, "invalid_positive_region": 1}
    assert run(cases, [*regions[:1], regions[1][:3] + (0,) + regions[1][4:], *regions[2:]]) == {"invalid_negative_region": 1}


def test_live_summary_of_nothing(spark):
    kind = "ground_truth_ids array<string>, matched_truth_ids array<string>, validations array<struct<finding_id:string,verdict:string>>, matched_by_finding map<string,array<string>>, usage array<struct<cost:double,prompt_tokens:bigint,completion_tokens:bigint>>"
    r = preparation.live_summary(spark.createDataFrame([], kind)).first()
    assert (r.case_count, r.validated_precision, r.ground_truth_recall, r.f1, r.realized_cost_usd) == (0, 1.0, 1.0, 1.0, 0.0)
    rows = [(["t", "u"], ["t"], [("f", "validated"), ("g", "rejected"), ("h", "validated")], {"f": ["t"], "g": ["t"], "h": []}, [(0.5, 3, 4), (None, None, 1)]), ([], [], None, None, None)]
    r = preparation.live_summary(spark.createDataFrame(rows, kind)).first()
    assert (r.case_count, r.validated_finding_count, r.ground_truth_matched_finding_count, r.validated_precision, r.ground_truth_recall, r.prompt_tokens, r.completion_tokens, r.realized_cost_usd) == (2, 2, 1, 0.5, 0.5, 3, 5, 0.5)
