"""Cases from crash records: golden ones by hand, texts taken back against patching them, lines carried against both texts."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from evidark.functions.patches import parsed, stack_frames
from evidark.operators import cases
from evidark.plans import catalog

RECORD = "local_id long, project string, crash_type string, fix_commit string"
FRAME = "local_id long, depth int, function string, file string, line int"
HUNK = "local_id long, old_path string, path string, hunk_no int, old_start int, old_count int, new_start int, new_count int, context string, lines array<string>"
SOURCE = "local_id long, path string, text string"


def hunk_rows(i, diff, path, old_path=None):
    return [(i, old_path or path, path, n, h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["context"], h["lines"]) for n, h in enumerate(parsed(diff))]


DIFF = "--- a/src/vuln.c\n+++ b/src/vuln.c\n@@ -1,3 +1,4 @@ int vulnerable(int *p)\n int vulnerable(int *p) {\n+  if (!p) return 0;\n   return p[1];\n }\n"
FIXED = "int vulnerable(int *p) {\n  if (!p) return 0;\n  return p[1];\n}\n"


def build(spark, records, frames, hunks, sources, done=None):
    frames_ = [spark.createDataFrame(x, k) for x, k in ((records, RECORD), (frames, FRAME), (hunks, HUNK), (sources, SOURCE))]
    found, failed = cases.build_cases(*frames_, done)
    return {r.local_id: r for r in found.collect()}, {r.local_id: r.reason for r in failed.collect()}


def test_truth_comes_from_stack_and_patch(spark):
    out = spark.createDataFrame([("#0 0x1 in vulnerable /src/demo/src/vuln.c:2:10\n#1 0x2 in main /src/demo/main.c:9",)], "o string").select(F.explode(stack_frames(F.col("o"))).alias("f")).select("f.*")
    from evidark.functions.names import frame_path

    frames = [(1, r.depth, r.function, r.p, r.line) for r in out.withColumn("p", frame_path("file", F.lit("demo"))).collect()]
    ok, bad = build(spark, [(1, "demo", "Heap-buffer-overflow READ 4", "fixed later")], frames, hunk_rows(1, DIFF, "src/vuln.c"), [(1, "src/vuln.c", FIXED)])
    r = ok[1]
    assert (r.file, r.line_start, r.function, r.ground_truth_source, r.expert, r.cwes) == ("src/vuln.c", 2, "vulnerable", "crash-stack+patch", "memory_bounds", ["CWE-125"])
    assert r.source == "int vulnerable(int *p) {\n  return p[1];\n}\n" and (r.vulnerable_revision, r.fixed_revision, r.truth_id) == ("fixed^", "later", "crash-1-truth-1") and bad == {}


def test_files_failures_and_clamps(spark):
    other = DIFF.replace("vulnerable", "other")
    records = [(i, "p", "Use-of-uninitialized-value", "c") for i in range(1, 9)] + [(9, "p", None, " ")]
    hunks = [h for i in (1, 2, 3, 4, 7, 8) for h in hunk_rows(i, DIFF, "b.c") + hunk_rows(i, other, "new/a.h", "a.h") + hunk_rows(i, DIFF, "doc.txt")] + hunk_rows(5, DIFF, "x.py") + hunk_rows(6, DIFF.replace("return p[1]", "return q"), "z.c")
    both = lambda i: [(i, "b.c", FIXED), (i, "new/a.h", FIXED.replace("vulnerable", "other"))]
    sources = both(1) + both(2) + [(3, "b.c", FIXED)] + both(7) + [(8, "b.c", "// moved\n\n" + FIXED)] + [(6, "z.c", FIXED), (5, "x.py", FIXED)]
    frames = [(2, 0, "ns::K::f(int)", "elsewhere.c", 1), (2, 1, "f", "lib/b.c", 3), (2, 2, "g", "b.c", 1), (7, 0, "f", "b.c", 400)]
    ok, bad = build(spark, records, frames, hunks, sources)
    told = {i: (r.file, r.line_start, r.function, r.ground_truth_source) for i, r in ok.items()}
    assert told == {1: ("a.h", 1, "other", "patch-hunk"), 2: ("b.c", 3, "f", "crash-stack+patch"), 3: ("b.c", 1, "vulnerable", "patch-hunk"), 7: ("b.c", 1, "f", "patch-hunk-clamped"), 8: ("b.c", 1, "vulnerable", "patch-hunk")}
    assert ok[8].source == "// moved\n\nint vulnerable(int *p) {\n  return p[1];\n}\n"  # found two lines further on
    assert bad == {4: cases.NO_FILE, 5: cases.NO_FILE, 6: cases.NO_PLACE, 9: cases.NO_FIX}
    ok, bad = build(spark, records, frames, hunks, sources, spark.createDataFrame([(1,), (9,)], "local_id long"))
    assert set(ok) == {2, 3, 7, 8} and set(bad) == {4, 5, 6}


def revisions(seed):
    """Two texts and the diff between them."""
    rng = random.Random(seed)
    old = [f"line {rng.randint(0, 30)}" for _ in range(rng.randint(5, 60))]
    new = list(old)
    for _ in range(rng.randint(1, 6)):
        at = rng.randrange(len(new))
        new[at : at + rng.randint(0, 2)] = [f"new {rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]
        new = new or ["x"]
    diff = "\n".join(difflib.unified_diff(old, new, "a/f.c", "b/f.c", lineterm="", n=rng.choice([0, 1, 3])))
    return old, new, diff


def test_texts_and_lines_between_revisions(spark):
    made = {i: revisions(i) for i in range(40)}
    made = {i: x for i, x in made.items() if x[0] != x[1]}
    hunks = spark.createDataFrame([h for i, (_, _, d) in made.items() for h in hunk_rows(i, d, "f.c")], HUNK)
    texts, bad = cases.taken_back(spark.createDataFrame([(i, "f.c", "\n".join(n)) for i, (_, n, _) in made.items()], SOURCE), hunks)
    # without context a hunk that only takes lines away has no new side, and stands one line earlier than its header says
    sure = {i for i, (_, _, d) in made.items() if all(h["new_count"] for h in parsed(d))}
    assert len(sure) > 20 and bad.count() == 0
    assert {r.local_id: r.text for r in texts.collect() if r.local_id in sure} == {i: "\n".join(made[i][0]) for i in sure}
    points = spark.createDataFrame([(i, "f.c", k + 1) for i, (o, _, _) in made.items() for k in range(len(o))], "local_id long, path string, line int")
    got = {(r.local_id, r.line): r.new_line for r in cases.carried(points, hunks).collect()}
    for i, (o, n, d) in made.items():
        inside = {k for h in parsed(d) for k in range(h["old_start"], h["old_start"] + h["old_count"])}
        for k in range(1, len(o) + 1):
            assert (got[i, k] is None) == (k in inside) and (k in inside or n[got[i, k] - 1] == o[k - 1])


def test_order_and_training_set(spark):
    rows = [(i, f"crash-{i}", f"p{i % 7}", "x.c", f"crash-{i}-truth-1", 5, 5, ["memory_bounds", "taint_api", "control_state"][i % 3 if i < 30 else 0], "unassigned") for i in range(60)]
    made = spark.createDataFrame(rows, "local_id long, case_id string, project_id string, file string, truth_id string, line_start int, line_end int, expert string, split string")
    order = [r.expert for r in cases.chosen_cases(made, 9).orderBy("position").collect()]
    assert order == ["control_state", "memory_bounds", "taint_api"] * 3
    assert cases.chosen_cases(made, unique_projects=True).count() == 7 and cases.chosen_cases(made, 3, True).count() == 3
    candidates = spark.createDataFrame([(f"k{i}", f"crash-{i}", "x.c", 1, 9, 0.5) for i in range(50)] + [("far", "crash-1", "x.c", 20, 30, 0.9)], "candidate_id string, case_id string, file string, line_start int, line_end int, score double")
    split, samples, manifest = cases.training_set(made, candidates)
    by = {r.project_id: r.split for r in split.select("project_id", "split").distinct().collect()}
    assert len(by) == 7 and set(by.values()) == {"train", "dev", "test"}
    assert samples.count() == 50 and {tuple(r.labels) for r in samples.collect()} == {("memory_bounds",), ("taint_api",), ("control_state",)}
    assert sum(r.cases for r in manifest.collect()) == 60 and sum(r.router_samples for r in manifest.collect()) == 50


def test_query_reads_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert catalog.queries()["case_failures"](spark, sf).count() + catalog.queries()["case_building"](spark, sf).count() == n


def shuffled_and_written(spark, run):
    """Bytes that ``run`` shuffles, spills and writes."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages}

    before = total()
    run()
    return sum(n for key, n in total().items() if key not in before)


def test_lines_of_texts_are_not_dealt_as_rows(spark):
    """Bytes moved follow the texts' size, not their number of lines."""
    def moved(lines):
        text = "\n".join(["int x;"] * (lines // 2) + ["  return p[1];"] + ["int x;"] * (lines // 2))
        diff = f"@@ -{lines // 2},2 +{lines // 2},3 @@ f(a)\n int x;\n+  return p[1];\n int x;\n"
        frames_ = [spark.createDataFrame(x, k) for x, k in (([(i, "p", "abort", "c") for i in range(20)], RECORD), ([(0, 0, "f", "b.c", 1)], FRAME), ([h for i in range(20) for h in hunk_rows(i, diff, "b.c")], HUNK), ([(i, "b.c", text) for i in range(20)], SOURCE))]
        return shuffled_and_written(spark, lambda: cases.build_cases(*frames_)[0].select("case_id", F.length("source")).write.format("noop").mode("overwrite").save())

    assert moved(4000) < 200_000


def test_hunks_at_one_place_and_texts_of_one_hunk(spark):
    """Two hunks without a new side stand in their order; a text that the patch has made whole is empty before it."""
    lines = [(1, "b.c", "b.c", n, 3 + n, 2, 2, 0, "", [f"-a{n}", f"-b{n}"]) for n in (0, 1)]
    texts, bad = cases.taken_back(spark.createDataFrame([(1, "b.c", "x\ny\nz"), (2, "b.c", "new")], SOURCE), spark.createDataFrame(lines + [(2, "b.c", "b.c", 0, 0, 0, 1, 1, "", ["+new"])], HUNK))
    assert {r.local_id: r.text for r in texts.collect()} == {1: "x\na0\nb0\na1\nb1\ny\nz", 2: ""} and bad.count() == 0
