"""Labelled cases from a made-up corpus."""

from pyspark.sql import functions as F

from evidark.plans.flow import CorpusConfig, prepare_corpus

BAD = "void {n}_bad(char *p) {{\n  p[{i}] = 1;\n{flaw}}}\nvoid good1(void) {{\n  return;\n}}\n"


def corpus():
    out = []
    for number in (121, 78):
        for name in "pqrst":
            for variant in (1, 2):
                flaw = "  /* FLAW: past the end */\n" if variant == 1 else ""
                out.append((f"src/CWE{number}/CWE{number}_{name}_0{variant}.c", BAD.format(n=f"{name}{number}", i=variant, flaw=flaw)))
    out += [("src/CWE121/CWE121_z_01.c", "int calm(void) { return 0; }"), ("src/CWE9999/x.c", BAD.format(n="x", i=1, flaw="")), ("src/plain/y.c", BAD.format(n="y", i=1, flaw="")), ("src/CWE362/c.c", BAD.format(n="c", i=1, flaw=""))]
    return out + [("src/CWE121/CWE121_copy_01.c", out[0][1])]  # the function of another file again: "copy" comes first by path


def test_cases_truths_and_splits(spark):
    files = spark.createDataFrame(corpus(), "path string, source string").repartition(4)
    cases, truths, counts = prepare_corpus(files, CorpusConfig(allowed=["memory_bounds", "taint_api"]))
    assert counts.first().asDict() == {"supported": 22, "unsupported": 2}
    got = cases.collect()
    assert len(got) == 20 and not any("_z_" in r.file or "_p_01" in r.file and r.number == 121 for r in got)
    by_project = {}
    for r in got:
        by_project.setdefault(r.project_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_project.values())
    assert all({r.split for r in got if r.expert == e} == {"train", "dev", "test"} for e in ("memory_bounds", "taint_api"))
    t = {r.file: (r.line_start, r.line_end, r.cwe) for r in truths.collect()}
    assert t["src/CWE78/CWE78_p_01.c"] == (3, 3, "CWE-78") and t["src/CWE78/CWE78_p_02.c"] == (1, 3, "CWE-78") and len(t) == 20
    order = [r.number for r in sorted(got, key=lambda r: r.ordinal)]
    assert order[:4] == [78, 121, 78, 121]


def test_caps(spark):
    files = spark.createDataFrame(corpus(), "path string, source string")
    cases, truths, _ = prepare_corpus(files, CorpusConfig(allowed=["memory_bounds", "taint_api"], most_per_template=1, most_per_family=4))
    per = {r.expert: r["count"] for r in cases.groupBy("expert").count().collect()}
    assert per == {"memory_bounds": 4, "taint_api": 4}
    assert cases.groupBy("project_id").count().agg(F.max("count")).first()[0] == 1 and truths.count() == 8
