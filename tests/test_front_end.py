"""Facts, hypotheses and candidates of small C functions."""

import pytest

from evidark.functions.cfront.candidates import analyse_files, evidence_rows, features, hypotheses
from evidark.functions.cfront.facts import analyse
from evidark.functions.cfront.flow import Builder, dominators
from evidark.functions.cfront.syntax import functions


def kinds(body, params="char *d, char *s, int len, int cap, int flag"):
    [a] = analyse(f"void f({params}) {{ {body} }}")
    return {f.kind for f in a.facts}, a


@pytest.mark.parametrize("body,have,lack", [
    ("if (len > cap) return; memcpy(d, s, len);", {"guard_protects_sink", "memory_copy"}, {"memory_copy_without_guard"}),
    ("if (flag) { if (len > cap) return; } memcpy(d, s, len);", {"memory_copy_without_guard"}, {"guard_protects_sink"}),
    ("if (len > 0) memcpy(d, s, len);", {"memory_copy_without_guard"}, set()),
    ("if (len < cap) { memcpy(d, s, len); }", {"guard_protects_sink"}, {"memory_copy_without_guard"}),
    ("char *p = malloc(len * sizeof(int));", {"allocation", "arithmetic_to_allocation"}, set()),
    ("int n = len * 4; memcpy(d, s, n);", {"arithmetic_to_memory_sink"}, set()),
    ("char *p = malloc((unsigned long)len);", {"cast_to_size_sink", "numeric_conversion"}, {"arithmetic_to_allocation"}),
    ("free(d); d->field = 1;", {"use_after_release"}, {"double_release"}),
    ("free(d); d = malloc(len); d->field = 1;", {"release"}, {"use_after_release"}),
    ("free(d); free(d);", {"double_release"}, set()),
    ("free(d); if (flag) return; d[len] = 1;", {"use_after_release", "unchecked_index"}, set()),
    ("char buf[100]; read(flag, buf, 100); char *cmd = buf; system(cmd);", {"taint_source", "taint_sink", "source_to_sink", "unsanitized_source_to_sink"}, {"uninitialized_use"}),
    ("char *value = getenv(\"CMD\"); system(value);", {"source_to_sink"}, set()),
    ("char *value = getenv(\"CMD\"); value = s; system(value);", {"taint_sink"}, {"source_to_sink"}),
    ("int x; len = x + 1;", {"uninitialized_use"}, set()),
    ("int x; x = 1; len = x + 1;", set(), {"uninitialized_use"}),
    ("char *p = malloc(len); p[0] = 1;", {"unchecked_nullable_dereference"}, set()),
    ("char *p = malloc(len); if (!p) return; p[0] = 1;", {"allocation"}, {"unchecked_nullable_dereference"}),
    ("char *p = malloc(len); if (p != NULL) { *p = 1; }", {"allocation"}, {"unchecked_nullable_dereference"}),
    ("if (access(s, 0) == 0) fopen(s, \"r\");", {"toctou_check_use"}, set()),
    ("if (len < cap) d[len] = 0;", set(), {"unchecked_index"}),
    ("for (int i = 0; i < cap; i++) d[i] = s[i];", set(), {"unchecked_index"}),
    ("pthread_mutex_lock(&d); pthread_mutex_unlock(&d);", {"lock_acquire", "lock_release"}, set()),
    ("// free(d); free(d)\n /* system(s); */", set(), {"release", "taint_sink"}),
])
def test_facts(body, have, lack):
    found, _ = kinds(body)
    assert have <= found and not lack & found, found


def test_taint_path_and_hypotheses():
    _, a = kinds("char buf[100]; read(flag, buf, 100); char *cmd = buf; system(cmd);")
    assert [t["path"] for t in a.taints] == [["buf", "cmd"]]
    assert {"CWE-20", "CWE-78"} <= {h["cwe"] for h in hypotheses(a)}
    _, a = kinds("free(d); d[len] = 1;")
    assert [h["cwe"] for h in hypotheses(a)][:2] == ["CWE-416", "CWE-787"] and features(a, hypotheses(a))["hypothesis_count"] == 2


def test_flow_graphs():
    [f] = functions("int g(int a) { while (1) { if (a) break; a--; } return a; }")
    g = Builder(f).g
    assert not g.warnings and any(k == "loop_back" for _, _, k in g.edges)
    [f] = functions("int g(int a) { while (1) { a--; } return a; }")
    assert Builder(f).g.warnings  # nothing leaves the loop
    [f] = functions("int g(int a) { switch (a) { case 1: a = 2; break; default: a = 3; } do { a--; } while (a > 0); goto end; end: return a; }")
    g = Builder(f).g
    dom = dominators(g)
    assert 0 in dom[1] and not g.unsupported


def test_functions_and_determinism():
    code = "#define X {\nstatic int a(void) { return 1; }\nclass K { int K::b(int x) const { if (x) { return a(); } return 0; } };\n"
    assert [(f.name, f.line_start) for f in functions(code)] == [("a", 2), ("K::b", 3)]
    assert [x.fact_id for a in analyse("void f(char *p) { free(p); free(p); }") for x in a.facts] == [x.fact_id for a in analyse("void f(char *p) { free(p); free(p); }") for x in a.facts]
    assert functions("") == functions("int x = (((") == functions("}}}") == []


def test_candidates(spark):
    files = [("c1", "a.c", "void f(char *p) { free(p); free(p); }\nint quiet(int x) { return x; }"), ("c2", "b.c", "x" * 300), ("c3", "n.c", None)]
    df = spark.createDataFrame(files, "case_id string, file string, source string")
    out = analyse_files(df, 200).collect()
    assert [(r.case_id, r.function, r.error is None) for r in sorted(out, key=lambda r: r.case_id)] == [("c1", "f", True), ("c2", None, False)]
    [c] = [r for r in out if r.error is None]
    assert 0 < c.suspicion_score < 1 and c.candidate_id.startswith("C-") and c.features["double_release_count"] >= 1
    assert evidence_rows(analyse_files(df, 200)).where("kind = 'double_release'").count() >= 1
