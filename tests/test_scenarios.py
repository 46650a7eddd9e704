"""Neutral scenarios: layout, names, paths, truths, safe functions, what raises; rewriting against a character-wise reading."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidark.operators import scenarios
from evidark.operators.assertions import DataError

RAW = '/* FLAW: CWE-190 */\nvoid CWE190_demo_bad() { puts("Calling bad()"); }\n// FIX\nvoid goodB2G() { return; }\n'


def blanked(text):
    """Comments as spaces, character by character."""
    out, i, state, quote = list(text), 0, "", ""
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if not state:
            if c in "\"'":
                state, quote = "quoted", c
            elif two in ("//", "/*"):
                state, out[i], out[i + 1], i = two, " ", " ", i + 1
        elif state == "quoted":
            if c == "\\":
                i += 1
            elif c == quote:
                state = ""
        elif state == "//":
            if c == "\n":
                state = ""
            else:
                out[i] = " "
        elif two == "*/":
            out[i], out[i + 1], i, state = " ", " ", i + 1, ""
        elif c not in "\r\n":
            out[i] = " "
        i += 1
    return "".join(out)


def test_comments_against_reading_them(spark):
    rng = random.Random(1)
    some = ["/*", "*/", "//", "\n", '"', "'", "\\", "a", " ", "bad", "é", "\r\n", "/"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["", RAW, '"' + "x\\n" * 20_000 + '"', "/*" + "y\n" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scenarios.without_comments(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: blanked(t) for i, t in enumerate(texts)}


def test_names_are_neutral_and_alike(spark):
    said = "goodB2G(CWE190_x, cwe, my_fixture, plain, x9bad, 9bad, goodB2G)"
    r = spark.createDataFrame([(said, "goodB2G", "b" * 10 + "bad" * 50)], "t string, n string, l string").select(scenarios.neutral_names(F.col("t")).alias("t"), scenarios.neutral_names(F.col("n")).alias("n"), scenarios.neutral_names(F.col("l")).alias("l")).first()
    assert len(r.t) == len(said) and r.t.count(r.n) == 2 and re.fullmatch(r"n\d{6}", r.n) and re.fullmatch(r"n\d{159}", r.l)
    assert [w for w in re.findall(r"\w+", r.t) if not re.fullmatch(r"n\d+", w)] == ["cwe", "plain", "9bad"]


SCENARIO = "case_id string, split string, cwe string, expert string, leakage_group string"
SOURCE = "case_id string, raw_path string, text string, sha256 string"
FUNCTION = "case_id string, raw_path string, name string, line_start int, line_end int, calls array<string>, assignments int, accesses int"
POSITIVE = "case_id string, raw_path string, line_start int, line_end int, ordinal int"


def made(spark, sources, functions, positives):
    rows = [(c, p, t, hashlib.sha256(t.encode()).hexdigest()) for c, p, t in sources]
    s = sorted({c for c, _, _ in sources})
    frames = [spark.createDataFrame(x, k) for x, k in (([(c, "train", "CWE-190", "integer_overflow", f"g-{c}") for c in s], SCENARIO), (rows, SOURCE), (functions, FUNCTION), (positives, POSITIVE))]
    return scenarios.materialize(*frames), frames


def test_a_scenario(spark):
    path = "src/testcases/CWE190_demo_bad.cpp"
    functions = [("c1", path, "CWE190_demo_bad", 2, 2, ["puts"], 0, 0), ("c1", path, "goodB2G", 4, 4, [], 0, 0), ("c1", path, "good", 4, 4, ["goodB2G"], 0, 0), ("c1", path, "good_near", 1, 3, [], 1, 0), ("c2", "a.h", "f", 1, 1, [], 0, 0)]
    out, frames = made(spark, [("c1", path, RAW), ("c1", "z.cc", "int x;"), ("c2", "a.h", "void f();\nCWE-12")], functions, [("c1", path, 2, 2, 1), ("c2", "a.h", 2, 2, 1)])
    files = {r.raw_path: r for r in out["files"].collect()}
    token = hashlib.sha256(b"c1").hexdigest()[:12]
    assert files[path].file == f"case_{token}/unit_001.cpp" and files["z.cc"].file == f"case_{token}/unit_002.cc" and files["a.h"].file.endswith("/unit_001.c")
    text = files[path].text
    assert len(text) == len(RAW) and [len(x) for x in text.split("\n")] == [len(x) for x in RAW.split("\n")] and not re.search(scenarios.LEAK, text)
    truths = {r.case_id: r for r in out["truths"].collect()}
    t = truths["c1"]
    assert t.function in text and len(t.function) == len("CWE190_demo_bad") and (t.line_start, t.experts, t.cwes, t.file) == (2, ["integer_overflow"], ["CWE-190"], files[path].file)
    assert t.truth_id == "truth-" + hashlib.sha256(f"c1:{t.file}:2:1".encode()).hexdigest()[:20] and truths["c2"].function == ""
    [n] = out["negatives"].collect()
    assert n.function in text and (n.line_start, n.file) == (4, files[path].file)
    assert sorted((r.case_id, r.warning) for r in out["warnings"].collect()) == [("c1", f"safe function that meets a truth: {path}:good_near"), ("c2", "location outside parsed function: a.h:2"), ("c2", "no safe function was found")]
    assert sorted((r.case_id, r.line, r.token) for r in out["leaks"].collect()) == [("c2", 2, "CWE-12")]
    assert {r.label for r in out["review"].collect()} == {"vulnerable", "target_cwe_safe"} and out["review"].count() == 3
    with pytest.raises(DataError, match="changed"):
        scenarios.materialize(frames[0], frames[1].withColumn("text", F.concat("text", F.lit(" "))), *frames[2:])
    with pytest.raises(DataError, match="not indexed"):
        scenarios.materialize(*frames[:3], frames[3].withColumn("raw_path", F.lit("none.c")))
