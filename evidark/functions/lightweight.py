"""The light analyser: regular expressions on function regions instead of flow analysis, natively but for the regions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidark.functions.cfront.syntax import functions

# What each signal of the light analyser counts, and the kind of evidence a match is.
PATTERNS = {
    "memory_api": ("memory_sink", r"\b(?:memcpy|memmove|strcpy|strcat|sprintf|gets)\s*\("),
    "array_access": ("memory_access", r"\b[A-Za-z_]\w*\s*\[[^\]]+\]"),
    "bounds_guard": ("guard", r"\bif\s*\([^)]*(?:sizeof|capacity|size|max|length|len|count)[^)]*[<>=]"),
    "allocation": ("allocation", r"\b(?:malloc|calloc|realloc|new)\b"),
    "free": ("release", r"\b(?:free\s*\(|delete\b)"),
    "integer_size_arithmetic": ("integer_arithmetic", r"\b(?:size|len|length|count|bytes|capacity)\w*\s*(?:\*|\+|<<)"),
    "cast": ("type_conversion", r"(?:\([us]?(?:char|short|int|long|size_t)\)|static_cast<)"),
    "input_source": ("taint_source", r"\b(?:read|recv|fread|scanf|getenv|argv)\b"),
    "dangerous_sink": ("taint_sink", r"\b(?:system|popen|execl|execv|printf|fprintf|open|fopen)\s*\("),
    "error_signal": ("error_path", r"\b(?:errno|return\s+-1|goto\s+(?:fail|error)|cleanup|parse|decode)\b"),
    "state_signal": ("state", r"(?i)\b(?:state|status|initialized|authenticated|phase)\w*\b"),
    "thread_signal": ("concurrency", r"\b(?:pthread_|std::thread|atomic|shared_|global_)\w*"),
    "lock_signal": ("synchronization", r"\b(?:mutex|lock_guard|unique_lock|pthread_mutex)\w*"),
    "toctou_signal": ("toctou", r"\b(?:access|stat|lstat)\s*\([^;]+;[\s\S]{0,300}\b(?:open|fopen|unlink|rename)\s*\("),
}
FILE_CHECK, FILE_USE = r"\b(?:access|stat|lstat)\s*\(", r"\b(?:open|fopen|unlink|rename)\s*\("
NAME = r"[A-Za-z_]\w*"
#: A freed name that is indexed, followed or freed again later in the text.
REUSED = rf"\bfree\s*\(\s*({NAME})\s*\)[\s\S]*?(?:\b\1\s*(?:\[|->|\.)|\bfree\s*\(\s*\1\s*\))"


def released_then_accessed(code: Column) -> Column:
    return F.rlike(code, F.lit(REUSED))


def line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def match_lines(code: Column, pattern: str) -> Column:
    """Of each match of a pattern, in order, the line feeds before it: what the pieces between matches and the matches hold."""
    pieces, matches = F.split(code, pattern, -1), F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(line_feeds(p).alias("before"), line_feeds(m).alias("inside")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, start, lambda a, x: F.struct((a["n"] + x["before"] + x["inside"]).alias("n"), F.array_append(a["out"], a["n"] + x["before"]).alias("out")), lambda a: a["out"])


def evidence(code: Column, file: Column, line_start: Column, digest: Column) -> Column:
    """array<struct<evidence_id, kind, file, line, expression, facts>>: every match of every signal, numbered in their order."""
    lines = F.split(code, "\n")

    def of(signal: str, kind: str, pattern: str) -> Column:
        return F.transform(match_lines(code, pattern), lambda at, i: F.struct(F.lit(kind).alias("kind"), F.lit(signal).alias("signal"), i.alias("nth"), at.alias("at")))

    every = F.flatten(F.array(*[of(s, k, p) for s, (k, p) in PATTERNS.items()]))
    return F.transform(every, lambda m, i: F.struct(
        F.concat(F.lit("EV-"), digest, F.lit("-"), (i + 1).cast("string")).alias("evidence_id"), m["kind"].alias("kind"), file.alias("file"), (line_start + m["at"]).alias("line"),
        F.regexp_replace(F.element_at(lines, m["at"] + 1), r"^\s+|\s+$", "").alias("expression"), F.create_map(F.lit("signal"), m["signal"], F.lit("match_index"), m["nth"].cast("string")).alias("facts"),
    ))


REGION = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("code", T.StringType())]))


@F.arrow_udf(REGION)
def function_regions(source: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("code", pa.string())]))
    return pa.array([None if s is None else [{"name": f.name, "line_start": f.line_start, "line_end": f.line_end, "code": f.code} for f in functions(s)] for s in source.to_pylist()], kind)


def counts(code: Column) -> dict[str, Column]:
    """<signal>_count of each pattern."""
    return {f"{k}_count": F.regexp_count(code, F.lit(p)).cast("double") for k, (_, p) in PATTERNS.items()}


def derived(n: dict[str, Column], code: Column, lines: Column) -> dict[str, Column]:
    """Features that rest on several signals or on the text."""
    return {
        "function_length": lines.cast("double"),
        "external_input_to_sink": ((n["input_source_count"] > 0) & (n["dangerous_sink_count"] > 0)).cast("double"),
        "released_then_accessed": released_then_accessed(code).cast("double"),
        "guard_density": n["bounds_guard_count"] / F.greatest(F.lit(1.0), n["memory_api_count"] + n["array_access_count"]),
        "toctou_pair": (F.rlike(code, F.lit(FILE_CHECK)) & F.rlike(code, F.lit(FILE_USE))).cast("double"),
    }


def risk(n: dict[str, Column]) -> Column:
    """All signals, twice each of the three pairs, less guards and locks; not below 0. Null where there is no signal."""
    every = F.lit(0.0)
    for k in PATTERNS:
        every = every + n[f"{k}_count"]
    total = every + 2 * (n["external_input_to_sink"] + n["released_then_accessed"] + n["toctou_pair"]) - n["bounds_guard_count"] - n["lock_signal_count"]
    return F.when(every > 0, F.greatest(F.lit(0.0), total))


def analyse(files: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates of files (case_id, file, source), the riskiest first: functions with a signal, with their features and
    the evidence of every match."""
    r = files.select("case_id", "file", F.explode(function_regions("source")).alias("f")).select("case_id", "file", "f.*")
    r = r.withColumns(counts(F.col("code")))
    n = {f"{k}_count": F.col(f"{k}_count") for k in PATTERNS}
    r = r.withColumns(derived(n, F.col("code"), F.col("line_end") - F.col("line_start") + 1))
    digest = F.sha1(F.concat_ws(":", "case_id", "file", "name", F.col("line_start").cast("string")))
    r = r.withColumns({"digest": F.substring(digest, 1, 12), "function": F.col("name")})
    r = r.withColumn("evidence", evidence(F.col("code"), F.col("file"), F.col("line_start"), F.col("digest")))
    out = r.withColumns({"score": risk(n | {k: F.col(k) for k in ("external_input_to_sink", "released_then_accessed", "toctou_pair")}), "candidate_id": F.concat(F.lit("C-"), F.col("digest"))}).where("score IS NOT NULL").drop("digest")
    out = out.orderBy(F.desc("score"), "file", "line_start", "candidate_id")
    return out if most is None else out.limit(most)
