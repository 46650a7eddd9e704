"""Scenarios made neutral: texts and paths that do not tell the answer, truths and safe functions at their places.

Comments become spaces and names that tell become others of the same length, the same wherever they stand, so every line
and column stays. Texts are rewritten by columns: the pieces between a pattern's matches, and the matches made anew, are
joined again. Spans need no change, as the layout is kept; safe functions are kept apart from truths by an anti-join of
intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidark.operators.assertions import DataError
from evidark.sources.session import written

FILE = ["case_id", "raw_path"]
# What tells the answer, in names and anywhere; endings that a neutral path keeps.
TELLING, LEAK = r"(?i:cwe\d+|bad|good|flaw|fix)", r"(?i)cwe[_-]?\d+|bad|good|flaw|fix"
SUFFIXES = (".cpp", ".cxx", ".cc", ".c")
#: Comments, and quoted texts, in which none begins. An open one goes on to the text's end.
COMMENT_OR_QUOTE = r"""//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"""
TELLING_NAME = rf"\b(?=[A-Za-z_])\w*?{TELLING}\w*"


def rewritten(text: Column, pattern: str, change) -> Column:
    """``text`` with ``change`` applied to each match of a pattern that never matches nothing."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(change(m), F.lit("")))), "")


def without_comments(text: Column) -> Column:
    """Comments as spaces; line ends stay, so does what is quoted."""
    return rewritten(text, COMMENT_OR_QUOTE, lambda m: F.when(F.startswith(m, F.lit("//")), F.regexp_replace(m, r"[^\n]", " ")).when(F.startswith(m, F.lit("/*")), F.regexp_replace(m, r"[^\r\n]", " ")).otherwise(m))


def neutral_name(name: Column) -> Column:
    """A name as long, of digits of the name's digest behind an n."""
    digits = F.translate(F.sha2(name, 256), "abcdef", "012345")
    return F.substring(F.concat(F.lit("n"), F.repeat(digits, F.ceil(F.length(name) / 64).cast("int"))), F.lit(1), F.length(name))


def neutral_names(text: Column) -> Column:
    """``text`` with all names that tell made neutral."""
    return rewritten(text, TELLING_NAME, neutral_name)


def neutral_text(text: Column) -> Column:
    return neutral_names(without_comments(text))


def neutral_paths(sources: DataFrame) -> DataFrame:
    """``FILE``, file: a path for each file from its case's digest and its place among the case's paths."""
    suffix = F.lit(".c")
    for s in SUFFIXES[::-1]:
        suffix = F.when(F.endswith(F.lower("raw_path"), F.lit(s)), s).otherwise(suffix)
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("raw_path"))  # a case's files
    return sources.select(*FILE).distinct().select(*FILE, F.concat(F.lit("case_"), F.substring(F.sha2("case_id", 256), 1, 12), F.lit("/unit_"), F.format_string("%03d", n), suffix).alias("file"))


def leaks(files: DataFrame) -> DataFrame:
    """case_id, file, line (0 for the path), token: what still tells, the first of each line."""
    told = lambda c: F.regexp_extract(c, LEAK, 0)
    lines = files.select("case_id", "file", F.posexplode(F.split("text", "\n")).alias("at", "said")).select("case_id", "file", (F.col("at") + 1).alias("line"), told("said").alias("token"))
    return lines.union(files.select("case_id", "file", F.lit(0), told("file"))).where("token <> ''")


def materialize(scenarios: DataFrame, sources: DataFrame, functions: DataFrame, positives: DataFrame) -> dict[str, DataFrame]:
    """files, truths, negatives, review, warnings and leaks of scenarios.

    scenarios: case_id, split, cwe, expert, leakage_group. sources: case_id, raw_path, text, sha256 (when it was indexed).
    functions: case_id, raw_path, name, line_start, line_end, calls (names called), assignments and accesses (how many).
    positives: case_id, raw_path, line_start, line_end, ordinal.

    A text that is another than indexed, or a positive region in no indexed file, raises. A region's function is the
    smallest that holds its first line. Safe are functions named good, but for those that only call such, and those that
    meet a truth, which are left out with a warning.
    """
    changed = sources.where(~F.sha2("text", 256).eqNullSafe(F.col("sha256"))).select("raw_path").limit(3).collect()
    if changed:
        raise DataError("sources changed after indexing: " + ", ".join(r[0] for r in changed))
    paths = written(neutral_paths(sources), "paths")
    lost = positives.join(paths, FILE, "left_anti").select("raw_path").limit(3).collect()
    if lost:
        raise DataError("regions in sources that are not indexed: " + ", ".join(r[0] for r in lost))
    files = sources.join(paths, FILE).select(*FILE, "file", neutral_text(F.col("text")).alias("text"))
    files = written(files, "files")
    p, f = positives.alias("p"), functions.alias("f")
    holds = (F.col("p.case_id") == F.col("f.case_id")) & (F.col("p.raw_path") == F.col("f.raw_path")) & F.col("p.line_start").between(F.col("f.line_start"), F.col("f.line_end"))
    size = F.struct(F.col("f.line_end") - F.col("f.line_start"), F.col("f.line_start"))
    held = p.join(f, holds).groupBy("p.case_id", "p.ordinal").agg(F.min_by("f.name", size).alias("raw_function"))
    at = positives.join(held, ["case_id", "ordinal"], "left").join(paths, FILE).join(scenarios, "case_id")
    at = at.withColumns({"function": F.coalesce(neutral_names(F.col("raw_function")), F.lit("")), "index": F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal"))})
    at = written(at, "truths")
    digest = F.sha2(F.concat_ws(":", "case_id", "file", F.col("line_start").cast("string"), F.col("index").cast("string")), 256)
    truths = at.select(F.concat(F.lit("truth-"), F.substring(digest, 1, 20)).alias("truth_id"), "case_id", "file", "function", "line_start", "line_end", F.array("expert").alias("experts"), F.array("cwe").alias("cwes"))
    only_calls = (F.size("calls") > 0) & (F.col("assignments") == 0) & (F.col("accesses") == 0) & F.forall("calls", lambda c: F.contains(F.lower(c), F.lit("good")))
    safe = functions.where(F.contains(F.lower("name"), F.lit("good")) & ~F.coalesce(only_calls, F.lit(False))).join(paths, FILE).alias("s")
    meets = (F.col("s.case_id") == F.col("t.case_id")) & (F.col("s.file") == F.col("t.file")) & (F.col("s.line_start") <= F.col("t.line_end")) & (F.col("s.line_end") >= F.col("t.line_start"))
    t = truths.alias("t")
    negatives = safe.join(t, meets, "left_anti").select(*FILE, "file", F.col("name").alias("raw_function"), neutral_names(F.col("name")).alias("function"), "line_start", "line_end")
    negatives = written(negatives, "negatives")
    named = lambda df, text: df.select("case_id", text.alias("warning"))
    place = lambda what, *c: F.concat(F.lit(what), *[x for i, y in enumerate(c) for x in ([F.lit(":")] * (i > 0) + [F.col(y).cast("string")])])
    warnings = named(at.where("raw_function IS NULL"), place("location outside parsed function: ", "raw_path", "line_start"))
    warnings = warnings.union(named(safe.join(t, meets, "left_semi"), place("safe function that meets a truth: ", "raw_path", "name")))
    warnings = warnings.union(named(scenarios.join(negatives.select("case_id").distinct(), "case_id", "left_anti"), F.lit("no safe function was found")))
    told = ["case_id", "split", "cwe", "expert", "leakage_group", "raw_path", "raw_function", "line_start", "line_end", "file", "function"]
    review = at.select(*told).withColumn("label", F.lit("vulnerable")).union(negatives.join(scenarios, "case_id").select(*told).withColumn("label", F.lit("target_cwe_safe")))
    return {"files": files, "truths": truths, "negatives": negatives.drop("raw_path", "raw_function"), "review": review, "warnings": warnings, "leaks": leaks(files)}
