"""Unified diffs and stack traces: hunks as rows, reverse application, nearest hunk."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
FRAME = r"#(\d+)\s+0x[0-9a-f]+\s+in\s+(\S+)\s+(\S+?):(\d+)"
HUNKS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("old_start", T.IntegerType()), T.StructField("old_count", T.IntegerType()), T.StructField("new_start", T.IntegerType()), T.StructField("new_count", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))]))


def parsed(diff: str) -> list[dict]:
    """Hunks of a diff, each with the path it changes (the old name, without its a/ prefix)."""
    out, path = [], None
    for line in diff.split("\n"):
        if line.startswith("--- ") and (not out or done(out[-1])):
            path = re.sub(r"^a/", "", line[4:].split("\t")[0].strip())
        elif m := HUNK.match(line):
            out.append({"path": path, "old_start": int(m[1]), "old_count": int(m[2] or 1), "new_start": int(m[3]), "new_count": int(m[4] or 1), "context": m[5], "lines": []})
        elif out and not done(out[-1]) and line[:1] in (" ", "+", "-"):
            out[-1]["lines"].append(line)
        elif out and not done(out[-1]) and line == "":
            out[-1]["lines"].append(" ")
    return out


def done(h: dict) -> bool:
    return sum(x[0] != "+" for x in h["lines"]) >= h["old_count"] and sum(x[0] != "-" for x in h["lines"]) >= h["new_count"]


def reversed_text(fixed: str, hunks: list[dict]) -> str | None:
    """The text before the patch: each hunk's new lines, found nearest to where they should be, become its old ones."""
    lines, shift = fixed.split("\n"), 0
    for h in sorted(hunks, key=lambda h: h["new_start"]):
        new = [x[1:] for x in h["lines"] if x[0] != "-"]
        old = [x[1:] for x in h["lines"] if x[0] != "+"]
        want = max(0, h["new_start"] - 1 + shift)
        places = [i for i in range(len(lines) - len(new) + 1) if lines[i : i + len(new)] == new]
        if not places:
            return None
        at = min(places, key=lambda i: (abs(i - want), i))
        lines[at : at + len(new)] = old
        shift += len(old) - len(new)
    return "\n".join(lines)


@F.arrow_udf(HUNKS)
def parse_hunks(diffs: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.string()), ("old_start", pa.int32()), ("old_count", pa.int32()), ("new_start", pa.int32()), ("new_count", pa.int32()), ("context", pa.string()), ("lines", pa.list_(pa.string()))]))
    return pa.array([None if d is None else parsed(d) for d in diffs.to_pylist()], kind)


@F.arrow_udf(T.StringType())
def reverse_apply(fixed: pa.Array, diffs: pa.Array) -> pa.Array:
    return pa.array([None if f is None or d is None else reversed_text(f, parsed(d)) for f, d in zip(fixed.to_pylist(), diffs.to_pylist())], pa.string())


def stack_frames(output: Column) -> Column:
    """array of struct(depth, function, file, line), natively."""
    part = lambda i: F.regexp_extract_all(output, F.lit(FRAME), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("depth"), part(2).alias("function"), part(3).alias("file"), part(4).alias("line"))
    return F.transform(zipped, lambda x: F.struct(x["depth"].cast("int").alias("depth"), x["function"].alias("function"), x["file"].alias("file"), x["line"].cast("int").alias("line")))


def nearest_hunk(hunks: Column, path: Column, line: Column) -> Column:
    """The hunk of the path (equal, or one the other's ending) whose old start is nearest to the line."""
    same = F.filter(hunks, lambda h: (h["path"] == path) | F.endswith(path, F.concat(F.lit("/"), h["path"])) | F.endswith(h["path"], F.concat(F.lit("/"), path)))
    return F.array_min(F.transform(same, lambda h: F.struct(F.abs(h["old_start"] - line).alias("distance"), h["old_start"].alias("old_start"), h["path"].alias("path"))))
