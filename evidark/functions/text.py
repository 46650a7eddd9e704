"""Text of code and messages: tokens, signals, comments, digests, urls, JSON answers."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def signals(text: Column, patterns: dict[str, str]) -> list[Column]:
    """One count a pattern, natively; 0 for null."""
    return [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias(n) for n, p in patterns.items()]


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of ``least`` ASCII letters, digits or underscores, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_]{{{least},}})"), 1), F.lower))


def token_overlap(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id, shared, rank: for each query the entries that share most distinct tokens.

    Queries have query_id and text, entries entry_id and text. Tokens that most entries hold are joined like all others;
    counts are combined before they are shuffled.
    """
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))
    e = entries.select("entry_id", F.explode(tokens(F.col("text"))).alias("token"))
    shared = q.join(e, "token").groupBy("query_id", "entry_id").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "entry_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def canonical_hash(text: Column) -> Column:
    return F.sha2(F.lower(collapsed(text)), 256)


def url_parts(url: Column) -> Column:
    """struct(scheme, host, path, query)."""
    return F.struct(
        F.regexp_extract(url, r"^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
    )


def json_object(content: Column) -> Column:
    """The text of a JSON object inside code fences or bare; null where there is none."""
    bare = F.trim(F.regexp_replace(content, r"^\s*```[a-z]*\s*|\s*```\s*$", ""))
    return F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull(), bare)


def matching_lines(texts: DataFrame, key: str, pattern: str, most: int | None = None) -> DataFrame:
    """key, line_no (from 1), line: lines that match, the first ``most`` of each text."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.rlike("line", F.lit(pattern)))
    out = lines.select(key, (F.col("at") + 1).alias("line_no"), "line")
    if most is None:
        return out
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("nth") <= most).drop("nth")


def brace_depth(texts: DataFrame, key: str, open_: str = "{", close: str = "}") -> DataFrame:
    """key, line_no, depth after each line: running difference of opening and closing marks."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    count = lambda mark: F.length("line") - F.length(F.replace("line", F.lit(mark)))
    depth = F.sum(count(open_) - count(close)).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select(key, (F.col("at") + 1).alias("line_no"), depth.alias("depth"))


_C_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_IDENTIFIER = re.compile(r"\b[A-Za-z_]\w*\b")


def without_comments(code: str) -> str:
    """C comments blanked so that every line and column stays; quoted text is left alone."""
    blank = lambda m: m[0] if m[0][0] in "\"'" else "".join("\n" if c == "\n" else " " for c in m[0])
    return _C_TOKEN.sub(blank, code)


def comments_only(code: str) -> str:
    """The other view: everything but comments blanked."""
    out, at = [], 0
    for m in _C_TOKEN.finditer(code):
        out.append(re.sub(r"[^\n]", " ", code[at : m.start()]))
        out.append(re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "\"'" else m[0])
        at = m.end()
    out.append(re.sub(r"[^\n]", " ", code[at:]))
    return "".join(out)


def alias(name: str) -> str:
    """A neutral name as long as ``name``: digits of its digest after a letter."""
    digits = str(int(hashlib.sha256(name.encode()).hexdigest(), 16))
    return ("v" + digits)[: max(1, len(name))]


TELLING = re.compile(r"(?i)\b\w*(?:good|bad|cwe|flaw|fix)\w*\b")


def sanitized(code: str) -> str:
    """Comments blanked and identifiers that tell the answer renamed alike everywhere, lengths kept."""
    return TELLING.sub(lambda m: alias(m[0]) if _IDENTIFIER.fullmatch(m[0]) else m[0], without_comments(code))


def _arrow(f):
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


strip_comments = _arrow(without_comments)
keep_comments = _arrow(comments_only)
sanitize = _arrow(sanitized)
