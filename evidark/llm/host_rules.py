"""Host-level quality rules.

Rules are tried on every document; their failures are summed by host; each host's rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts themselves (method of moments); a host whose shrunk rate of any rule
passes ``MOST`` is rejected, and with it its documents. Documents name their host in the column ``source``.

Null and empty texts have no words, and so fail; a null host is a host of its own. Rows are judged one by one, so
repeated rows and null ids are kept as they are. An empty table gives no rows. Only sums by host are shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidark.llm.common import as_bytes, table, whole_row, written

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words
MOST_SYMBOLS = 10  # percent of characters in words
MOST_DUP_LINES = 10  # percent of words, one a line
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

#: A host is rejected when its shrunk rate of failures of one rule is above this.
MOST = 0.6
RULES = ("short", "repeats", "symbols", "lines")
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first one included."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    again = np.fromiter((times[g] > 1 for g in grams), bool, len(grams))
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """FIELDS of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return (
        len(words),
        len(b"".join(words).decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FIELDS]))
def text_counts(texts: pa.Array) -> pa.Array:
    rows = np.array([counts(t) for t in as_bytes(texts)], np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=list(FIELDS))


def failures(c: str) -> dict[str, Column]:
    """Whether the counts in the struct column ``c`` fail each rule."""
    n = {f: F.col(f"{c}.{f}") for f in FIELDS}
    return {
        "short": n["n_words"] < LEAST_WORDS,
        "repeats": 100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"],
        "symbols": 100 * n["n_symbols"] > MOST_SYMBOLS * n["word_chars"],
        "lines": 100 * n["n_dup_lines"] > MOST_DUP_LINES * n["n_words"],
    }


def base_failed(c: str) -> Column:
    failed = failures(c)
    return failed["short"] | failed["repeats"]


def host_verdicts(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """host, rejected and the struct rates (by rule, shrunk), one row a host. ``counted`` has host and the struct counts."""
    failed = failures("counts")
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.count_if(failed[r]).cast("double").alias(r) for r in RULES])
    hosts = written(spark, hosts, "hosts")
    n = F.col("n")
    moments = [F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).cast("double").alias("hosts")]
    for r in RULES:
        moments += [F.sum(r).alias(f"{r}_f"), F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_ff")]
    row = hosts.agg(*moments).select(*[prior(r).alias(r) for r in RULES]).first()  # one row of sums over hosts
    rates = {r: shrunk(F.col(r), n, row[r]["alpha"], row[r]["strength"]) for r in RULES}
    return hosts.select("host", any_of([rate > MOST for rate in rates.values()]).alias("rejected"), F.struct(*[rate.alias(r) for r, rate in rates.items()]).alias("rates"))


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def prior(rule: str) -> Column:
    """alpha and beta by moments: the spread of the hosts' rates beyond what their sample sizes explain.

    With n documents on k hosts: mean m; between-host variance v of the one-way random-effects estimator;
    alpha + beta = m(1 - m) / v - 1, held between 1 and 1,000 documents.
    """
    n, k = F.col("n"), F.col("hosts")
    m = F.try_divide(F.col(f"{rule}_f"), n)
    between = F.col(f"{rule}_ff") - n * m * m
    within = F.col(f"{rule}_f") - F.col(f"{rule}_ff")
    v = F.try_divide(between - (k - 1) * F.try_divide(within, n - k), n - F.try_divide(F.col("nn"), n))
    strength = F.coalesce(F.try_divide(m * (1 - m), F.when(v > 0, v)) - 1, F.lit(1000.0))
    strength = F.least(F.greatest(strength, F.lit(1.0)), F.lit(1000.0))
    return F.struct((strength * m).alias("alpha"), strength.alias("strength"))


def shrunk(failed: Column, n: Column, alpha: float | None, strength: float | None) -> Column:
    return (failed + F.lit(alpha).cast("double")) / (n + F.lit(strength).cast("double"))


def with_verdict(docs: DataFrame, hosts: DataFrame) -> DataFrame:
    """``docs`` (with host) with their host's rejected and rates. A hot host is split by adaptive execution if ``hosts`` is too large to broadcast."""
    docs, hosts = docs.alias("d"), hosts.alias("h")
    return docs.join(hosts, F.col("d.host").eqNullSafe(F.col("h.host"))).select("d.*", "h.rejected", "h.rates")


def op1_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = written(spark, docs.select("doc_id", F.col("source").alias("host"), text_counts(F.col("text").cast("string")).alias("counts")), "counts")
    judged = with_verdict(counted, written(spark, host_verdicts(spark, counted), "verdicts"))
    rates = [F.round(f"rates.{r}", 6).alias(f"host_{r}") for r in RULES]
    return judged.select("doc_id", *[f"counts.{f}" for f in FIELDS], base_failed("counts").alias("base_failed"), (~base_failed("counts") & ~F.col("rejected")).alias("kept"), *rates)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass: all columns of ``docs``."""
    counted = docs.select(whole_row(docs).alias("row"), F.col("source").alias("host"), text_counts(F.col("text").cast("string")).alias("counts"))
    counted = written(spark, counted, "counted")
    hosts = written(spark, host_verdicts(spark, counted), "verdicts").where("rejected").select("host", "rejected").alias("h")
    passed = counted.where(~base_failed("counts")).alias("d").join(hosts, F.col("d.host").eqNullSafe(F.col("h.host")), "left_anti")
    return passed.select("row.*")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``op1_host_quality_rules``."""
    word = r"[^\x20\x09-\x0D]+"
    sums = ", ".join(f"sum(CASE WHEN {r} THEN 1.0::DOUBLE ELSE 0 END) AS {r}" for r in RULES)
    moments = ", ".join(f"sum({r}) AS {r}_f, sum({r} * {r} / n) AS {r}_ff" for r in RULES)
    priors = ", ".join(
        f"""CASE WHEN n > nn / n AND n > hosts AND {r}_ff - {r}_f * {r}_f / n - (hosts - 1) * ({r}_f - {r}_ff) / (n - hosts) > 0 THEN
        least(greatest(({r}_f / n) * (1 - {r}_f / n) / (({r}_ff - {r}_f * {r}_f / n - (hosts - 1) * ({r}_f - {r}_ff) / (n - hosts)) / (n - nn / n)) - 1, 1.0), 1000.0) ELSE 1000.0 END AS {r}_s, {r}_f / n AS {r}_m"""
        for r in RULES
    )
    rates = ", ".join(f"({r} + {r}_s * {r}_m) / (n + {r}_s) AS {r}" for r in RULES)
    bad = " OR ".join(f"r.{r} > {MOST}" for r in RULES)
    told = ", ".join(f"round(r.{r}, 6) AS host_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT rid, regexp_extract_all(text, '{word}') AS ws FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range({WINDOW})) AS k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY rid),
base AS (SELECT d.rid, d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
tried AS (SELECT *, n_words < {LEAST_WORDS} AS short, 100 * n_repeat_words > {MOST_REPEATED} * n_words AS repeats,
  100 * n_symbols > {MOST_SYMBOLS} * word_chars AS symbols, 100 * n_dup_lines > {MOST_DUP_LINES} * n_words AS lines FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM tried GROUP BY source),
every AS (SELECT sum(n) AS n, sum(n * n) AS nn, count(*)::DOUBLE AS hosts, {moments} FROM hosts),
priors AS (SELECT n, {priors} FROM every),
rates AS (SELECT source, {rates} FROM (SELECT hosts.*, priors.* EXCLUDE (n) FROM hosts, priors))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, t.short OR t.repeats AS base_failed,
  NOT (t.short OR t.repeats) AND NOT ({bad}) AS kept, {told}
FROM tried t JOIN rates r ON r.source IS NOT DISTINCT FROM t.source
"""
