"""The engine's entities read from the test tables, and the same as DuckDB common table expressions.

``spans`` reads lines of code from ``lineitem``: a part is a case, a supplier's parity a file. Returned rows are known
findings (truths), open ones candidates. ``outcomes`` reads an outcome matrix from ``events``: an event type is an
expert, and a user a candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.sources.session import reachable

#: Experts in their fixed order, by code.
FAMILIES = ("memory_bounds", "lifetime_resource", "integer_overflow", "taint_api", "control_state", "concurrency")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10 + F.col("l_partkey") % 7).cast("int")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return line.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], day).alias("id"),
        F.col("l_partkey").alias("case_id"),
        (F.col("l_suppkey") % 2).cast("int").alias("file"),
        start.alias("line_start"),
        (start + (F.floor("l_quantity") % 12).cast("int")).alias("line_end"),
        ((F.col("l_extendedprice") % 1000) / 1000).alias("score"),
        F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("expert"),
        F.col("l_suppkey").alias("project"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where(F.col("flag") == "R")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where((F.col("status") == "O") & (F.col("flag") != "R"))


_NAMES = ", ".join(f"'{f}'" for f in FAMILIES)
SPANS = f"""
spans AS (SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS id,
  l_partkey AS case_id, CAST(l_suppkey % 2 AS INTEGER) AS file, CAST(l_linenumber * 10 + l_partkey % 7 AS INTEGER) AS line_start,
  CAST(l_linenumber * 10 + l_partkey % 7 + CAST(floor(l_quantity) AS INTEGER) % 12 AS INTEGER) AS line_end,
  (l_extendedprice % 1000) / 1000 AS score, [{_NAMES}][l_suppkey % 6 + 1] AS expert, l_suppkey AS project, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem),
truths AS (SELECT * FROM spans WHERE flag = 'R'),
candidates AS (SELECT * FROM spans WHERE status = 'O' AND flag <> 'R'),
pairs AS (SELECT c.id AS candidate_id, t.id AS truth_id, c.case_id, c.file, c.score, c.line_start, c.line_end, t.line_start AS t_start, t.line_end AS t_end, t.expert AS t_expert, c.expert AS c_expert
  FROM candidates c JOIN truths t ON c.case_id = t.case_id AND c.file = t.file AND c.line_start <= t.line_end AND c.line_end >= t.line_start)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and event type: the expert's outcome on the candidate."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("assignment")).agg(
        (F.max("value") > 60).alias("success"),
        (F.min("value") < 0.5).alias("false_positive"),
        (F.count(F.lit(1)) % 3).cast("int").alias("unsupported"),
        F.bround(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / 1000, 6).alias("cost"),
        F.bround(F.least(F.lit(1.0), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 8) / 40), 6).alias("probability"),
        F.count(F.lit(1)).alias("tokens"),
    )


OUTCOMES = """
outcomes AS (SELECT user_id AS candidate_id, event_type AS assignment, max(value) > 60 AS success, min(value) < 0.5 AS false_positive,
  CAST(count(*) % 3 AS INTEGER) AS unsupported, round_even(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / 1000, 6) AS cost,
  round_even(least(1.0, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 8) / 40), 6) AS probability, count(*) AS tokens
  FROM events GROUP BY user_id, event_type)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both labels and a confidence taken from their length."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = F.bround(F.least(F.col("n_chars") / 20000.0, F.lit(1.0)), 6)
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("p", p)


LABELLED = """
labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, round_even(least(d.n_chars / 20000.0::DOUBLE, 1.0), 6) AS p
  FROM documents d JOIN labels l USING (doc_id))
"""
