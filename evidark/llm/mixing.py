"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

A source's target is its share by weight of all words, at most ``most`` times its own words; what a capped source gives
up is shared anew by weight (solved in one pass over sources sorted by the level at which they fill up). Every document
of a source gets floor(target / words) certain whole copies. The words that remain are sampled with probability
proportional to size: a document of size s has the inclusion probability p = l s, and those that this would give more
than one are certain; l is found from the source's histogram of sizes, so that the expected words are the rest. Documents
are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and the sample is the start of that
order whose words come nearest to what the certain ones leave. The cut is found from sums over 4096 bins of each source's
order, and only the rows of the cut's bin are ranked row by row, so a source with most rows is never sorted in one task.

u is a digest of the document's id and size, of what else tells it from others (``tell``), and of its number among the
source's rows that are alike in all of these, so reruns agree, and rows without an id, or of one id, are sampled one by one
as any others. Only rows that are not alone in their kind are numbered (by task, so that a kind may hold most rows); they
are alike, so which of them has which number makes no difference. Null text has size 0; documents of size 0 take none. Null
sources are one source, after the others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidark.llm.common import n_words, table, whole_row, written

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096


def unit(doc_id: Column, size: Column, nth: Column, tell: Column) -> Column:
    """A number in (0, 1) from the digest of id, size and number, and of ``tell`` where that is not null."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), nth.cast("string"), tell)
    digits = F.substring(F.md5(said.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source; ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = per.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
    per = per.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    up_to = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.coalesce(F.sum("source_size").over(up_to), F.lit(0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))).alias("open_weight"),
    )
    # the level at the first source that does not fill up when all before it are full; beyond it levels only sink
    level = (F.col("all_size") - most * F.col("capped")) / F.col("open_weight")
    per = per.withColumn("level", F.max(F.when(level <= F.col("full_at"), level)).over(every))
    return per.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


KIND = ["source", "id", "size", "tell"]


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as row, source, id, size, tell and nth: 1, 2, ... among the rows that are alike in all of these."""
    tell = F.col("tell").cast("string") if "tell" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(whole_row(docs).alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("id"), "size", tell.alias("tell"))
    many = written(spark, rows.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KIND), "kinds")

    def met(a: str, b: str) -> Column:
        same = F.lit(True)
        for c in KIND:
            same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return same

    if many.isEmpty():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    alone = rows.alias("r").join(many.alias("m"), met("r", "m"), "left_anti").withColumn("nth", F.lit(1).cast("long"))
    alike = rows.alias("r").join(many.alias("m"), met("r", "m"), "left_semi").withColumn("task", F.spark_partition_id())
    alike = written(spark, alike.withColumn("here", F.row_number().over(Window.partitionBy("task", *KIND).orderBy(F.lit(1)))), "alike")
    by_task = alike.groupBy("task", *KIND).agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("task", *KIND, F.coalesce(F.sum("n").over(Window.partitionBy(*KIND).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = alike.alias("a").join(before.alias("b"), met("a", "b") & (F.col("a.task") == F.col("b.task")))
    return alone.union(placed.select("a.row", *[f"a.{c}" for c in KIND], (F.col("before") + F.col("here")).cast("long").alias("nth")))


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: source_size, target, whole, rest, and how the rest is drawn: a document above the size
    ``above`` is certain, and others have ``l`` times their size as inclusion probability; ``draw`` words are left to them.

    ``sizes``: source, size, n (documents of that size).
    """
    goal = targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    some = F.col("source_size") > 0
    goal = goal.withColumn("whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    words, squares = (F.col("size") * F.col("n")).cast("decimal(38,0)"), F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    steps = sizes.where("size > 0").select("source", "size", F.coalesce(F.sum(words).over(larger), zero).cast("double").alias("certain"), (F.sum(squares).over(Window.partitionBy("source")) - F.coalesce(F.sum(squares).over(larger), zero)).cast("double").alias("square"))
    joined = steps.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).where("rest > 0")
    draw = F.col("rest") - F.col("certain")
    fits = joined.select("g.source", "s.size", draw.alias("draw"), (draw / F.col("square")).alias("l")).where((F.col("l") * F.col("size") <= 1) & (F.col("draw") >= 0))
    best = fits.groupBy("source").agg(F.max_by(F.struct(F.col("size").alias("above"), "l", "draw"), "size").alias("b"))  # the first that fits, from the largest size down
    return goal.alias("g").join(best.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source")), "left").select("g.source", "source_size", "target", "whole", "rest", "b.b.above", "b.b.l", "b.b.draw")


def certain(size: Column) -> Column:
    return F.coalesce(size > F.col("above"), F.lit(False))


def odds(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; the smallest are sampled."""
    return F.when(p < 1, (u / (1 - u)) / (p / (1 - p))).otherwise(0.0)


def bin_of(q: Column) -> Column:
    return F.floor(q / (1 + q) * BINS).cast("int")


def drawn(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (alias r) beside their source's shares, with q: their odds, where they may be drawn and are not certain."""
    u = unit(F.col("r.id"), F.col("r.size"), F.col("r.nth"), F.col("r.tell"))
    both = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    open_ = (F.col("r.size") > 0) & ~certain(F.col("r.size")) & (F.col("draw") > 0)
    return both.withColumn("q", F.when(open_, odds(u, F.col("l") * F.col("r.size"))))


def cut_points(spark: SparkSession, narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``shares`` of each source, and where its sample ends in Pareto order.

    ``narrow`` has source, id, size, tell, nth. A document that is not certain is in the sample if its bin is below
    ``cut_bin``, or is ``cut_bin`` and its (q, id, size, nth) is not after ``last`` (null: none of that bin).
    """
    goal = written(spark, shares(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), weights, most), "shares")
    keyed = drawn(narrow, goal).where("q IS NOT NULL").select("g.source", "draw", "q", "r.id", "r.size", "r.nth", bin_of(F.col("q")).alias("bin"))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("draw").alias("draw"))
    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = bins.withColumn("up_to", F.sum("bin_size").over(in_order)).where((F.col("up_to") >= F.col("draw")) & (F.col("up_to") - F.col("bin_size") < F.col("draw")))
    found = found.select("source", F.col("bin").alias("cut_bin"), (F.col("up_to") - F.col("bin_size")).alias("before"))
    there = keyed.alias("k").join(found.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.bin") == F.col("c.cut_bin")))
    there = there.select("c.source", "cut_bin", "before", "draw", F.struct("q", "id", "size", "nth").alias("last"))
    ends = there.withColumn("end", F.col("before") + F.sum("last.size").over(Window.partitionBy("source").orderBy("last")))  # peers together
    ends = ends.groupBy("source").agg(
        F.first("cut_bin").alias("cut_bin"),
        F.min(F.struct(F.abs(F.col("end") - F.col("draw")).alias("off"), "last")).alias("best"),
        F.min(F.col("draw") - F.col("before")).alias("off_none"),
    )
    ends = ends.select("source", "cut_bin", F.when(F.col("best.off") <= F.col("off_none"), F.col("best.last")).alias("last"))
    return goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.*", "cut_bin", "last")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` (with doc_id, source and size; tell, a text, if more tells rows apart) with source_size, target and copies,
    in the struct ``mix``."""
    rows = numbered(spark, docs)
    points = written(spark, cut_points(spark, rows.select(*KIND, "nth"), weights, most), "cuts")  # one row a source; broadcast if it is small
    joined = drawn(rows, points)
    here = F.struct("q", F.col("r.id").alias("id"), F.col("r.size").alias("size"), F.col("r.nth").alias("nth"))
    sampled = (bin_of(F.col("q")) < F.col("cut_bin")) | ((bin_of(F.col("q")) == F.col("cut_bin")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    copies = F.col("whole") + F.when(certain(F.col("r.size")) | F.coalesce(sampled, F.lit(False)), 1).otherwise(0)
    return joined.select("r.row", F.struct("source_size", "target", F.when(F.col("r.size") > 0, copies).otherwise(0).cast("long").alias("copies")).alias("mix"))


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix(spark, written(spark, docs, "sizes"))
    return out.select("row.doc_id", "row.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("row.size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; all columns of ``docs``."""
    told = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    row = docs.select(whole_row(docs).alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(*told).cast("string").alias("tell"))
    copies = F.col("mix.copies").cast("int")
    return mix(spark, written(spark, row, "sized")).where(copies > 0).select(F.col("row.doc").alias("doc"), F.explode(F.array_repeat(F.lit(0), copies))).select("doc.*")


ORACLE = f"""
WITH sized0 AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
told AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS nth FROM sized0),
sized AS (SELECT *, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || nth), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {2**52}::DOUBLE AS u FROM told),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight FROM per),
levels AS (SELECT *, sum(source_size) OVER () AS all_size, {MOST} * source_size / weight AS full_at,
    coalesce(sum(source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM weighed WINDOW w AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT source, source_size, weight, max(CASE WHEN CAST(all_size - {MOST} * capped AS DOUBLE) / open_weight <= full_at THEN CAST(all_size - {MOST} * capped AS DOUBLE) / open_weight END) OVER () AS level FROM levels),
goal AS (SELECT source, source_size, least({MOST} * CAST(source_size AS DOUBLE), level * weight) AS target FROM leveled),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
hist AS (SELECT source, size, CAST(count(*) AS HUGEINT) AS n FROM sized WHERE size > 0 GROUP BY source, size),
steps AS (SELECT source, size, coalesce(sum(size * n) OVER w, 0) AS certain, sum(size * size * n) OVER (PARTITION BY source) - coalesce(sum(size * size * n) OVER w, 0) AS square
  FROM hist WINDOW w AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fits AS (SELECT s.source, s.size, r.rest - CAST(s.certain AS DOUBLE) AS draw, (r.rest - CAST(s.certain AS DOUBLE)) / CAST(s.square AS DOUBLE) AS l FROM steps s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE r.rest > 0),
first AS (SELECT source, max(size) AS above, arg_max(l, size) AS l, arg_max(draw, size) AS draw FROM fits WHERE l * size <= 1 AND draw >= 0 GROUP BY source),
placed AS (SELECT d.doc_id, d.size, d.nth, r.*, f.draw, coalesce(d.size > f.above, FALSE) AS certain, CASE WHEN d.size > 0 AND NOT coalesce(d.size > f.above, FALSE) AND f.draw > 0 THEN
    CASE WHEN f.l * d.size < 1 THEN (d.u / (1 - d.u)) / ((f.l * d.size) / (1 - f.l * d.size)) ELSE 0 END END AS q
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN first f ON d.source IS NOT DISTINCT FROM f.source),
summed AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, nth) END AS up_to FROM placed),
best AS (SELECT source, arg_min(up_to, abs(up_to - draw)) AS last, min(abs(up_to - draw)) AS off, any_value(draw) AS draw FROM summed WHERE q IS NOT NULL GROUP BY source)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(s.size * (s.whole + CASE WHEN s.certain OR (b.off <= b.draw AND s.up_to <= b.last) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed s LEFT JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""
