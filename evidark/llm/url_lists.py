"""URL filters by a temporal list join; DataFrame operations only.

List entries are dated changes: at a time, a pattern is added to a list ("block" or "allow") or removed from it. A
pattern is a host, which stands for its subdomains too, or a host and a path, which stands for that path and what is
below it. An entry is valid from its change to the pattern's next one, and every capture is judged by the
entries active when it was fetched: the longest active pattern decides, allow over block. A change holds from its own
second on.

Changes and captures of a pattern are put in order of time, and each capture takes the last state that the changes before
it left: one as-of pass over both, whatever dates they hold. The order is dealt by ranges of (pattern, time), so a pattern
with most captures lies in many tasks; what a range leaves is carried to the pattern's next ones by a row for each.
Captures are first reduced to distinct (url, time). A url gives one key for each suffix of its host from two labels on, and
for each path depth that the list has.

A null or unparsable url, or a null time, matches nothing (verdict "none"). Changes without a pattern or time are left
out; of changes at one time, removal comes last. Repeated rows and null ids are kept. Empty tables give no rows, or
captures that nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidark.llm.common import table, whole_row, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def keys(host_: Column, parts: Column, depth: Column) -> Column:
    """Patterns that can match: host suffixes of two labels or more (or the whole host), and paths of up to ``depth``."""
    labels = F.split(host_, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deep = F.least(F.size(parts), depth)
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host_, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host_ != "", F.array_distinct(F.concat(suffixes, paths)))


LISTS = ("allow", "block")


def judge(spark: SparkSession, captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (with url and fetched, in seconds) with verdict, pattern and n_active in the struct ``judged``.

    ``changes``: pattern, list ("allow" or "block"), action ("add" or "remove"), at (seconds).
    """
    told = changes.where(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("list").isin(*LISTS)).select("pattern", "list", "action", F.col("at").cast("long").alias("at")).distinct()
    told = written(spark, told, "changes")
    depth = told.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    distinct = captures.select("url", F.col("fetched").cast("long").alias("at")).where("url IS NOT NULL AND at IS NOT NULL").distinct()
    asked = distinct.withColumn("pattern", F.explode(keys(host(F.col("url")), segments(F.col("url")), F.lit(depth))))
    asked = asked.join(told.select("pattern").distinct(), "pattern", "left_semi")
    none = lambda c: F.lit(None).cast("string").alias(c)
    both = told.select("pattern", "at", "list", "action", none("url")).union(asked.select("pattern", "at", none("list"), none("action"), "url"))
    order = ["at", F.col("url").isNotNull(), "action"]  # at one second: additions, removals, captures
    ranged = both.repartitionByRange("pattern", "at", "url").select("*", F.spark_partition_id().alias("task"))
    ranged = written(spark, ranged, "ordered")
    here = Window.partitionBy("task", "pattern").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    states = [F.last(F.when(F.col("list") == x, F.col("action")), ignorenulls=True).over(here).alias(x) for x in LISTS]
    left = ranged.groupBy("task", "pattern").agg(*[F.max(F.when(F.col("list") == x, F.struct("at", "action"))).alias(x) for x in LISTS])
    earlier = Window.partitionBy("pattern").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("task", "pattern", *[F.last(f"{x}.action", ignorenulls=True).over(earlier).alias(f"{x}_before") for x in LISTS])
    met = ranged.select("task", "pattern", "at", "url", *states).where("url IS NOT NULL").join(carried, ["task", "pattern"])
    active = [F.coalesce(F.coalesce(F.col(x), F.col(f"{x}_before")) == "add", F.lit(False)) for x in LISTS]
    met = met.select("url", "at", "pattern", active[0].alias("allow"), (active[0].cast("long") + active[1].cast("long")).alias("n")).where("n > 0")
    best = F.max(F.struct(F.length("pattern").alias("length"), "allow", "pattern")).alias("best")
    found = met.groupBy("url", "at").agg(best, F.sum("n").alias("n_active"))
    row = captures.select(whole_row(captures).alias("row")).alias("c")
    joined = row.join(found.alias("f"), (F.col("c.row.url") == F.col("f.url")) & (F.col("c.row.fetched").cast("long") == F.col("f.at")), "left")
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow").otherwise("block")
    return joined.select("row", F.struct(verdict.alias("verdict"), F.col("best.pattern").alias("pattern"), F.coalesce("n_active", F.lit(0)).alias("n_active")).alias("judged"))


def digits(text: Column, at: int, n: int) -> Column:
    """A number from ``n`` hexadecimal digits of the text's digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, n), 16, 10).cast("long")


START, DAY = 1_704_067_200, 86_400


def sample_changes(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts, as the tables hold none: half of the patterns are listed, by their digests."""
    h = host(F.col("url"))
    at_host = pages.select(F.explode(keys(h, segments(F.col("url")), F.lit(1))).alias("pattern")).distinct()
    listed = at_host.where(digits(F.col("pattern"), 1, 2) % 2 == 0).withColumn("list", F.when(digits(F.col("pattern"), 3, 2) % 4 == 0, "allow").otherwise("block"))
    first = F.lit(START) + digits(F.col("pattern"), 5, 6) % 300 * DAY
    gone = first + (1 + digits(F.col("pattern"), 11, 6) % 200) * DAY
    back = gone + digits(F.col("pattern"), 17, 6) % 100 * DAY
    rows = F.array(*[F.struct(F.lit(a).alias("action"), t.alias("at")) for a, t in (("add", first), ("remove", gone), ("add", back))])
    return listed.select("pattern", "list", F.explode(rows).alias("x")).select("pattern", "list", "x.action", "x.at")


def op9_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.lit(START) + digits(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 1, 8) % (600 * DAY))
    return judge(spark, captures, sample_changes(pages)).select("row.page_id", "row.fetched", "judged.verdict", "judged.pattern", "judged.n_active")


def _hex(text: str, at: int, n: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, {n}) AS BIGINT)"


ORACLE = f"""
WITH c AS (SELECT row_number() OVER () AS rid, page_id, url, {START} + {_hex("coalesce(CAST(page_id AS VARCHAR), '')", 1, 8)} % {600 * DAY} AS fetched,
  regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', '') AS host,
  list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda s: s <> '') AS parts FROM pages),
k AS (SELECT rid, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    CASE WHEN len(parts) > 0 THEN [host || '/' || parts[1]] ELSE [] END))) AS pattern FROM c WHERE host <> ''),
p AS (SELECT DISTINCT pattern FROM k),
listed AS (SELECT pattern, CASE WHEN {_hex("pattern", 3, 2)} % 4 = 0 THEN 'allow' ELSE 'block' END AS list, {START} + {_hex("pattern", 5, 6)} % 300 * {DAY} AS first FROM p WHERE {_hex("pattern", 1, 2)} % 2 = 0),
gone AS (SELECT *, first + (1 + {_hex("pattern", 11, 6)} % 200) * {DAY} AS gone FROM listed),
back AS (SELECT *, gone + {_hex("pattern", 17, 6)} % 100 * {DAY} AS back FROM gone),
active AS (SELECT rid, k.pattern, list FROM k JOIN back USING (pattern) WHERE (first <= fetched AND fetched < gone) OR (back <= fetched AND back > gone) OR (back = gone AND FALSE)),
best AS (SELECT rid, count(*) AS n_active, arg_max(pattern, (length(pattern), list = 'allow', pattern)) AS pattern, arg_max(list, (length(pattern), list = 'allow', pattern)) AS list FROM active GROUP BY rid)
SELECT page_id, fetched, coalesce(list, 'none') AS verdict, best.pattern AS pattern, coalesce(n_active, 0) AS n_active FROM c LEFT JOIN best USING (rid)
"""
