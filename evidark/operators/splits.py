"""Splits that do not leak, duplicates, audits and outcome matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidark.operators import graph
from evidark.operators.assertions import DataError
from evidark.operators.ranking import hash_order


def hash_split(keys: DataFrame, key: str, seed: str = "2026", test: float = 0.15, dev: float = 0.15) -> DataFrame:
    """split of each distinct key: keys in hash order, the first share test, the next dev, at least one each."""
    rows = placed(keys.select(key).distinct().withColumn("_h", hash_order(seed, F.col(key))), "_h", key)
    held = F.greatest(F.lit(1), F.bround(F.col("n") * test).cast("long"))
    tuned = F.greatest(F.lit(1), F.bround(F.col("n") * dev).cast("long"))
    split = F.when(F.col("place") <= held, "test").when(F.col("place") <= held + tuned, "dev").otherwise("train")
    return rows.select(key, split.alias("split"))


def placed(rows: DataFrame, digest: str, *then: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with place (1, 2, ... by hexadecimal digest and ``then``) and n (of all rows) in each group of ``by``, without
    one order in one task.

    Rows are ranked inside the 4,096 ranges of the digest's first three digits; a range starts where those before it end.
    """
    ranged = rows.withColumn("_range", F.substring(digest, 1, 3))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("n"))  # at most 4,096 rows a group
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(digest, *then))
    return ranged.withColumn("_inside", inside).join(starts, [*by, "_range"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def stratified_split(rows: DataFrame, family: str, project: str, seed: str = "2026", share: float = 0.15) -> DataFrame:
    """project, split: in each family, projects in hash order: the last share test, the one before dev, at least one each.

    A project of several families has the split of the last family by name. Families of fewer than three projects raise.
    """
    pairs = rows.select(F.col(family).alias("_family"), F.col(project)).distinct()
    few = pairs.groupBy("_family").count().where("count < 3").select("_family").limit(3).collect()
    if few:
        raise DataError(f"families with fewer than three projects: {', '.join(sorted(str(r[0]) for r in few))}")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("_family").cast("string"), F.col(project).cast("string")), 256)
    p = placed(pairs.withColumn("_h", digest), "_h", project, by=("_family",))
    held = F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("long"))
    split = F.when(F.col("place") > F.col("n") - held, "test").when(F.col("place") > F.col("n") - 2 * held, "dev").otherwise("train")
    return p.groupBy(project).agg(F.max_by(split, F.col("_family")).alias("split"))


def inherited(rows: DataFrame, key: str, original: str, *columns: str) -> DataFrame:
    """``rows`` where a duplicate (``original`` names another row's key) has that row's ``columns``; others keep their own."""
    source = rows.select(F.col(key).alias("_key"), F.struct(*columns).alias("_theirs"))
    both = rows.join(source, F.col(original) == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_key").isNotNull(), F.col("_theirs")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def frozen_manifest(manifest: dict, seed: int = 2026) -> dict[str, set[str]]:
    """Projects of each split in a frozen manifest; an error where it lacks a split, counts or projects, or lets one leak."""
    try:
        items = manifest["splits"]
        projects = {s: {str(x) for x in items[s]["projects"]} for s in ("train", "dev", "test")}
        counts = {s: int(items[s]["case_count"]) for s in projects}
    except (KeyError, TypeError, ValueError) as e:
        raise DataError(f"manifest lacks counts or projects: {e}") from e
    for s, own in projects.items():
        if counts[s] < 1 or not own:
            raise DataError(f"{s} has no cases or projects")
        for other in projects:
            if other > s and own & projects[other]:
                raise DataError(f"projects in {s} and {other}: {', '.join(sorted(own & projects[other])[:10])}")
    return projects


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides hold; an assertion of disjointness expects none."""
    return a.select(key).intersect(b.select(key))


def leaks(rows: DataFrame, attribute: str, split: str = "split") -> DataFrame:
    """Values of ``attribute`` found in more than one split."""
    out = rows.groupBy(attribute).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("n"))  # few splits
    return out.where(F.size("splits") > 1)


def manifest(rows: DataFrame, split: str, project: str, family: str) -> DataFrame:
    """For each split: rows, projects and rows by family (an array sorted by family)."""
    per = rows.groupBy(split, family).agg(F.count(F.lit(1)).alias("n"))
    families = per.groupBy(split).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(family), F.col("n").cast("string")))), ",").alias("families"), F.sum("n").alias("rows"))
    return families.join(rows.groupBy(split).agg(F.countDistinct(project).alias("projects")), split)


def exact_duplicates(rows: DataFrame, by: list[Column], key: str) -> DataFrame:
    """duplicate_of: the smallest key with the same values, null for that row itself."""
    digest = F.sha2(F.concat_ws("\u0000", *[F.coalesce(c.cast("string"), F.lit("\u0001")) for c in by]), 256)
    first = rows.select(digest.alias("digest"), key).groupBy("digest").agg(F.min(key).alias("first"))
    return rows.withColumn("digest", digest).join(first, "digest").withColumn("duplicate_of", F.when(F.col("first") != F.col(key), F.col("first"))).drop("first")


def fingerprint(code: Column) -> Column:
    """Digest of the text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(code, r"[ \t\r\n\f\x0B]+", " ")), 256)


def template_group(name: Column) -> Column:
    """Name without its variant number and what follows, other characters made safe."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[_#]?[0-9]+.*$", ""), r"[^A-Za-z0-9_.]+", "_"))


# Fixed value: the flow variant at the end of a test program's name.
FLOW_VARIANT = r"(?i)_\d{2}(?:[a-z]|_(?:bad|good[a-z0-9_]*))?$"


def variant_group(stem: Column) -> Column:
    """A test program's name without its flow variant, other characters made safe."""
    plain = F.regexp_replace(F.regexp_replace(stem, FLOW_VARIANT, ""), r"[^A-Za-z0-9_.-]+", "-")
    return F.lower(F.regexp_replace(plain, "^-+|-+$", ""))


def leakage_clusters(rows: DataFrame, key: str, template: Column, digest: Column) -> DataFrame:
    """key, cluster (its smallest key): rows of one template or one digest, and what those link, are one cluster.

    Each value's rows link to its first, so no pairs are made; a row with neither value stands alone.
    """
    keys = F.explode(F.array(F.concat(F.lit("t:"), template), F.concat(F.lit("h:"), digest)))
    linked = rows.select(F.col(key).alias("a"), keys.alias("k")).where("k IS NOT NULL")
    edges = linked.join(linked.groupBy("k").agg(F.min("a").alias("b")), "k").select("a", "b")
    alone = rows.select(F.col(key).alias("a"), F.col(key).alias("b"))
    return graph.components(edges.union(alone)).select(F.col("node").alias(key), F.col("root").alias("cluster"))


def matrix(selected: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every selected candidate with every assignment: the keys an outcome matrix must have.

    The assignments are a dimension of a few rows; each candidate is repeated for each.
    """
    return selected.crossJoin(assignments)


def remaining(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def matrix_audit(expected: DataFrame, found: DataFrame, group: list[str], assignment: str) -> DataFrame:
    """status of each group: complete, incomplete, missing or unexpected, with both counts."""
    e = expected.groupBy(*group).agg(F.countDistinct(assignment).alias("expected"))
    f = found.groupBy(*group).agg(F.countDistinct(assignment).alias("found"), F.count(F.lit(1)).alias("rows"))
    both = e.join(f, group, "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when((F.col("found") == F.col("expected")) & (F.col("rows") == F.col("found")), "complete").otherwise("incomplete")
    return both.select(*group, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), status.alias("status"))


def merge_audit(parts: list[tuple[str, DataFrame]], key: str, project: str) -> DataFrame:
    """Of the union of sources: rows and keys by split, keys given twice, and projects found in several splits."""
    union = None
    for name, df in parts:
        one = df.withColumn("part", F.lit(name))
        union = one if union is None else union.unionByName(one)
    twice = union.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    cross = union.groupBy(project).agg(F.countDistinct("split").alias("splits"))
    sums = union.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"))
    checks = twice.agg(F.count_if(F.col("n") > 1).alias("repeated_keys")).crossJoin(cross.agg(F.count_if(F.col("splits") > 1).alias("leaking_projects")))
    return sums.crossJoin(F.broadcast(checks))  # one row


def deficit_assignment(clusters: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    """split of each cluster: the largest first, each to the split that is furthest below its share of the group's rows."""
    import pandas as pd

    def assign(rows):
        rows = rows.sort_values(["size", "cluster"], ascending=[False, True])
        total, have, out = rows["size"].sum(), dict.fromkeys(shares, 0), []
        for size in rows["size"]:
            name = max(shares, key=lambda s: ((shares[s] * total - have[s]) / max(1e-9, shares[s] * total), s))
            have[name] += size
            out.append(name)
        return pd.DataFrame({by: rows[by], "cluster": rows["cluster"], "split": out})

    kinds = dict(clusters.dtypes)
    return clusters.select(by, "cluster", "size").groupBy(by).applyInPandas(assign, f"{by} {kinds[by]}, cluster {kinds['cluster']}, split string")
