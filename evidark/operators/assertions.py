"""Checks that stop a run: each returns its input, or raises with a few of the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """A table does not hold what the next step needs."""


def _none(bad: DataFrame, what: str, shown: int = 3) -> None:
    rows = bad.limit(shown).collect()
    if rows:
        raise DataError(f"{what}: {[r.asDict() for r in rows]}")


def disjoint(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("train", "test")) -> None:
    _none(a.select(key).intersect(b.select(key)), f"{names[0]} and {names[1]} share {key}")


def unseen(test: DataFrame, *fitted: DataFrame, key: str = "project_id") -> None:
    """The test side shares no key with anything that was fitted or tuned on."""
    union = fitted[0].select(key)
    for f in fitted[1:]:
        union = union.union(f.select(key))
    _none(test.select(key).intersect(union), f"test {key} was used before")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    _none(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{keys} is not unique")
    return rows


def complete_matrix(outcomes: DataFrame, group: list[str], assignment: str, expected: list[str]) -> DataFrame:
    """Every group has each expected assignment exactly once and nothing else."""
    per = outcomes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(assignment)).alias("have"))  # a few assignments
    _none(per.where((F.col("n") != len(expected)) | (F.col("have") != F.array(*map(F.lit, sorted(expected))))), "the outcome matrix is not complete")
    return outcomes


def labels_valid(rows: DataFrame) -> DataFrame:
    _none(rows.where(F.col("label_version").isNull() | F.col("case_id").isNull()), "labels lack a version or a case")
    return rows


def merged(parts: dict[str, DataFrame], key: str = "case_id", project: str = "project_id", split: str = "split") -> DataFrame:
    """Union of sources that keeps splits, rejecting keys given twice and projects in several splits."""
    union = None
    for name, df in parts.items():
        one = df.withColumn("origin", F.lit(name))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    unique(union, key)
    _none(union.groupBy(project).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1), "a project is in several splits")
    return union
