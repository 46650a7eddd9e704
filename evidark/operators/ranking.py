"""Ranking, quotas and orders. Every order is total: ties end at an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows of a group in each task before it shuffles."""
    return ranked(df, by, *order).where(F.col("rank") <= k)


def best_per_family(df: DataFrame, group: str, family: str, *order: Column) -> DataFrame:
    """The best row of each family of a group, and the families' order by these rows."""
    best = top_k(df, [group, family], 1, *order).drop("rank")
    return ranked(best, [group], *order)


def hard_negatives(df: DataFrame, group: str, positive: Column, most: int, hard: int, *order: Column) -> DataFrame:
    """At most ``most`` rows a group: positives first, but ``hard`` places are kept for the best negatives."""
    df = df.withColumn("positive", positive)
    df = ranked(df, [group, "positive"], *order, name="nth")
    whole = Window.partitionBy(group)
    negatives, positives = F.count_if(~F.col("positive")).over(whole), F.count_if(F.col("positive")).over(whole)
    slots = F.least(F.lit(hard), negatives, F.lit(most))
    taken = F.least(positives, F.lit(most) - slots)
    return df.withColumn("room", F.when(F.col("positive"), taken).otherwise(F.lit(most) - taken)).where(F.col("nth") <= F.col("room")).drop("room")


def entropy(p: Column, log=F.log) -> Column:
    """Sum of -p log p over an array of probabilities; zero probabilities add nothing."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * log(x)).otherwise(0.0))


def adaptive_top_k(scores: DataFrame, group: str, confidence: float = 0.72, margin: float = 0.18, most_entropy: float = 1.0) -> DataFrame:
    """One row a group from (group, family, score): top1, margin, entropy and the one or two families selected.

    Scores are made to sum to 1. One family suffices if it is sure, well ahead and the rest are quiet.
    """
    by = Window.partitionBy(group)
    p = F.coalesce(F.try_divide("score", F.sum("score").over(by)), F.lit(0.0))
    rows = ranked(scores.withColumn("p", p), [group], F.desc("p"), F.asc("family"))
    out = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "family", "p"))).alias("r"))  # one entry a family
    ps = F.transform("r", lambda x: x["p"])
    out = out.select(group, F.col("r")[0]["p"].alias("top1"), (F.col("r")[0]["p"] - F.coalesce(F.try_element_at("r", F.lit(2))["p"], F.lit(0.0))).alias("margin"), entropy(ps).alias("entropy"), F.transform("r", lambda x: x["family"]).alias("families"))
    single = (F.col("top1") >= confidence) & (F.col("margin") >= margin) & (F.col("entropy") <= most_entropy)
    return out.select(group, "top1", "margin", "entropy", F.slice("families", 1, F.when(single, 1).otherwise(2)).alias("selected"))


def running(rows: DataFrame, by: list[str], order: Column, bin_: Column, descending: bool = False, **sums: str) -> DataFrame:
    """``rows`` with <name>_upto: the sum of a column over the rows of the group up to and with each, in the order given.

    ``bin_`` grows with ``order``: rows are summed inside their bins, and bins in one short window, so that no task orders
    a whole group.
    """
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    r = rows.withColumn("_bin", bin_)
    bins = r.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(way(F.col("_bin"))).rowsBetween(Window.unboundedPreceding, -1)
    before = bins.select(*by, "_bin", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy(*by, "_bin").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({f"_in_{k}": F.sum(c).over(inside) for k, c in sums.items()})
    joined = r.join(before, [*by, "_bin"])
    return joined.select(*rows.columns, *[(F.col(f"_{k}") + F.col(f"_in_{k}")).alias(f"{k}_upto") for k in sums])


def round_robin(df: DataFrame, group: str, *order: Column, bin_: Column | None = None) -> DataFrame:
    """position: one row of each group in turn, groups by name.

    With ``bin_``, which grows with the one ``order`` (as in ``running``), no task orders a whole group: for few large ones.
    """
    if bin_ is None:
        rows = ranked(df, [group], *order, name="turn")
    else:
        rows = running(df.withColumn("_one", F.lit(1)), [group], *order, bin_, turn="_one").withColumnRenamed("turn_upto", "turn").drop("_one")
    # one order over all rows is what is asked for: it is made from counts by turn, so no task sees all rows
    turns = rows.groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    before = running(turns, [], F.col("turn"), F.floor(F.col("turn") / 4096), n="n").withColumn("before", F.col("n_upto") - F.col("n"))
    placed = rows.join(before.select("turn", "before"), "turn")
    return placed.withColumn("position", F.col("before") + F.row_number().over(Window.partitionBy("turn").orderBy(group))).drop("before")


def diverse_order(df: DataFrame, group: str, cluster: str, *order: Column) -> DataFrame:
    """turn and repeat of each row: the first row of each cluster comes before any repeat, groups take turns."""
    rows = ranked(df, [group, cluster], *order, name="seen").withColumn("repeat", (F.col("seen") > 1).cast("int"))
    return ranked(rows, [group], F.asc("repeat"), *order, name="turn").drop("seen")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """quota: whole numbers that sum to ``total`` in proportion to the weights; the largest remainders round up."""
    every = Window.partitionBy()
    exact = F.col(weight) * F.lit(total) / F.sum(weight).over(every)
    rows = weights.withColumn("exact", exact).withColumn("floor", F.floor("exact"))
    left = F.lit(total) - F.sum("floor").over(every)
    rows = rows.withColumn("left", left).withColumn("nth", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), F.asc(key))))
    return rows.select(key, weight, (F.col("floor") + (F.col("nth") <= F.col("left")).cast("int")).cast("long").alias("quota"))


def running_budget(df: DataFrame, by: list[str], cost: str, limit: float, *order: Column) -> DataFrame:
    """spent (running sum before and with the row) and admitted: the sum stays within the limit."""
    spent = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", spent).withColumn("admitted", F.col("spent") <= limit)


def budget_admission(df: DataFrame, by: str, limit: float) -> DataFrame:
    """Two-pass admission: rows with ``first`` before the others, each if it still fits; later smaller rows may fit.

    What fits depends on what went in, so it is one ordered pass for each group.
    """
    import pandas as pd

    def admit(key, rows):
        rows = rows.sort_values(["first", "priority", "id"], ascending=[False, False, True])
        left, out = limit, []
        for cost in rows["cost"]:
            fits = cost <= left
            left -= cost if fits else 0
            out.append(fits)
        return pd.DataFrame({by: rows[by], "id": rows["id"], "admitted": out})

    kinds = dict(df.dtypes)
    return df.select(by, "id", "first", "priority", "cost").groupBy(by).applyInPandas(admit, f"{by} {kinds[by]}, id {kinds['id']}, admitted boolean")


def quota_sample(df: DataFrame, caps: dict[str, int], by: str) -> DataFrame:
    """Rows of each ``by`` group taken in order while no column's running count passes its cap."""
    columns = list(caps)

    def take(rows):
        rows, seen, kept = rows.sort_values("id"), {}, []
        for values in rows[columns].itertuples(index=False):
            ks = list(zip(columns, values))
            ok = all(seen.get(k, 0) < caps[k[0]] for k in ks)
            for k in ks if ok else ():
                seen[k] = seen.get(k, 0) + 1
            kept.append(ok)
        return rows[kept]

    narrow = df.select(by, "id", *[c for c in columns if c != by])
    return narrow.groupBy(by).applyInPandas(take, narrow.schema)


def hash_order(seed: str, key: Column) -> Column:
    """The key's place in a fixed shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)
