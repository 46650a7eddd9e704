"""Mixing: targets by brute force, words near target, at most three copies, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from evidark.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, capped = {}, sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, mix string")
    return mixing.mix(spark, df).select("row.*", F.col("mix").alias("m")).select("doc_id", "source", "size", "m.*").toPandas()


def test_targets_and_words_taken(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b", "c", "d", "e", "f"][min(6, int(rng.exponential(1.5)))], int(rng.integers(0, 60)), "m") for i in range(4000)]
    out = run(spark, rows)
    sizes: dict = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    assert len(out) == len(rows) and out.copies.max() <= 3
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs((g.copies * g["size"]).sum() - want[s]) <= 60


def test_edges(spark):
    out = run(spark, [(None, None, 0, None), (1, "a", 5, None), (1, "a", 5, None), (2, "b", 0, None)])
    assert len(out) == 4 and (out[out["size"] == 0].copies == 0).all()
    assert run(spark, [(1, "a", 0, None)]).copies.tolist() == [0]
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(spark, df).count() == 0


def test_rows_that_are_alike_are_sampled_one_by_one(spark):
    rows = [(None, "a", 10, None)] * 900 + [(5, "a", 10, None)] * 300 + [(i, "b", 10, None) for i in range(4000)]
    out, again = run(spark, rows), run(spark, rows[::-1])
    sizes = {"a": 12_000, "b": 40_000}
    for s, want in brute_targets(sizes).items():
        g = out[out.source == s]
        assert abs((g.copies * g["size"]).sum() - want) <= 10
    shares = [g.copies.mean() for _, g in out[out.source == "a"].groupby(out.doc_id.isna())]
    assert abs(shares[0] - shares[1]) < 0.35  # neither kind goes first
    told = lambda d: sorted(map(repr, d[["doc_id", "source", "copies"]].fillna(-1).itertuples(index=False)))
    assert told(out) == told(again)


def test_probability_follows_size(spark):
    """Large documents are drawn in proportion to their size, the largest for certain; small ones are drawn too."""
    rng = np.random.default_rng(8)
    rows = [(i, "a", int(rng.integers(1, 40)), None) for i in range(6000)] + [(10_000 + i, "a", 5000, None) for i in range(3)] + [(20_000 + i, "b", 30, None) for i in range(3000)]
    out = run(spark, rows)
    own = out[out.source == "a"].copy()
    whole = own.copies.min()
    own["more"] = own.copies - whole
    assert (own[own["size"] == 5000].more == 1).all() and set(own.more) == {0, 1}
    rest = own.target.iloc[0] - whole * own["size"].sum()
    small = own[own["size"] < 5000]
    l = (rest - 15_000) / (small["size"] ** 2).sum()
    for low, high in ((1, 10), (10, 20), (20, 30), (30, 40)):
        g = small[(small["size"] >= low) & (small["size"] < high)]
        want = np.minimum(1, l * g["size"])
        assert abs(g.more.sum() - want.sum()) < 4 * np.sqrt((want * (1 - want)).sum()) + 1
    assert abs((own.copies * own["size"]).sum() - own.target.iloc[0]) <= 40


def test_rows_of_one_id_and_size_keep_their_own_draw(spark):
    """What else tells rows apart decides, not their place: the same texts are taken whatever the order."""
    rows = [(7, "t" * 3 + f"{i:04}" + " w w w", "en", "s", 1) for i in range(300)] + [(i, "x y z w", "en", "u", 1) for i in range(3000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    got = [sorted(r.text for r in mixing.mixing_stage(spark, spark.createDataFrame(x, kind).repartition(k), "").collect()) for x, k in ((rows, 3), (rows[::-1], 5))]
    assert got[0] == got[1] and 0 < len({t for t in got[0] if t.startswith("ttt")}) <= 300
