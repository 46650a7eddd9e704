"""Neighbours: Hilbert order, exactness on small tables, recall, copies and invalid vectors."""

import numpy as np

from evidark.llm import hilbert


def test_hilbert_order_visits_every_cell_step_by_step():
    for bits, dims in ((2, 2), (3, 2), (2, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        at = hilbert.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), n), default=0)
    ok = {(i, tuple(v)): v for i, v in ok if len(v) == n}
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        best = {}
        for (i, _), v in ok.items():
            for (j, _), w in ok.items():
                if i == q and j != q:
                    s = round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12)
                    best[j] = max(s, best.get(j, -2))
        if best:
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run(spark, rows, every=50, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS class", "0 AS block")
    got = {}
    for r in hilbert.nearest(spark, df, every, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    return got


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(9)] + [(300 + i, rows[3][1]) for i in range(9)] + [rows[7]]
    rows += [(400, None), (450, [0.0] * 6), (500, [float("nan")] + [1.0] * 5), (550, [float("inf")] * 6), (None, rows[0][1]), (600, [None] + [1.0] * 5), (650, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 50, 5)


def test_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(50, [1.0, 2.0])]) == {}


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    got = run(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & {i for i, _ in got[q]})
    assert len(got) == 60 and hit / 300 >= 0.9
