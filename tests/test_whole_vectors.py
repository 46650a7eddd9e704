"""The softmax router reads every component and predicts every row."""

import numpy as np

from evidark.plans import catalog


def test_label_in_the_last_component(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        y = int(rng.integers(0, 3))
        v = rng.normal(0, 1, 40)
        v[39] = 4 * y + rng.normal(0, 0.3)
        rows.append((i, v.tolist(), y))
    rows += [(300, None, 0), (301, [0.5] * 3, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["softmax_router"](spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == list(range(302))
    assert all(r.held_out == (r.vec_id % 5 == 0) for r in got)
    assert all(0 < r.p <= 1 for r in got)
    held = [r for r in got if r.held_out and r.vec_id < 300]
    assert len(held) == 60 and np.mean([r.label == r.predicted for r in held]) > 0.9
