"""Held-out accuracy of the classifier, held-out gain and normalisation of the language model, host priors."""

import numpy as np
import pytest

from evidark.llm import bilinear, host_rules, nbsvm


def test_log_table_is_normalised_and_learns_pairs():
    rng = np.random.default_rng(0)
    n = bilinear.UNITS
    counts = np.zeros((n, n))
    counts[np.arange(200), (np.arange(200) * 7 + 1) % 200] = rng.integers(50, 500, 200)
    table = bilinear.log_table(bilinear.train(counts, dim=32, steps=150))
    assert np.allclose((10.0**table).sum(1), 1)
    joint = counts / counts.sum()
    unigram = np.log10((counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n))
    assert (joint * table).sum() > (joint * unigram[None]).sum() + 0.5


def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.integers(5, 80))).capitalize() + "."
    bad = lambda: rng.choice([" ".join(word() + "###" for _ in range(30)), " ".join([word()] * 20), " | ".join(word() for _ in range(25)), good().upper().replace(" ", "!! ")])
    y = rng.integers(0, 2, 700)
    rows = [nbsvm.features((good() if k else bad()).encode()) for k in y]
    model = nbsvm.fit(rows[:400], y[:400])
    right = [(model.score(r) >= nbsvm.THRESHOLD) == k for r, k in zip(rows[400:], y[400:])]
    assert np.mean(right) > 0.97
    assert 0 <= model.score(nbsvm.features(None)) <= 1


def test_fit_is_the_optimum():
    """Dual coordinate descent against the conditions of optimality, and the ratios against counts by hand."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    y = np.where([(r < 15).sum() > 4 for r in rows], 1, -1)
    y[:4] *= -1
    ratio = nbsvm.log_count_ratio(rows, y)
    up = [1 + sum(j in r for r, k in zip(rows, y) if k == 1) for j in range(40)]
    down = [1 + sum(j in r for r, k in zip(rows, y) if k == -1) for j in range(40)]
    rest = (1 << nbsvm.BITS) - 40
    assert np.allclose(ratio[:40], np.log(np.array(up) / (sum(up) + rest)) - np.log(np.array(down) / (sum(down) + rest)), atol=1e-5)
    w, b = nbsvm.hinge(rows, y, ratio, cost=1.0, passes=3000)
    values = [ratio[r] / np.sqrt(ratio[r] @ ratio[r]) for r in rows]
    margins = np.array([k * (w[r] @ v + b) for r, v, k in zip(rows, values, y)])
    most = {k: len(y) / (2 * (y == k).sum()) for k in (1, -1)}

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(most[k] * max(0.0, 1 - k * (w[r] @ v + b)) for r, v, k in zip(rows, values, y))

    least = primal(w.astype(float), b)
    assert (margins > 0.99).any() and (margins < 0.99).any()
    for _ in range(300):  # the objective is convex: no step near the optimum goes below it
        step = np.zeros(1 << nbsvm.BITS)
        step[:40] = rng.normal(size=40) * 10 ** rng.uniform(-3, 0)
        assert primal(w + step, b + rng.normal() * 10 ** rng.uniform(-3, 0)) > least - 1e-4


def test_repeated_ids_and_absent_documents_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(i, t) for i in range(1, 9) for t in ("b " * i, "a " * i)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 2000)], "doc_id long, quality int")
    seen = []
    fit, nbsvm.fit = nbsvm.fit, lambda rows, y: seen.append(len(rows))
    try:
        nbsvm.learn(docs, labels, most=8)
    finally:
        nbsvm.fit = fit
    assert seen[0] == sum(nbsvm.zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 9))


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0]])
def test_classifier_with_one_class_or_none(labels):
    model = nbsvm.fit([nbsvm.features(b"some words here") for _ in labels], np.array(labels, int))
    share = (sum(labels) + 1) / (len(labels) + 2)
    assert abs(model.score(nbsvm.features(b"any")) - share) < 1e-9


def brute_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= set(range(i, i + 5))
    return len(inside)


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [b"ab"[i : i + 1] for i in rng.integers(0, 2, rng.integers(0, 25))]
        assert host_rules.repeated_words(words) == brute_repeats(words)


def test_bad_host_is_rejected_and_small_ones_are_shrunk(spark):
    good = "a clean text of some twelve words stands here, and it ends."
    rows = [(f"h{i % 20}", good) for i in range(400)] + [("bad", "$$$ " * 9)] * 60 + [("bad", good)] * 5 + [("tiny", "x")]
    docs = spark.createDataFrame([(i, t, h, "e") for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, rejected string")
    kept = host_rules.quality_rules_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == 400 and kept.where("source = 'bad'").count() == 0
