"""The language model counts every pair of neighbouring words, against a count by hand."""

from collections import Counter
from functools import partial

import numpy as np
import pytest

from evidark.llm import bilinear


def parts_of(spark, df):
    """What scoring learns of ``df``: head, probabilities of units, places' weights, and all of its words and their numbers."""
    rows = bilinear.written(spark, df.select("doc_id", "training", "text").mapInArrow(partial(bilinear.encoded, size=bilinear.ROW), bilinear.ROWS), "tokens")
    head = bilinear.head_of(spark, rows)
    shared = spark.sparkContext.broadcast(head)
    chance = [(10.0 ** bilinear.log_table(bilinear.train(p))).astype(np.float32) for p in bilinear.unit_pairs(rows, shared)]
    return head, chance, bilinear.place_weights(rows, shared, spark.sparkContext.broadcast(chance))


def unit_of(head, word):
    key = np.array([bilinear.number(word)])
    return int(head.units(key, head.find(key))[0])


def by_hand(docs, head, chance, weights):
    """Scores and bases by the formulas, with counts from plain counters."""
    c, pairs, out = Counter(), Counter(), {}
    lines = [(i, [b"\n", b"\n", *((t or "").lower().encode().split()), b"\n"], learnt) for i, t, learnt in docs]
    for _, words, learnt in lines:
        if learnt:
            c.update(words[2:])
            pairs.update(zip(words[1:], words[2:]))
    n, v = sum(c.values()), len(c)
    units = {w: unit_of(head, w) for _, words, _ in lines for w in words}
    size, kinds = Counter(), Counter()
    for w, k in c.items():
        if units[w] >= bilinear.WORDS:
            size[units[w]] += k
            kinds[units[w]] += 1
    for i, words, _ in lines:
        total = base = 0.0
        for h2, h1, w in zip(words, words[1:], words[2:]):
            u = units[w]
            p = sum(x * t[units[h], u] for x, t, h in zip(weights, chance, (h1, h2)))
            if u >= bilinear.WORDS:
                p *= (c[w] + 0.5) / (size[u] + 0.5 * (kinds[u] + 1))
            total += np.log10((pairs[h1, w] + bilinear.PRIOR * p) / (c[h1] + bilinear.PRIOR))
            base += np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
        out[i] = (total, base, sum(c[w] > 0 for w in words[2:]))
    return out, n


@pytest.mark.parametrize("frequent, row, keys", [(2_000_000, 400_000, 2_000_000), (1_500, 700, 3_000)])
def test_scores_by_hand(spark, monkeypatch, frequent, row, keys):
    for name, x in (("FREQUENT", frequent), ("ROW", row), ("KEYS", keys), ("STEPS", 12)):  # 1,500: most words here are not frequent
        monkeypatch.setattr(bilinear, name, x)
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(900)]
    odd = [f"odd{i}xx" for i in range(600)]  # one class by their last two bytes
    docs = [(i, " ".join(common[int(k)] for k in rng.zipf(1.3, 60) % 900), i % 5 > 0) for i in range(150)]
    docs += [(200 + i, f"{odd[2 * i]} {odd[2 * i + 1]}", True) for i in range(300)]
    docs += [(600, f"{odd[0]} {odd[1]}", False), (601, f"{odd[0]} {odd[3]}", False), (602, "never seen", False), (603, "", False), (604, None, True)]
    docs += [(605, " ".join(["Same"] * 3000), True), (606, " ".join(common) * 2, False)]  # longer than a row
    df = spark.createDataFrame(docs, "doc_id long, text string, training boolean").repartition(3)
    got = {r.doc_id: r for r in bilinear.lm_scores(spark, df).collect()}
    head, chance, weights = parts_of(spark, df)
    want, n = by_hand(docs, head, chance, weights)
    assert abs(weights.sum() - 1) < 1e-6 and (weights > 0).all()
    assert len(got) == len(docs) and all(got[i].held_out != learnt and got[i].n_tokens == len((t or "").split()) + 1 and got[i].train_tokens == n for i, t, learnt in docs)
    for i, (score, base, known) in want.items():
        assert abs(got[i].score - score) < 1e-3 + 1e-5 * abs(score) and abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].n_known == known
    # the same two words: their base and classes are alike, only the pair tells which was seen
    assert abs(got[600].base_score - got[601].base_score) < 1e-9 and got[600].score > got[601].score + 0.02


def test_chances_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "STEPS", 12)
    texts = ["a b c", "b a", "a b", "c"]
    head, chance, weights = parts_of(spark, spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, training boolean"))
    words = [b"a", b"b", b"c", b"\n"]
    assert sorted(unit_of(head, w) for w in words) == [0, 1, 2, 3] and unit_of(head, b"\n") == 0
    pairs = Counter(p for t in texts for p in zip([b"\n", *t.encode().split()], [*t.encode().split(), b"\n"]))
    c = Counter(w for t in texts for w in [*t.encode().split(), b"\n"])
    for h1 in words:
        for h2 in words:
            prior = sum(x * t[unit_of(head, h)] for x, t, h in zip(weights, chance, (h1, h2)))
            p = [(pairs[h1, w] + bilinear.PRIOR * prior[unit_of(head, w)]) / (c[h1] + bilinear.PRIOR) for w in words]
            rest = prior[4:].sum() * bilinear.PRIOR / (c[h1] + bilinear.PRIOR)
            assert abs(sum(p) + rest - 1) < 1e-5


def test_units_come_from_training_counts(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "WORDS", 3)
    docs = [(1, "a a b b c", True), (2, "z z z z z z z z", False), (3, "b", True)]
    rows = bilinear.written(spark, spark.createDataFrame(docs, "doc_id long, text string, training boolean").select("doc_id", "training", "text").mapInArrow(partial(bilinear.encoded, size=bilinear.ROW), bilinear.ROWS), "tokens")
    head = bilinear.head_of(spark, rows)
    assert bilinear.number(b"z") not in head.key.tolist() and (head.tokens, head.distinct) == (8, 4)
    assert sorted(head.unit.tolist())[:3] == [0, 1, 2] and unit_of(head, b"c") >= 3


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "STEPS", 3)
    assert bilinear.lm_scores(spark, spark.createDataFrame([], "doc_id long, text string, training boolean")).collect() == []
    nothing_learnt = spark.createDataFrame([(None, "a b", False), (None, "a b", False)], "doc_id long, text string, training boolean")
    got = bilinear.lm_scores(spark, nothing_learnt).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(None, 3, 0, 0)] * 2 and np.isfinite([r.score for r in got]).all()


def test_packed_numbers():
    rng = np.random.default_rng(8)
    c = np.concatenate([rng.integers(0, 300, 500), [10**15, 254, 255, 256]])
    assert (bilinear.opened_counts(bilinear.packed_counts(c), len(c)) == c).all()
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    width = 2**64 // 7 + 1
    bucket = (keys // np.uint64(width)).astype(np.int64)
    back = bilinear.opened_keys(bilinear.packed_keys(keys, bucket, width).tobytes())
    assert len(set(zip(bucket.tolist(), back.tolist()))) == 1000 and all((np.diff(back[bucket == b]) > 0).all() for b in range(7))
