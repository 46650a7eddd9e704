"""SimHash: fingerprints and components against brute force, crowded variants, edge rows."""

import random

import numpy as np
import pytest
import xxhash

from evidark.llm import simhash
from evidark.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable, for (id, fp) rows."""
    fps = sorted({f for _, f in prints})
    group = {f: f for f in fps}
    def find(f):
        while group[f] != f:
            f = group[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in prints}


@pytest.mark.parametrize("text", ["", None, " \n", "one", "One two", "a b c", "A b C d É f g", "x " * 70000, "näïve ünd straße\tq\x0bz"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def walk(rng, start, n, most):
    out = [start]
    while len(out) < n:
        f = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, most)):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize("large", [64, 2])
def test_components_of_fingerprints(spark, large):
    rng = random.Random(4)
    fps = [f for _ in range(12) for f in walk(rng, rng.getrandbits(64), 25, 4)] + [0, 1, 2**64 - 1] + walk(rng, rng.getrandbits(64), 150, 3)
    prints = [(i if i % 17 else None, f) for i, f in enumerate(fps)]
    signed = [(d, f - (f >> 63 << 64)) for d, f in prints]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = simhash.near_duplicates(spark, df, large).collect()
    want = brute_components(prints)
    assert len(got) == len(set(fps))
    for r in got:
        f = r.fp % 2**64
        assert {r.component_id} == {want[d, g] for d, g in prints if g == f}


def test_whole_query_on_texts(spark, tmp_path):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(8)]
    texts = [None, "", "  ", *base, *base, *[b + " end" for b in base]]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(spark, str(tmp_path)).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    want = brute_components(prints)
    assert got == {d: (f"{f:016x}", want[d, f]) for d, f in prints}
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op7_simhash_near_dedup(spark, str(tmp_path)).count() == 0


def test_long_paths_contract(spark):
    n = 400
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(5, 5)]
    got = components(spark, spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [100] * 4
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
