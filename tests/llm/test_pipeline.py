"""The pipeline's stages against plain Python on a small corpus with planted cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidark.llm import host_rules, simhash
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "es", "un", "mo"]) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 90))).capitalize() + "." for _ in range(160)]
    junk = [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(40)]
    rows = [(i, t, f"s{i % 4}", 1) for i, t in enumerate(clean)] + [(1000 + i, t, f"s{i % 4}", 0) for i, t in enumerate(junk)]
    rows += [(2000 + i, clean[i], "s1", None) for i in range(10)]  # exact copies
    rows += [(3000 + i, t, "s2", None) for i, t in enumerate([None, "", "a b", "loop it now " * 30])]  # fail the rules
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, _, q in rows if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    rows = corpus()
    passed = [r for r in rows if (c := host_rules.counts((r[1] or "").encode()))[0] >= 10 and 5 * c[4] <= c[0]]
    assert sorted(r.doc_id for r in seen["quality_rules"]) == sorted(r[0] for r in passed)
    left = [r for r in passed if not 1000 <= r[0] < 2000]  # the classifier rejects the shouting ones
    assert sorted(r.doc_id for r in seen["quality_classifier"]) == sorted(r[0] for r in left)
    component = brute_components([(r[0], brute_fingerprint(r[1])) for r in left])
    stay = sorted(r[0] for r in left if component[r[0], brute_fingerprint(r[1])] == r[0])
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"]) == stay
    size = {r[0]: len(r[1].split()) for r in left}
    source = {r[0]: r[2] for r in left}
    sums = Counter()
    for d in stay:
        sums[source[d]] += size[d]
    target, took = brute_targets(dict(sums)), Counter()
    for r in seen["mixing"]:
        took[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    assert all(abs(took[s] - target[s]) <= max(size.values()) for s in target)
    packed = seen["best_fit_packing"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in seen["mixing"])


def test_run_writes_every_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_ids_that_are_null_or_repeated(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "five six seven"), (7, "five six seven"), (7, "five six seven"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = sorted(((r.doc_id, r.text) for r in simhash.dedup_stage(spark, df, "").collect()), key=repr)
    assert got == sorted([(None, "one two three four"), (7, "five six seven"), (9, "")], key=repr)
