"""Fingerprints and leakage clusters read whole texts: equal openings alone link nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evidark.functions import text
from evidark.operators import splits
from evidark.plans import catalog

OPENING = "Licensed under the Apache License, Version 2.0. "


def test_texts_with_one_opening_are_not_copies(spark, tmp_path):
    texts = [OPENING + "one  body", OPENING + "another body", OPENING.upper() + "ONE\nbody ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.copies) for r in catalog.queries()["fingerprint_dedup"](spark, str(tmp_path)).collect())
    assert got == [(0, 2), (1, 1), (3, 1)]


def brute_clusters(rows):
    root = {k: k for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, ta, ha in rows:
        for b, tb, hb in rows:
            if (ta is not None and ta == tb) or (ha is not None and ha == hb):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in root}


@pytest.mark.parametrize("seed", range(3))
def test_leakage_clusters_by_brute_force(spark, seed):
    pick = lambda i, what, n: int(hashlib.md5(f"{seed}{i}{what}".encode()).hexdigest(), 16) % n
    pages = [(i, None if i == 7 else f"http://h{chr(97 + pick(i, 'h', 25))}.example.com/en/{pick(i, 'n', 9999)}", None if i == 7 else OPENING + f" body {pick(i, 't', 30)}") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = splits.leakage_clusters(df, "page_id", splits.template_group(F.col("url")), text.canonical_hash(F.col("html")))
    want = brute_clusters([(i, u and u.rpartition("/")[0], t) for i, u, t in pages])
    assert {r.page_id: r.cluster for r in got.collect()} == want
    assert 3 < len(set(want.values())) < 40
