"""Causes of findings: small and large places against the pairs, and how much fusing moves."""

import random

from evidark.operators import findings
from evidark.plans import catalog
from tests.test_cases import shuffled_and_written

KIND = "key string, candidate_id string, file string, function string, line_start int, line_end int, sink string, evidence_ids array<string>, trigger_path array<string>"


def roots(rows):
    """The smallest key on one cause by all pairs."""
    low = {r[0]: r[0] for r in rows}
    near = lambda a, b: None not in (a[4], a[5], b[4], b[5]) and a[4] <= b[5] + 2 and b[4] <= a[5] + 2
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[1:4] == b[1:4] and (near(a, b) or (a[6] and b[6] and a[6].lower() == b[6].lower()) or set(a[7] or ()) & set(b[7] or ()) or set(a[8] or ()) & set(b[8] or ()))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_places_small_and_large(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        start = rng.choice([None, *[rng.randint(1, 400)] * 9])
        rows.append((f"k{rng.random():.9f}", f"c{rng.choice([0, 0, 0, 1, 2, 3 + i])}", "a.c", rng.choice([None, "f"]), start, start and start + rng.randint(0, 3), rng.choice(["", "", None, f"s{i % 40}", f"S{i % 40}"]), rng.choice([None, [], [f"e{rng.randint(0, 60)}"]]), rng.choice([[], [], [f"p{rng.randint(0, 60)}", "q" + str(i)]])))
    f = spark.createDataFrame(rows, KIND)
    want = roots([(*r[:3], r[3] or "", *r[4:]) for r in rows])
    for most in (10_000, 20):
        assert {r.key: r.root for r in findings.caused(f, most=most).collect()} == want


def test_fusing_deals_findings_by_their_place(spark):
    """No table of links: what is moved is a few times the findings."""
    for name, most in (("finding_components", 500_000), ("fuse_groups", 900_000), ("fuse_unnumbered", 1_500_000)):
        assert shuffled_and_written(spark, lambda: catalog.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()) < most, name
