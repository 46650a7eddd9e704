"""The manifest against plain Python and its SQL: nulls, ties, repeated rows, depths, bucket sizes, tampering."""

import hashlib
import zlib

import duckdb
import pytest

from evidark.llm import merkle, registry

KIND = "doc_id long, source string, lang string, n_chars long, text string, pos long, leaf string, bucket string, n int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """Root, and for each node the (left, right) of every level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            ways[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, nodes = [i // 16 for i in at], [sha("".join(r)) for r in runs]
    return nodes[0], ways


def wanted(rows):
    if not rows:
        return []
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for r, way in zip(by[s], trees[s][1]):
            way = way + up
            tried = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].translate(low))) if tried else leaf(r)
            for a, b in way:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in way)), h, h == root))
    return sorted(out, key=repr)


def table(n_hot=300):
    rows = [(i, "hot", "en", i, f"Text {i} of Some words") for i in range(n_hot)]
    rows += [(i, None, None, None, None) for i in range(17)] + [(None, "hot", "en", 1, "no id"), (None, None, None, None, None)] + [(5, "hot", "en", 5, "Another of id 5")] * 3
    rows += [(1000 + i, f"s{i % 40}", "é", -i, "Ünï\n" * i) for i in range(60)] + [(2000, "", "", 0, ""), (2001, "alone", "en", 1, "LONG " * 30_000), (-7, "Zed", "x", 0, "A")]
    return rows


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", None, 3) for r in rows], KIND).repartition(parts)


@pytest.mark.parametrize("fan_levels", [(16, 1), (16, 2), (16, 3)])
def test_against_plain_python(spark, fan_levels):
    rows = table(700)
    got = merkle.manifest(spark, docs(spark, rows), *fan_levels)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(rows)


def test_tampering_shows(spark):
    got = merkle.manifest(spark, docs(spark, table())).collect()
    bad = {r.doc_id for r in got if not r.verified}
    assert bad == {r[0] for r in table() if r[0] is not None and r[4] and r[4] != r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert 0 < len(bad) < len(got) / 3 and all((r.folded_root == r.root) == r.verified for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(i, "one", "en", 1, "x") for i in range(16)], [(i, "one", "en", 1, "x") for i in range(17)], [(3, "a", "en", 1, "Same")] * 40])
def test_small_tables(spark, tmp_path, rows):
    docs(spark, rows, 2).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()), key=repr) == wanted(rows)


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = table(400)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(registry.ORACLE_SQL["op11_merkle_manifest"]).fetchall(), key=repr) == wanted(rows)
