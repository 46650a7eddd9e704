"""A stream of cases that is stopped in the middle and begun anew: each case once, sums as if it had never stopped."""

import json

import pytest
from pyspark.sql import functions as F

from evidark.streaming import replay

SCHEMA = "case_id string, project_id string, n long, bad boolean"


def write(path, files):
    path.mkdir(exist_ok=True)
    for name, rows in files.items():
        (path / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("case_id", "project_id", "n", "bad"), r))) for r in rows))


def analyse(cases):
    failed = F.when(F.col("bad"), F.lit("ValueError: bad"))
    return cases.select("project_id", "case_id", F.col("n").alias("truths"), F.when(~F.col("bad"), F.col("n") - 1).alias("hits"), F.when(~F.col("bad"), F.col("n") * 2).alias("candidates"), F.lit(5).cast("long").alias("lines"), failed.alias("error"))


def case(i):
    return (f"c{i:02}", f"p{i % 3}", i, i % 7 == 3)


FILES = {f"f{k}": [case(i) for i in range(5 * k, 5 * k + 5)] for k in range(4)} | {"g": [case(2), case(19), case(20)]}  # two of g were there before


def run(spark, path, out, expected=21, f=analyse, **more):
    return replay.analyse_split(spark, str(path), f, str(out), expected, files_at_once=1, schema=SCHEMA, **more)


def test_stopped_and_resumed(spark, tmp_path):
    write(tmp_path / "cases", FILES)
    whole = run(spark, tmp_path / "cases", tmp_path / "whole")
    want = sorted(map(tuple, whole.drop("cases_so_far", "errors_so_far", *[f"{m}_so_far" for m in replay.MEASURES]).collect()), key=repr)
    assert len(want) == 21

    def dies(cases):
        return analyse(cases).withColumn("truths", F.when(F.col("case_id") == "c12", F.raise_error(F.lit("killed"))).otherwise(F.col("truths")).cast("long"))

    out = tmp_path / "out"
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path / "cases", out, f=dies)
    record = replay.read_commit(spark, f"{out}/commit.json")
    assert 0 < record["done"] < 21
    before = {r.case_id for r in replay.finished(spark, str(out)).collect()}
    assert len(before) == record["done"]
    rows = run(spark, tmp_path / "cases", out)
    got = rows.collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want and len({r.case_id for r in got}) == 21
    by = {r.project_id: r for r in replay.totals(rows).collect()}
    for p in ("p0", "p1", "p2"):
        own = [case(i) for i in range(21) if f"p{i % 3}" == p]
        assert (by[p].cases, by[p].errors, by[p].truths, by[p].candidates, by[p].lines) == (7, sum(c[3] for c in own), sum(c[2] for c in own), sum(2 * c[2] for c in own if not c[3]), 35)
    assert run(spark, tmp_path / "cases", out).count() == 21  # done: nothing is run


def test_a_restart_must_match(spark, tmp_path):
    write(tmp_path / "cases", {"f0": FILES["f0"]})
    write(tmp_path / "other", {"f0": FILES["f0"]})
    out = tmp_path / "out"
    with pytest.raises(ValueError, match="expected"):
        run(spark, tmp_path / "cases", out, expected=6)
    for bad in (lambda: run(spark, tmp_path / "other", out, expected=6), lambda: run(spark, tmp_path / "cases", out, expected=5)):
        with pytest.raises(ValueError, match="another run"):
            bad()
    (out / "commit.json").unlink()
    (out / ".commit.json.crc").unlink(missing_ok=True)
    (out / "commit.json").write_text("no record")
    with pytest.raises(ValueError, match="no commit record"):
        run(spark, tmp_path / "cases", out, expected=6)
    assert run(spark, tmp_path / "cases", out, expected=5, resume=False).count() == 5
