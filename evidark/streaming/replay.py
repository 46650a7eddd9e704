"""Cases as a stream of files: each micro-batch is analysed once, and what was done survives a restart.

A batch's rows overwrite the batch's own folder, so a batch that is run again after a failure leaves one copy; the
checkpoint says which files were read. Totals come from the per-case rows, as in a batch run.

``analyse_split`` also keeps state by project (cases seen, running measures), so that a case that comes twice, in one run or
after a restart, gives one row; and a commit record, which a restart must match.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evidark.operators.metrics import ratio
from evidark.sources import schemas


def case_stream(spark: SparkSession, path: str, schema: str = schemas.CASES, files_at_once: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def analyse_stream(cases: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``analyse`` on each micro-batch and write its rows below ``out``; stops when all input is read."""

    def batch(df: DataFrame, number: int) -> None:
        analyse(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return cases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_metrics(spark: SparkSession, out: str) -> DataFrame:
    """One row from the per-case rows: cases, errors, candidates, hits, recall. A failed case still counts its truths."""
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count("error").alias("errors"), F.sum(F.coalesce("candidates", F.lit(0))).alias("candidates"),
        F.sum("truths").alias("truths"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), ratio(F.sum(F.coalesce("hits", F.lit(0))), F.sum("truths")).alias("recall"),
    )


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Event counts by window and type; rows later than the watermark are dropped when run as a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


#: Of the commit record.
COMMIT_VERSION = 1
MEASURES = ("truths", "hits", "candidates", "lines")
ANALYSED = "project_id string, case_id string, truths long, hits long, candidates long, lines long, error string"
RUNNING = ANALYSED + ", cases_so_far long, errors_so_far long, " + ", ".join(f"{m}_so_far long" for m in MEASURES)
ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningMeasures(StatefulProcessor):
    """Rows of cases not seen before in their project, each with the project's sums up to and with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "case_id string", "there boolean")
        self.sums = handle.getValueState("sums", "cases long, errors long, " + ", ".join(f"{m} long" for m in MEASURES))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        have = self.sums.get() if self.sums.exists() else None
        total = [int(x) for x in have] if have is not None else [0] * (2 + len(MEASURES))
        for batch in rows:
            out = []
            for r in batch.sort_values("case_id").to_dict("records"):
                if self.seen.containsKey((r["case_id"],)):
                    continue
                self.seen.updateValue((r["case_id"],), (True,))
                values = [0 if r[m] is None or r[m] != r[m] else int(r[m]) for m in MEASURES]
                failed = isinstance(r["error"], str)
                total = [total[0] + 1, total[1] + failed, *[t + v for t, v in zip(total[2:], values)]]
                out.append([r["project_id"], r["case_id"], *values, r["error"] if failed else None, *total])
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNNING.split(", ")])
        self.sums.update(tuple(total))

    def close(self) -> None:
        pass


def file_of(spark: SparkSession, path: str):
    """(file system, path) of a file that any of Spark's file systems holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_commit(spark: SparkSession, path: str) -> dict | None:
    fs, place = file_of(spark, path)
    if not fs.exists(place):
        return None
    try:
        record = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(place), "UTF-8"))
        return {k: record[k] for k in ("version", "path", "expected", "done", "last_id")}
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"{path} is no commit record; run without resume") from e


def write_commit(spark: SparkSession, path: str, record: dict) -> None:
    """Written beside and renamed, so that a reader meets a whole record or the one before."""
    fs, place = file_of(spark, path)
    _, beside = file_of(spark, path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(beside, place)


def analyse_split(spark: SparkSession, path: str, analyse: Callable[[DataFrame], DataFrame], out: str, expected: int, resume: bool = True, files_at_once: int = 4, schema: str = schemas.CASES) -> DataFrame:
    """One row a case (``RUNNING``) of all files in ``path``, each case once however often the run is stopped and begun anew.

    ``analyse`` makes of the stream of cases a row each (``ANALYSED``; error names what failed). ``out`` holds rows, the
    stream's state and the commit record: version, path, expected number of cases, cases done and the last one. A restart
    with another path or number raises, as does a record that cannot be read, or that says more than the rows; without
    ``resume`` all of it is deleted first. A run that ends with another number of cases than expected raises.
    """
    fs, folder = file_of(spark, out)
    if not resume:
        fs.delete(folder, True)
    source = file_of(spark, path)[0].makeQualified(file_of(spark, path)[1]).toString()
    record_at = f"{out}/commit.json"
    wanted = {"version": COMMIT_VERSION, "path": source, "expected": expected}
    have = read_commit(spark, record_at)
    if have is not None:
        if {k: have[k] for k in wanted} != wanted or not 0 <= have["done"] <= expected:
            raise ValueError(f"{record_at} is of another run ({have}); run without resume")
        rows = finished(spark, out)
        if rows.count() < have["done"] or (have["done"] and rows.where(F.col("case_id") == have["last_id"]).isEmpty()):
            raise ValueError(f"{record_at} says more than the rows hold; run without resume")
        if have["done"] == expected:
            return rows
    else:
        write_commit(spark, record_at, wanted | {"done": 0, "last_id": ""})

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = finished(spark, out)
        row = rows.agg(F.count(F.lit(1)).alias("done"), F.max("case_id").alias("last")).first()
        write_commit(spark, record_at, wanted | {"done": row["done"], "last_id": row["last"] or ""})

    kept = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        analysed = analyse(case_stream(spark, path, schema, files_at_once)).select(*[c.split()[0] for c in ANALYSED.split(", ")])
        running = analysed.groupBy("project_id").transformWithStateInPandas(statefulProcessor=RunningMeasures(), outputStructType=RUNNING, outputMode="Append", timeMode="None")
        running.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], kept)
    rows = finished(spark, out)
    done = rows.count()
    if done != expected:
        raise ValueError(f"{expected} cases were expected in {path}, {done} were found")
    return rows


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all batches so far."""
    fs, place = file_of(spark, f"{out}/rows")
    if not fs.exists(place):
        return spark.createDataFrame([], RUNNING)
    return spark.read.schema(RUNNING).parquet(f"{out}/rows/*")


def totals(rows: DataFrame) -> DataFrame:
    """project_id and its last running measures: the state, read from the rows."""
    sums = ["cases", "errors", *MEASURES]
    return rows.groupBy("project_id").agg(F.max_by(F.struct(*[F.col(f"{s}_so_far").alias(s) for s in sums]), "cases_so_far").alias("s")).select("project_id", "s.*")
