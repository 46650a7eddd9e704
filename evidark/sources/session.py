"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, whatever the driver's folder; a cluster ships it as py-files."""
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="evidark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that what reads it again computes and loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidark-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete what ``written`` has stored; call it when the results that read those tables are saved."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
