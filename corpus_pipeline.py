"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidark.llm.common import table, written
from evidark.llm.host_rules import quality_rules_stage
from evidark.llm.mixing import mixing_stage
from evidark.llm.nbsvm import quality_stage
from evidark.llm.packing import packing_stage
from evidark.llm.simhash import dedup_stage

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
