"""Readers and writers. Schemas are fixed, missing fields get their defaults, and a bad line fails the read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.sources import schemas


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped and malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    raw = jsonl(spark, path, schemas.CASES)
    return raw.select(
        "case_id", F.coalesce("project_id", "case_id").alias("project_id"), F.coalesce("source_files", F.create_map().cast("map<string,string>")).alias("source_files"), F.coalesce("split", F.lit("dev")).alias("split"),
        "vulnerable_revision", "fixed_revision", F.coalesce("ground_truth", F.array().cast(raw.schema["ground_truth"].dataType)).alias("ground_truth"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def source_files(cases_: DataFrame) -> DataFrame:
    return cases_.select("case_id", "project_id", "split", F.explode("source_files").alias("file", "source"))


def truths(cases_: DataFrame) -> DataFrame:
    return cases_.select("case_id", "project_id", "split", F.explode("ground_truth").alias("t")).select("case_id", "project_id", "split", "t.*")


def candidate(c: str) -> Column:
    """The candidate struct with its score taken from the older name where it has only that."""
    return F.col(c).withField("suspicion_score", F.coalesce(F.col(f"{c}.suspicion_score"), F.col(f"{c}.static_score"), F.lit(0.0))).dropFields("static_score")


def router_samples(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.ROUTER_SAMPLES).select(candidate("candidate").alias("candidate"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def outcome_samples(spark: SparkSession, path: str) -> DataFrame:
    """Defaults for counts; truth labels count as available where the row names truth ids."""
    raw = jsonl(spark, path, schemas.OUTCOMES).withColumn("candidate", candidate("candidate"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("unsupported_claims", "prompt_tokens", "completion_tokens", "validated_true_findings", "validated_false_findings", "rejected_findings")}
    raw = raw.withColumns(zero | {"truth_labels_available": F.coalesce("truth_labels_available", F.col("ground_truth_ids").isNotNull())})
    none = F.array().cast("array<string>")
    a = F.col("assignment")
    return raw.withColumns({"matched_truth_ids": F.coalesce("matched_truth_ids", none), "ground_truth_ids": F.coalesce("ground_truth_ids", none), "assignment_id": F.concat_ws("::", a["expert"], a["model_id"], a["prompt_version"])})


def compact(rows: DataFrame) -> DataFrame:
    """Without code and evidence; features stay."""
    return rows.withColumn("candidate", F.col("candidate").dropFields("code", "evidence"))


def write_jsonl(rows: DataFrame, path: str, *order: str, mode: str = "overwrite") -> None:
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_confusion(matrix: DataFrame, actual: str, path: str) -> None:
    """A confusion matrix with the header actual\\predicted; one row a label."""
    write_csv(matrix.withColumnRenamed(actual, "actual\\predicted").coalesce(1), path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row table as JSON with sorted keys; numbers that JSON cannot hold raise."""
    [only] = row.limit(2).collect()
    Path(path).write_text(json.dumps(only.asDict(recursive=True), sort_keys=True, indent=2, allow_nan=False, default=str) + "\n")


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.KNOWLEDGE).withColumn("tags", F.transform("tags", F.lower))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def crash_records(table: DataFrame, languages: list[str], host: str = "%github.com%", ids: list[int] | None = None) -> DataFrame:
    """Reproduced crashes with a located patch outside submodules, in the languages and host asked for."""
    out = table.where((F.col("reproduced") == 1) & (F.col("patch_located") == 1) & (F.col("submodule_bug") == 0) & F.col("language").isin(languages) & F.col("repo_addr").like(host))
    return (out.where(F.col("local_id").isin(ids)) if ids is not None else out).orderBy("local_id")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; filters on it reach the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def store_scenarios(scenarios: DataFrame, path: str) -> None:
    """By expert and split, which is how they are read."""
    scenarios.write.mode("overwrite").partitionBy("expert", "split").parquet(path)


def scenarios(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    out = spark.read.parquet(path)
    return (out.where(F.coalesce("duplicate_of", F.lit("")) == "") if unique else out).orderBy("case_id")


def sarif_locations(spark: SparkSession, path: str) -> DataFrame:
    """package, rule, cwe, uri, line_start, line_end of every location of every result; one SARIF document a file."""
    raw = spark.read.schema(schemas.SARIF).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("package"), F.explode("runs").alias("run"))
    results = raw.select("package", F.col("run.artifacts").alias("artifacts"), F.explode_outer("run.results").alias("r"))
    places = results.select("package", "artifacts", F.col("r.ruleId").alias("rule"), F.col("r.taxa")[0]["id"].alias("taxon"), F.explode_outer("r.locations").alias("l"))
    place = F.col("l.physicalLocation")
    by_index = F.try_element_at("artifacts", place["artifactLocation"]["index"] + 1)["location"]["uri"]
    digits = lambda c: F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))
    return places.select(
        "package", "rule", F.concat(F.lit("CWE-"), F.coalesce(digits(F.col("rule")), digits(F.col("taxon"))).cast("int").cast("string")).alias("cwe"),
        F.coalesce(place["artifactLocation"]["uri"], by_index).alias("uri"), place["region"]["startLine"].alias("line_start"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("line_end"),
    )


SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
IGNORED = (".git", "build", "node_modules", "third_party", "vendor")


def project_sources(spark: SparkSession, path: str, most_bytes: int = 2 << 20) -> DataFrame:
    """file, bytes, source below a folder: known suffixes, ignored folders left out, files beyond the cap dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    ignored = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED)))
    kept = files.where(name.isin(*SOURCE_SUFFIXES) & ~ignored & (F.col("length") <= most_bytes))
    return kept.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("source"))


def safe_relative(path: Column) -> Column:
    """Whether a path stays inside its root: no absolute or empty path, no parent step, no drive or reserved name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    bad = F.exists(parts, lambda p: p.isin("..", ".", "") | F.rlike(p, F.lit(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$|:")))
    return path.isNotNull() & ~bad


def patch_in_scope(diff: Column, approved: Column) -> Column:
    """Whether a unified diff touches approved paths only, and neither creates, renames nor carries binaries."""
    touched = F.array_distinct(F.array_union(F.regexp_extract_all(diff, F.lit(r"(?m)^--- a/(\S+)"), 1), F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(\S+)"), 1)))
    other = F.rlike(diff, F.lit(r"(?m)^(new file|deleted file|rename |copy |GIT binary|Binary files|(---|\+\+\+) /dev/null)"))
    return (F.size(touched) > 0) & (F.size(F.array_except(touched, approved)) == 0) & ~other
