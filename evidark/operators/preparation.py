"""Making labelled cases from corpora: which files and functions count, where truths lie, and what a cohort must hold."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.functions import taxonomy
from evidark.operators.assertions import DataError
from evidark.operators.metrics import f1, ratio

# Experts in use, in their order.
ACTIVE = ["memory_bounds", "integer_overflow", "taint_api", "control_state", "concurrency"]


def supported(files: DataFrame, path: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files with number, category and expert of the weakness their path names, one row of counts): files whose expert is
    not ``allowed`` are counted as unsupported; those that name no weakness are neither."""
    w = F.broadcast(taxonomy.weakness_table(files.sparkSession))  # a fixed table of under a hundred rows
    number = F.nullif(F.regexp_extract(path, r"(?i)CWE[-_]?([0-9]{1,9})", 1), F.lit("")).cast("int")
    named = files.withColumn("number", number).where("number IS NOT NULL").join(w, "number", "left").withColumn("kept", F.coalesce(F.col("expert").isin(allowed), F.lit(False)))
    return named.where("kept").drop("kept"), named.agg(F.count_if("kept").alias("supported"), F.count_if(~F.col("kept")).alias("unsupported"))


def marked_lines(files: DataFrame, key: list[str], source: str, pattern: str = r"(?i)\bFLAW\b") -> DataFrame:
    """key, line (from 1): lines that match."""
    return files.select(*key, F.posexplode(F.split(source, "\r\n|\n|\r")).alias("at", "text")).where(F.rlike("text", F.lit(pattern))).select(*key, (F.col("at") + 1).alias("line"))


def is_bad(function: Column) -> Column:
    return F.contains(F.lower(function), F.lit("bad"))


def is_good(function: Column, callees: Column, assignments: Column, accesses: Column) -> Column:
    """Named good and no mere dispatcher: one that only calls other good functions."""
    dispatcher = (F.size(callees) > 0) & (assignments == 0) & (accesses == 0) & F.forall(callees, lambda c: F.contains(F.lower(c), F.lit("good")))
    return F.contains(F.lower(function), F.lit("good")) & ~F.coalesce(dispatcher, F.lit(False))


def truth_spans(functions: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``functions`` (key, function, line_start, line_end) by truth: a marked line inside is one of its own; a function
    without one is a truth as a whole. Columns key, function, line_start, line_end, ordinal."""
    f, m = functions.alias("f"), lines.alias("m")
    met = F.col("f.line_start") <= F.col("m.line")
    for k in key:
        met = met & (F.col(f"f.{k}") == F.col(f"m.{k}"))
    inside = f.join(m, met & (F.col("m.line") <= F.col("f.line_end")), "left").groupBy(*[F.col(f"f.{k}") for k in key], "f.function", "f.line_start", "f.line_end").agg(F.array_sort(F.collect_set("m.line")).alias("marks"))
    spans = F.when(F.size("marks") > 0, F.transform("marks", lambda x: F.struct(x.alias("a"), x.alias("b")))).otherwise(F.array(F.struct(F.col("line_start").alias("a"), F.col("line_end").alias("b"))))
    out = inside.select(*key, "function", F.posexplode(spans).alias("at", "x"))
    return out.select(*key, "function", F.col("x.a").alias("line_start"), F.col("x.b").alias("line_end"), (F.col("at") + 1).alias("ordinal"))


def line_count(source: Column) -> Column:
    """Lines of a text; a final line break ends the last one, and an empty text has one."""
    return F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(source, "(\r\n|\n|\r)$", ""), "\r\n|\n|\r")))


def valid_region(source: Column, start: Column, end: Column) -> Column:
    """Whether a region lies inside its file; false without one."""
    return F.coalesce(source.isNotNull() & (start >= 1) & (start <= end) & (end <= line_count(source)), F.lit(False))


def single_label(samples: DataFrame) -> DataFrame:
    """Samples with exactly one label, and that label."""
    return samples.where(F.size("labels") == 1).withColumn("label", F.element_at("labels", 1))


def available_families(samples: DataFrame) -> list[str]:
    """Labels in use, in the experts' order; an error if a sample has several or none."""
    if not samples.where(F.size("labels") != 1).isEmpty():
        raise DataError("samples need exactly one label")
    have = {r[0] for r in samples.select(F.element_at("labels", 1)).distinct().collect()}  # at most all experts
    return [f for f in taxonomy.EXPERT_CODES if f in have]


def compact(cases: DataFrame) -> DataFrame:
    """Cases without their sources and metadata, as results carry them."""
    return cases.withColumn("source_files", F.create_map().cast("map<string,string>")).withColumn("metadata", F.create_map().cast("map<string,string>"))


def routed(candidates: DataFrame, routes: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates with their routes, one to one; an error if either side lacks or repeats the other's."""
    both = candidates.join(routes, key, "full_outer")
    n = both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys")).crossJoin(F.broadcast(candidates.agg(F.count(F.lit(1)).alias("a")))).crossJoin(F.broadcast(routes.agg(F.count(F.lit(1)).alias("b")))).first()
    if not n["n"] == n["keys"] == n["a"] == n["b"]:
        raise DataError(f"{n['a']} candidates and {n['b']} routes do not pair")
    return candidates.join(routes, key)


def with_cache(cases: DataFrame, cache: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases with the array of their cached candidates, best first; an empty one where the cache has none.

    The cache is grouped before the join; both sides are sorted by key and merged, whichever is larger.
    """
    best = F.struct((-F.col("suspicion_score")).alias("down"), "file", "line_start", "candidate_id", F.struct(*[c for c in cache.columns if c != key]).alias("c"))
    held = cache.groupBy(key).agg(F.array_sort(F.collect_list(best)).alias("h")).select(key, F.transform("h", lambda x: x["c"]).alias("candidates"))
    joined = cases.hint("merge").join(held, key, "left")
    return joined.withColumn("candidates", F.coalesce("candidates", F.array().cast(joined.schema["candidates"].dataType)))


def cached(spark: SparkSession, place: str, settings: dict, make) -> DataFrame:
    """The table at ``place`` if it was made with the same ``settings`` (paths, sizes, limits), else ``make()`` written there."""
    mark = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
    path = f"{place.rstrip('/')}/{mark[:24]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def consolidated(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(outcome rows, detections) of all case files of a folder, by file name and order in the file."""
    files = spark.read.schema(f"rows array<struct<{schema}>>, detection string").option("multiLine", True).json(f"{folder.rstrip('/')}/*.json").withColumn("file", F.input_file_name())
    rows = files.select("file", F.posexplode("rows").alias("ordinal", "r")).select("file", "ordinal", "r.*")
    return rows, files.where("detection IS NOT NULL").select("file", "detection")


def live_summary(rows: DataFrame) -> DataFrame:
    """One row: findings validated and matched, truths hit, precision, recall, f1, tokens and cost of live runs.

    ``rows``, one a case: ground_truth_ids, matched_truth_ids, validations (array of finding_id, verdict), matched_by_finding
    (map of finding_id to truth ids) and usage (array of cost, prompt_tokens, completion_tokens).
    """
    accepted = F.array_distinct(F.transform(F.filter("validations", lambda v: v["verdict"] == "validated"), lambda v: v["finding_id"]))
    matched = F.filter(F.map_entries(F.coalesce("matched_by_finding", F.create_map().cast("map<string,array<string>>"))), lambda e: (F.size(e["value"]) > 0) & F.array_contains(F.col("accepted"), e["key"]))
    total = lambda c, kind: F.aggregate(F.coalesce("usage", F.array().cast("array<struct<cost:double,prompt_tokens:bigint,completion_tokens:bigint>>")), F.lit(0).cast(kind), lambda a, u: (a + F.coalesce(u[c], F.lit(0)).cast(kind)).cast(kind))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    per = rows.withColumn("accepted", accepted).select(size("ground_truth_ids").alias("t"), size("matched_truth_ids").alias("h"), size("accepted").alias("v"), F.size(matched).alias("m"), total("cost", "decimal(24,9)").alias("cost"), total("prompt_tokens", "bigint").alias("p"), total("completion_tokens", "bigint").alias("c"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = per.agg(F.count(F.lit(1)).alias("case_count"), zero("t").alias("ground_truth_count"), zero("h").alias("matched_ground_truth_count"), zero("v").alias("validated_finding_count"), zero("m").alias("ground_truth_matched_finding_count"), zero("p").alias("prompt_tokens"), zero("c").alias("completion_tokens"), zero("cost").cast("double").alias("realized_cost_usd"))
    precision, recall = ratio(F.col("ground_truth_matched_finding_count"), F.col("validated_finding_count"), 1.0), ratio(F.col("matched_ground_truth_count"), F.col("ground_truth_count"), 1.0)
    return s.withColumns({"validated_precision": precision, "ground_truth_recall": recall, "f1": f1(precision, recall)})


def audit_cohort(cases: DataFrame, regions: DataFrame, leaks: DataFrame, per_expert: int) -> DataFrame:
    """check, problems: every check of a cohort with the number of its problems; it passes where all are 0.

    Cases: case_id, project_id, split, expert, exact_hash, canonical_hash. Regions: case_id, kind ("positive" or "negative"),
    source, line_start, line_end, cwe, expert. Leaks: case_id, one row for each telling line left.
    """
    crossing = lambda c: cases.groupBy(c).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).cast("long").alias("problems"))
    w = F.broadcast(cases.sparkSession.createDataFrame([(n, e) for n, _, e in taxonomy.weaknesses()], "number int, mapped string"))
    positive = regions.where("kind = 'positive'").withColumn("number", taxonomy.weakness_number(F.col("cwe"))).join(w, "number", "left")
    invalid = lambda kind: regions.where(F.col("kind") == kind).agg(F.count_if(~valid_region(F.col("source"), F.col("line_start"), F.col("line_end"))).alias("problems"))
    counts = cases.groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    families = cases.sparkSession.createDataFrame([(e,) for e in ACTIVE], "expert string").join(F.broadcast(counts), "expert", "left")
    negatives = regions.agg(F.count_if(F.col("kind") == "negative").alias("k")).crossJoin(F.broadcast(cases.agg(F.count(F.lit(1)).alias("n"))))
    checks = {
        "mapping_mismatch": positive.agg(F.count_if(~F.col("mapped").eqNullSafe(F.col("expert"))).alias("problems")), "invalid_positive_region": invalid("positive"), "invalid_negative_region": invalid("negative"),
        "project_overlap": crossing("project_id"), "exact_hash_crosses_splits": crossing("exact_hash"), "canonical_hash_crosses_splits": crossing("canonical_hash"),
        "family_count": families.agg(F.count_if(F.coalesce("n", F.lit(0)) != per_expert).alias("problems")), "oracle_leak": leaks.agg(F.count(F.lit(1)).alias("problems")), "missing_negative_regions": negatives.select(F.greatest(F.lit(0), F.col("n") - F.col("k")).alias("problems")),
    }
    out = None
    for name, rows in checks.items():
        row = rows.select(F.lit(name).alias("check"), F.col("problems").cast("long").alias("problems"))
        out = row if out is None else out.union(row)
    return out


def load_mapping(path: str) -> tuple[dict[str, str], str]:
    """(expert by weakness number without leading zeros, digest of the whole mapping) from a TOML file's tables experts and cwe."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if list(raw["experts"]) != list(dict.fromkeys(raw["experts"])) or not raw["experts"]:
        raise DataError("the mapping names no experts")
    numbers = {str(int(k)): str(v) for k, v in raw["cwe"].items()}
    if unknown := sorted(set(numbers.values()) - set(raw["experts"])):
        raise DataError(f"the mapping gives unknown experts: {', '.join(unknown)}")
    return numbers, hashlib.sha256(json.dumps(raw, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def mapped_expert(cwe: Column, mapping: dict[str, str]) -> Column:
    """Expert of a weakness in any spelling, by a loaded mapping; null if it has none."""
    digits = F.regexp_replace(F.regexp_replace(cwe, "[^0-9]", ""), "^0+(?=[0-9])", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), digits) if mapping else F.lit(None).cast("string")


def one_model(models: list[str]) -> str:
    """The only model named; an error otherwise."""
    names = list(dict.fromkeys(m.strip() for m in models if m.strip()))
    if len(names) != 1:
        raise DataError("exactly one model is needed: a case is one request")
    return names[0]


# Columns of a review sheet.
REVIEW = ["case_id", "package_id", "package_path", "split", "cwe", "expert", "template_group", "leakage_group", "raw_file", "raw_function", "raw_line_start", "raw_line_end", "virtual_file", "virtual_function", "label"]


def review_sheet(rows: DataFrame) -> DataFrame:
    """The fixed columns in order; those not there are empty, others are left out."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REVIEW])


def packages(spark: SparkSession, root: str, most: int = 0) -> DataFrame:
    """name, path of the folders under ``root`` that hold a manifest, by name; the first ``most`` if given."""
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/manifest.sarif").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    out = found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path").orderBy("name")
    return out.limit(most) if most else out


def index_summary(metadata: DataFrame) -> dict:
    """Key and value rows (value: JSON) of an index's metadata as one dictionary."""
    return {r["key"]: json.loads(r["value"]) for r in metadata.select("key", "value").collect()}  # a row a setting


def large_cases(cases: DataFrame, least: int = 1 << 20) -> DataFrame:
    """case_id, bytes of cases whose sources pass ``least`` bytes together."""
    total = F.aggregate(F.map_values("source_files"), F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s))
    return cases.select("case_id", total.alias("bytes")).where(F.col("bytes") >= least)
