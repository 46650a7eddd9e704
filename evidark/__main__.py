"""Command line: list and run queries, analyse source files, and the steps between files of cases and reports.

python -m evidark list | sql NAME | query NAME SF_DIR [--out PATH]
  detect FOLDER OUT [--gate X]                analyse, gate and route the sources of a folder
  conclude ANSWERS ROUTED OUT [--least X]     fuse and validate experts' answers (JSON lines)
  split CASES OUT [--family] [--seed S]       cases (JSON lines) by project into train, dev and test
  evaluate CASES CANDIDATES OUT               analyser metrics of candidates (Parquet) against the cases' truths
  calibrate CASES CANDIDATES OUT [--target X] the gate's threshold
  policies OUTCOMES OUT --fixed A B [--threshold X] [--single A]  measures of routing policies on an outcome matrix
  live RUNS OUT                               summary of live runs (JSON lines)
  repairs ATTEMPTS OUT                        summary of repair attempts (JSON lines)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE = "case_id string, ground_truth_ids array<string>, matched_truth_ids array<string>, validations array<struct<finding_id:string,verdict:string>>, matched_by_finding map<string,array<string>>, usage array<struct<cost:double,prompt_tokens:bigint,completion_tokens:bigint>>"
ANSWERS = "candidate_id string, expert string, model_id string, content string"
ATTEMPTS = "finding_id string, attempt int, applied boolean, verified boolean"


def share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1")
    return x


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evidark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for p in places:
            c.add_argument(p)
        return c

    command("list")
    command("sql", "name")
    command("query", "name", "sf_dir").add_argument("--out")
    command("detect", "folder", "out").add_argument("--gate", type=share, default=0.4)
    command("conclude", "answers", "routed", "out").add_argument("--least", type=share, default=0.55)
    s = command("split", "cases", "out")
    s.add_argument("--family", action="store_true")
    s.add_argument("--seed", default="2026")
    command("evaluate", "cases", "candidates", "out")
    command("calibrate", "cases", "candidates", "out").add_argument("--target", type=share, default=0.98)
    p = command("policies", "outcomes", "out")
    p.add_argument("--fixed", nargs="+", required=True)
    p.add_argument("--threshold", type=share, default=0.85)
    p.add_argument("--single")
    command("live", "runs", "out")
    command("repairs", "attempts", "out")
    return out


def spans_of(spark: SparkSession, got: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Candidates and truths with the columns that span operators read."""
    from evidark.sources import files

    truths = files.truths(files.cases(spark, got.cases)).select(F.col("truth_id").alias("id"), "case_id", "file", "line_start", "line_end", F.col("project_id").alias("project"), F.element_at("experts", 1).alias("expert"))
    found = spark.read.parquet(got.candidates).where("candidate_id IS NOT NULL").select(F.col("candidate_id").alias("id"), "case_id", "file", "line_start", "line_end", F.col("suspicion_score").alias("score"))
    return found, truths


def main(args: list[str] | None = None) -> int:
    got = parser().parse_args(args)
    from evidark.plans import catalog

    if got.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if got.command == "sql":
        print(catalog.oracle_sql().get(got.name, "none"))
        return 0
    run(SparkSession.builder.appName("evidark").getOrCreate(), got)
    return 0


def run(spark: SparkSession, got: argparse.Namespace) -> None:
    from evidark.operators import calibration, findings, metrics, policies, preparation, splits
    from evidark.plans import catalog
    from evidark.plans.flow import FlowConfig, conclude, detect
    from evidark.sources import files

    if got.command == "query":
        df = catalog.queries()[got.name](spark, got.sf_dir)
        df.write.mode("overwrite").parquet(got.out) if got.out else df.show(50, truncate=False)
    elif got.command == "detect":
        sources = files.project_sources(spark, got.folder).select(F.lit(got.folder).alias("case_id"), "file", "source")
        decisions, routed = detect(sources, FlowConfig(gate=got.gate))
        decisions.write.mode("overwrite").parquet(f"{got.out}/decisions")
        routed.write.mode("overwrite").parquet(f"{got.out}/routed")
    elif got.command == "conclude":
        conclude(files.jsonl(spark, got.answers, ANSWERS), spark.read.parquet(got.routed), FlowConfig(least_confidence=got.least)).write.mode("overwrite").parquet(got.out)
    elif got.command == "split":
        cases = files.cases(spark, got.cases)
        families = cases.select("project_id", F.explode(F.flatten(F.transform("ground_truth", lambda t: t["experts"]))).alias("family"))
        split = splits.stratified_split(families, "family", "project_id", got.seed) if got.family else splits.hash_split(cases, "project_id", got.seed)
        cases.drop("split").join(split, "project_id").write.mode("overwrite").partitionBy("split").json(got.out)
    elif got.command == "evaluate":
        files.write_report(metrics.analyzer_metrics(*spans_of(spark, got)), got.out)
    elif got.command == "calibrate":
        files.write_report(calibration.gate_calibration(*spans_of(spark, got), got.target), got.out)
    elif got.command == "policies":
        o = spark.read.parquet(got.outcomes)
        policies.evaluate(o, policies.baselines(o, got.fixed, got.threshold, single=got.single)).write.mode("overwrite").json(got.out)
    elif got.command == "live":
        files.write_report(preparation.live_summary(files.jsonl(spark, got.runs, LIVE)), got.out)
    else:
        files.write_report(findings.repair_summary(files.jsonl(spark, got.attempts, ATTEMPTS)), got.out)


if __name__ == "__main__":
    sys.exit(main())
