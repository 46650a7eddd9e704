"""The whole flow over files: labelled cases from a corpus; analyse, gate, cap, route; then answers to findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidark.functions.cfront.candidates import analyse_files
from evidark.functions.lightweight import function_regions
from evidark.functions.scores import anchor_route
from evidark.operators import findings as fusion
from evidark.operators import preparation, ranking, splits
from evidark.operators.graph import checkpoints
from evidark.operators.ranking import top_k


@dataclass
class FlowConfig:
    gate: float = 0.4
    gate_enabled: bool = True
    most_candidates: int = 4
    least_confidence: float = 0.55
    anchors: list[str] = field(default_factory=lambda: ["memory_bounds", "control_state"])
    rare: dict[str, float] = field(default_factory=lambda: {"integer_overflow": 0.5, "taint_api": 0.5, "concurrency": 0.5})

    def __post_init__(self) -> None:
        if not 0 <= self.gate <= 1 or not 0 <= self.least_confidence <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.most_candidates < 1:
            raise ValueError("at least one candidate")


RARE_SCORES = {"integer_overflow": "cwe_integer_score", "taint_api": "cwe_taint_api_score", "concurrency": "cwe_concurrency_score"}


def detect(files: DataFrame, config: FlowConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions on all candidates, routed candidates): the gate and the cap come before routing."""
    config = config or FlowConfig()
    candidates = analyse_files(files)
    accepted = F.col("error").isNull() & (F.lit(not config.gate_enabled) | (F.col("suspicion_score") >= config.gate))
    decisions = candidates.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    best = top_k(decisions.where("accepted"), ["case_id"], config.most_candidates, F.desc("suspicion_score"), F.asc("file"), F.asc("line_start"), F.asc("candidate_id"))
    rare = F.create_map(*[x for f, n in RARE_SCORES.items() for x in (F.lit(f), F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)))])
    return decisions, best.withColumn("experts", anchor_route(config.anchors, rare, config.rare))


def conclude(answers: DataFrame, routed: DataFrame, config: FlowConfig | None = None) -> DataFrame:
    """Answers (candidate_id, expert, model_id, content) to fused findings with verdicts."""
    config = config or FlowConfig()
    rows = fusion.findings_from_answers(answers).join(routed.select("candidate_id", "file", "function"), "candidate_id")
    return fusion.validate(fusion.fuse(rows), routed, config.least_confidence)


@dataclass
class CorpusConfig:
    allowed: list[str] = field(default_factory=lambda: list(preparation.ACTIVE))
    most_per_family: int | None = None
    most_per_weakness: int | None = None
    most_per_template: int | None = None
    seed: str = "2026"


def prepare_corpus(files: DataFrame, config: CorpusConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, truths, counts of files) from files (path, source) whose paths name a weakness.

    Files of allowed experts are parsed; functions named bad are truths, each text once (the first path's), at their marked
    lines or as a whole. Files without a truth are no cases. Cases are taken in turns of the weaknesses, each in path order,
    while no cap of their family, weakness or template is reached, and split by project (weakness and template) so that
    every family is in every split. Counts of caps cover cases, so files that a cap leaves out still claim their functions.
    """
    config = config or CorpusConfig()
    checkpoints(files.sparkSession)
    kept, counts = preparation.supported(files, "path", config.allowed)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"[.][^.]*$", "")
    project = F.lower(F.concat(F.lit("cwe-"), F.col("number").cast("string"), F.lit("-"), splits.variant_group(stem)))
    kept = kept.withColumn("project_id", project).withColumn("file", F.col("path")).checkpoint()
    regions = kept.select("file", "expert", "number", F.explode(function_regions("source")).alias("f")).select("file", "expert", "number", F.col("f.name").alias("function"), "f.line_start", "f.line_end", splits.fingerprint(F.col("f.code")).alias("digest"))
    bad = regions.where(preparation.is_bad(F.col("function")))
    first = bad.groupBy("digest").agg(F.min_by(F.struct("file", "expert", "number", "function", "line_start", "line_end"), F.struct("file", "line_start")).alias("x")).select("x.*")
    truths = preparation.truth_spans(first, preparation.marked_lines(kept, ["file"], "source"), ["file"])
    truths = truths.join(first.select("file", "expert", "number").distinct(), "file")
    seed = F.concat_ws(":", "file", "function", F.col("line_start").cast("string"), F.col("ordinal").cast("string"))
    truths = truths.select(F.concat(F.lit("truth-"), F.substring(F.sha2(seed, 256), 1, 16)).alias("truth_id"), "file", "function", "line_start", "line_end", "expert", F.concat(F.lit("CWE-"), F.col("number").cast("string")).alias("cwe")).checkpoint()
    cases = kept.join(truths.select("file").distinct(), "file", "left_semi")
    turns = ranking.round_robin(cases.select("file", "expert", "number", "project_id"), "number", F.col("file").asc()).withColumnRenamed("position", "id")
    caps = {c: n for c, n in (("family", config.most_per_family), ("number", config.most_per_weakness), ("project_id", config.most_per_template)) if n}
    if caps:
        chosen = ranking.quota_sample(turns.withColumn("family", F.col("expert")), caps, "expert")
        turns = turns.join(chosen.select("id"), "id", "left_semi")
    cases = cases.join(turns.select("file", F.col("id").alias("ordinal")), "file").checkpoint()
    split = splits.stratified_split(cases, "expert", "project_id", config.seed)
    cases = cases.join(split, "project_id").select(F.concat(F.lit("case-"), F.substring(F.sha2("file", 256), 1, 16)).alias("case_id"), "project_id", "split", "file", "source", "expert", "number", "ordinal")
    return cases, truths.join(cases.select("case_id", "file"), "file"), counts
