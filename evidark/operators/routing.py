"""Routes of candidates: learned scores, rules on features for what no model has learned, and the adaptive policy.

A candidate's scores are a map of a few families, so a route is one projection of its row: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidark.functions import scores
from evidark.operators.ranking import entropy

# By family in order of priority the features that fire its rule: any of the lists whose
# features are all above zero; first for candidates whose feature schema begins with the prefix below, then for others.
SEMANTIC_PREFIX = "semantic-"
SEMANTIC_RULES = {
    "integer_overflow": [["arithmetic_to_allocation_count"], ["arithmetic_to_memory_sink_count"], ["cast_to_size_sink_count"]],
    "taint_api": [["source_to_sink_count"], ["unsanitized_source_to_sink_count"]],
    "concurrency": [["toctou_check_use_count"], ["thread_spawn_count"]],
}
OTHER_RULES = {
    "integer_overflow": [["integer_size_arithmetic_count", "cast_count"], ["integer_size_arithmetic_count", "arithmetic_to_memory_sink"], ["integer_size_arithmetic_count", "allocation_count"]],
    "taint_api": [["source_sink_path"], ["external_input_to_sink"]],
    "concurrency": [["toctou_pair"], ["thread_signal_count", "lock_signal_count"]],
}
# Reasons that routes are given.
SURE = "top-1 selected: confidence, margin, and entropy satisfy policy"
UNSURE = "top-2 selected: routing uncertainty"
LOW_CONFIDENCE, LOW_MARGIN, HIGH_ENTROPY = "top-1 confidence below threshold", "top-1/top-2 margin below threshold", "routing entropy above threshold"
FIRED, FORCED = "rule fallback activated for unlearned family: ", "forced trigger selected unlearned family: "
MODES = ("score_fusion", "forced_trigger")


@dataclass(frozen=True)
class Policy:
    """Bounds of the adaptive policy: one family suffices that is sure, well ahead and leaves the rest quiet."""

    confidence: float = 0.72
    margin: float = 0.18
    most_entropy: float = 1.0
    most_experts: int = 2

    def __post_init__(self) -> None:
        for name in ("confidence", "margin"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.most_entropy < 0:
            raise ValueError("most_entropy must not be negative")
        if self.most_experts not in (1, 2):
            raise ValueError("most_experts must be 1 or 2")


def fired_rules(features: Column, schema: Column, learned: Column) -> Column:
    """array<string>, by priority: families whose rule fires on ``features`` (map) and that are not in ``learned`` (map).

    A feature that is absent or null is zero; a null schema is not a semantic one.
    """
    above = lambda name: F.coalesce(F.try_element_at(features, F.lit(name)) > 0, F.lit(False))
    fires = lambda lists: reduce(or_, [reduce(and_, [above(n) for n in names]) for names in lists])
    semantic = F.coalesce(F.startswith(schema, F.lit(SEMANTIC_PREFIX)), F.lit(False))
    said = [F.when(F.when(semantic, fires(SEMANTIC_RULES[f])).otherwise(fires(OTHER_RULES[f])), f) for f in SEMANTIC_RULES]
    return F.array_except(F.array_compact(F.array(*said)), F.map_keys(learned))


def best_first(told: Column) -> Column:
    """array<struct<down, family>> of a map of scores: highest first, equals by name; ``down`` is the negated score."""
    return F.array_sort(F.transform(F.map_entries(told), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("family"))))


def routes(candidates: DataFrame, policy: Policy = Policy(), mode: str = "score_fusion", rules: bool = True, schema: str | None = None) -> DataFrame:
    """The candidates (learned: map of family to score, features: map, feature_schema_version) with their routes.

    Adds trigger_scores, scores (the larger of learned and rule score, made to sum to 1), available_families (sorted),
    top1, margin, entropy, selected and reasons. In the mode ``forced_trigger`` a fired rule is selected first and the
    best learned family second. Without ``rules`` none fires. A candidate of another ``schema`` than the one given is an error.
    Null maps are empty; scores that are null are zero; a candidate without any score is routed nowhere, with no reason.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    empty = F.create_map().cast("map<string,double>")
    learned = F.transform_values(F.coalesce("learned", empty), lambda _, v: F.coalesce(v, F.lit(0.0)))
    features = F.coalesce("features", empty)
    if schema is not None:
        other = F.concat(F.lit(f"the router reads {schema}, a candidate has "), F.coalesce("feature_schema_version", F.lit("none")))
        learned = F.when(F.col("feature_schema_version").eqNullSafe(schema), learned).otherwise(F.raise_error(other).cast("map<string,double>"))
    r = candidates.withColumn("_learned", learned)
    r = r.withColumn("_fired", fired_rules(features, F.col("feature_schema_version"), F.col("_learned")) if rules else F.array().cast("array<string>"))
    r = r.withColumn("trigger_scores", F.map_from_arrays("_fired", F.transform("_fired", lambda _: F.lit(scores.RULE_SCORE))))
    r = r.withColumn("scores", scores.fused_scores(F.col("_learned"), F.col("trigger_scores")))
    r = r.withColumn("_order", best_first(F.col("scores"))).withColumn("_known", best_first(F.col("_learned")))
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    r = r.withColumns({
        "available_families": F.array_sort(F.map_keys("scores")), "top1": F.coalesce(-at(F.col("_order"), 1)["down"], F.lit(0.0)),
        "entropy": entropy(F.map_values("scores")), "_second": F.coalesce(-at(F.col("_order"), 2)["down"], F.lit(0.0)),
    }).withColumn("margin", F.col("top1") - F.col("_second"))
    low, close, loud = F.col("top1") < policy.confidence, F.col("margin") < policy.margin, F.col("entropy") > policy.most_entropy
    one = ~(low | close | loud) | (F.size("_order") == 1) | F.lit(policy.most_experts == 1)
    doubts = F.array_compact(F.array(F.lit(UNSURE), F.when(low, LOW_CONFIDENCE), F.when(close, LOW_MARGIN), F.when(loud, HIGH_ENTROPY)))
    none = F.array().cast("array<string>")
    chosen = F.transform(F.slice("_order", 1, F.when(one, 1).otherwise(2)), lambda x: x["family"])
    reasons = F.when(F.size("_order") == 0, none).when(one, F.array(F.lit(SURE))).otherwise(doubts)
    reasons = F.concat(reasons, F.transform(F.array_sort("_fired"), lambda f: F.concat(F.lit(FIRED), f)))
    if mode == "forced_trigger":
        first = at(F.col("_fired"), 1)
        pair = F.array_compact(F.array(first, at(F.col("_known"), 1)["family"]))
        chosen = F.when(first.isNotNull(), F.slice(pair, 1, policy.most_experts)).otherwise(chosen)
        reasons = F.when(first.isNotNull(), F.concat(reasons, F.array(F.concat(F.lit(FORCED), first)))).otherwise(reasons)
    r = r.withColumns({"selected": chosen, "reasons": reasons})
    return r.drop("_learned", "_fired", "_order", "_known", "_second")
