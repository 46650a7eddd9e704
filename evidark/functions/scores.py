"""Scores, confidences, routes and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each feature in the suspicion score; counts are clipped to 0..3.
SUSPICION_WEIGHTS = {
    "use_after_release_count": 1.0, "double_release_count": 1.0, "uninitialized_use_count": 0.9, "unchecked_nullable_dereference_count": 0.9,
    "unsanitized_source_to_sink_count": 0.85, "memory_copy_without_guard_count": 0.75, "unchecked_index_count": 0.70, "toctou_check_use_count": 0.70,
    "arithmetic_to_memory_sink_count": 0.55, "arithmetic_to_allocation_count": 0.45, "source_to_sink_count": 0.40, "memory_copy_count": 0.15,
    "array_access_count": 0.10, "dereference_count": 0.10,
}
CLIP = 3.0
RULE_SCORE = 0.30


def suspicion(features: Column, weights: dict[str, float] = SUSPICION_WEIGHTS) -> Column:
    """1 - exp(-sum of weight times clipped count) over a map of features; missing ones are 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * clipped(F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0)))
    return 1 - F.exp(-total)


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(CLIP))


def six_digits(v: Column) -> Column:
    """A number as text with six significant digits and no zeros at the end; powers below -4 or above 5 in exponent form."""
    told = F.format_string("%.5e", v)
    power = F.regexp_extract(told, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.format_string("%.5f", v)
    for places in range(10):  # as many as the power leaves of the six
        fixed = F.when(power == 5 - places, F.format_string(f"%.{places}f", v)).otherwise(fixed)
    return F.when((power < -4) | (power > 5), F.concat(bare(F.regexp_extract(told, r"^(.*)e", 1)), F.regexp_extract(told, r"(e[+-]\d+)$", 1))).otherwise(bare(fixed))


def suspicion_reasons(features: Column, weights: dict[str, float] = SUSPICION_WEIGHTS) -> Column:
    """"name=value" of every feature above 0, the largest contribution first, ties by name; values to six significant digits."""
    value = lambda n: F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0))
    parts = F.array(*[F.struct((-w * clipped(value(n))).alias("down"), F.lit(n).alias("name"), value(n).alias("value")) for n, w in weights.items()])
    return F.transform(F.array_sort(F.filter(parts, lambda p: p["value"] > 0)), lambda p: F.concat(p["name"], F.lit("="), six_digits(p["value"])))


def utility(p: Column, false_positive: Column, unsupported: Column, cost: Column, weights: tuple[float, float, float] = (0.5, 0.25, 1.0)) -> Column:
    return p - weights[0] * false_positive - weights[1] * unsupported - weights[2] * cost


def independence(a: Column, b: Column) -> Column:
    """Chance that one of two independent experts is right; chances are held to 0..1."""
    held = lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))
    return 1 - (1 - held(a)) * (1 - held(b))


def independence_of(chances: Column) -> Column:
    """The same of an array of any length; 0 of none."""
    return 1 - F.aggregate(chances, F.lit(1.0), lambda left, x: left * (1 - F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))))


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at and beyond the ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def fused_scores(learned: Column, rules: Column) -> Column:
    """Map of family to the larger of both scores, divided by their sum (zero sums stay)."""
    both = F.map_zip_with(learned, rules, lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
    total = F.aggregate(F.array_sort(F.map_values(both)), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(both, lambda _, v: F.when(total > 0, v / total).otherwise(v))


def rule_trigger(triggers: dict[str, Column], learned: list[str]) -> Column:
    """Map of family to RULE_SCORE where its trigger holds and no learned score covers it."""
    pairs = [F.struct(F.lit(f).alias("k"), F.when(c, RULE_SCORE).otherwise(0.0).alias("v")) for f, c in triggers.items() if f not in learned]
    return F.map_from_entries(F.array(*pairs))


def floor_score(learned: Column, static: Column) -> Column:
    """The larger of the learned score and the static one, which is held to 0..1."""
    return F.greatest(learned, F.least(F.greatest(static, F.lit(0.0)), F.lit(1.0)))


def anchor_route(anchors: list[str], rare: Column, thresholds: dict[str, float]) -> Column:
    """Families selected: the anchors, then rare ones at or above their threshold, best first."""
    limits = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else F.create_map().cast("map<string,double>")
    met = F.filter(F.map_entries(rare), lambda e: e["value"] >= F.try_element_at(limits, e["key"]))
    order = F.transform(F.array_sort(F.transform(met, lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("family")))), lambda e: e["family"])
    return F.array_union(F.array(*map(F.lit, anchors)), order)


def utility_route(ranked: Column, confidence: Column, threshold: float) -> Column:
    """All experts where the pair's confidence is below the threshold, else the best two."""
    return F.when(confidence < threshold, ranked).otherwise(F.slice(ranked, 1, 2))


def escalation_features(prefix: str, features: Column) -> Column:
    return F.transform_keys(features, lambda k, _: F.concat(F.lit(prefix), k))


# What an operator becomes when its sides swap, and when its branch is the false one.
REVERSED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}


def guard_kind(operator: Column, symbol_on_right: Column, branch: Column, null_literal: Column, unary: Column | None = None, symbol_inside: Column | None = None) -> Column:
    """upper_bound, lower_bound, non_null, equality or generic: what a condition guarantees on a branch.

    ``operator`` is null for a condition without one; then ``unary`` ("!" or null) and ``symbol_inside`` decide: the
    symbol is not null where it is asked for plainly and holds, or is negated and does not. Any operator that is no bound
    counts as equality, as the one that a branch negates into an unknown does.
    """
    flip = F.create_map(*[F.lit(x) for kv in REVERSED.items() for x in kv])
    negate = F.create_map(*[F.lit(x) for kv in NEGATED.items() for x in kv])
    seen = F.when(branch == "true", operator).otherwise(F.try_element_at(negate, operator))
    seen = F.when(symbol_on_right, F.try_element_at(flip, F.coalesce(seen, F.lit("")))).otherwise(seen)
    binary = F.when(null_literal & (seen == "!="), "non_null").when(seen.isin("<", "<="), "upper_bound").when(seen.isin(">", ">="), "lower_bound").otherwise("equality")
    wanted = F.when(F.coalesce(unary if unary is not None else F.lit(None).cast("string"), F.lit("")) == "!", branch == "false").otherwise(branch == "true")
    inside = F.coalesce(symbol_inside if symbol_inside is not None else F.lit(False), F.lit(False))
    return F.when(operator.isNotNull(), binary).otherwise(F.when(~inside, "generic").when(wanted, "non_null").otherwise("equality"))


# Checks that reject a finding, and those that do so only for candidates with semantic evidence.
HARD_CHECKS = ["file_matches", "function_matches", "line_reachable", "evidence_exists", "evidence_ids_valid"]
SEMANTIC_CHECKS = ["cwe_present", "cwe_semantics_supported"]
SEMANTIC_VERSION = "semantic-cwe-v2"


def verdict(checks: dict[str, Column], version: Column) -> Column:
    """rejected on a failed hard check or a contradicting guard, uncertain without enough confidence, else validated.

    A check that could not be made (null) counts as failed.
    """
    held = lambda names: [F.coalesce(checks[n], F.lit(False)) for n in names if n in checks]
    failed = F.lit(False)
    for c in held(HARD_CHECKS):
        failed = failed | ~c
    for c in held(SEMANTIC_CHECKS):
        failed = failed | (F.coalesce(version == SEMANTIC_VERSION, F.lit(False)) & ~c)
    contradicted = F.coalesce(checks["contradicting_guard"], F.lit(False))
    return F.when(failed | contradicted, "rejected").when(~F.coalesce(checks["confidence_sufficient"], F.lit(False)), "uncertain").otherwise("validated")


def fused_confidence(best: Column, experts: Column, models: Column) -> Column:
    """Largest confidence with 0.03 for each further expert and 0.02 for each further model, at most 1."""
    return F.least(F.lit(1.0), best + 0.03 * (experts - 1) + 0.02 * (models - 1))
