"""Queries over routes: candidates are users, their features counts of events, learned scores shares of event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidark.operators import routing
from evidark.plans.registry import query
from evidark.sources.session import written
from evidark.sources.tables import read

_FEATURES = ["arithmetic_to_allocation_count", "cast_to_size_sink_count", "source_to_sink_count", "toctou_check_use_count", "thread_spawn_count", "integer_size_arithmetic_count", "cast_count", "allocation_count", "source_sink_path", "toctou_pair", "thread_signal_count", "lock_signal_count"]
_LEARNED = {"view": "memory_bounds", "click": "lifetime_resource", "purchase": "control_state"}
_POLICY = routing.Policy(0.4501, 0.0503, 1.2007)


def _candidates(spark, sf):
    """Every third user's model has learned a fourth family; every second one's features are the semantic ones.

    An event counts for a feature where its key leaves no rest by five; the feature is chosen by the key's rest by 61.
    """
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _LEARNED.items() for x in kv]), F.col("event_type")), F.when(F.col("user_id") % 3 == 0, "taint_api"))
    name = F.when(F.col("event_id") % 5 == 0, F.try_element_at(F.array(*map(F.lit, _FEATURES)), (F.col("event_id") % 61 + 1).cast("int")))
    e = read(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), family.alias("family"), name.alias("name"))
    counts = e.select("candidate_id", F.explode(F.array(F.struct(F.lit("learned").alias("kind"), F.col("family").alias("key")), F.struct(F.lit("features").alias("kind"), F.col("name").alias("key")))).alias("x"))
    counts = counts.groupBy("candidate_id", "x.kind", "x.key").count().where("key IS NOT NULL OR kind = 'learned'")
    entry = lambda kind: F.map_from_entries(F.array_compact(F.collect_list(F.when((F.col("kind") == kind) & F.col("key").isNotNull(), F.struct("key", F.col("count").cast("double").alias("v"))))))  # noqa: E731 (16 keys at most)
    maps = counts.groupBy("candidate_id").agg(entry("learned").alias("learned"), entry("features").alias("features"))
    total = F.aggregate(F.map_values("learned"), F.lit(0.0), lambda s, x: s + x)
    version = F.when(F.col("candidate_id") % 2 == 0, "semantic-v3").otherwise("signals-v1")
    return maps.withColumn("_total", total).select("candidate_id", F.transform_values("learned", lambda _, v: v / F.col("_total")).alias("learned"), "features", version.alias("feature_schema_version"))


def _fires(families: dict) -> str:
    """Pairs of priority and condition, by family, over the list of feature names that are there (``names``)."""
    return " ".join(f"WHEN family = '{f}' THEN {' OR '.join('list_has_all(names, ' + str(names) + ')' for names in lists)}" for f, lists in families.items())


_ROUTED = f"""e AS (SELECT user_id AS candidate_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEARNED.items())} ELSE CASE WHEN user_id % 3 = 0 THEN 'taint_api' END END AS family, CASE WHEN event_id % 5 = 0 THEN {_FEATURES}[CAST(event_id % 61 + 1 AS INTEGER)] END AS name FROM events),
c AS (SELECT candidate_id, coalesce(list(DISTINCT name) FILTER (name IS NOT NULL), []) AS names, coalesce(list(DISTINCT family) FILTER (family IS NOT NULL), []) AS known, count(family) AS total FROM e GROUP BY candidate_id),
l AS (SELECT candidate_id, family, count(*)::DOUBLE / any_value(total) AS p FROM e JOIN c USING (candidate_id) WHERE family IS NOT NULL GROUP BY ALL),
fired AS (SELECT candidate_id, family, priority FROM c CROSS JOIN (VALUES ('integer_overflow', 0), ('taint_api', 1), ('concurrency', 2)) f(family, priority)
  WHERE NOT list_contains(known, family) AND CASE WHEN candidate_id % 2 = 0 THEN CASE {_fires(routing.SEMANTIC_RULES)} END ELSE CASE {_fires(routing.OTHER_RULES)} END END)"""
_ROUTES = f"""s AS (SELECT candidate_id, family, p FROM l UNION ALL SELECT candidate_id, family, 0.3::DOUBLE FROM fired), t AS (SELECT candidate_id, family, p / sum(p) OVER (PARTITION BY candidate_id) AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY p DESC, family) AS n FROM t),
a AS (SELECT candidate_id, max(p) AS top1, max(p) - coalesce(max(p) FILTER (n = 2), 0) AS margin, -sum(p * ln(p)) AS entropy, list(family ORDER BY n) AS best FROM r GROUP BY candidate_id),
k AS (SELECT candidate_id, arg_min(family, (-p, family)) AS best_known FROM l GROUP BY candidate_id), f AS (SELECT candidate_id, arg_min(family, priority) AS first, list('{routing.FIRED}' || family ORDER BY family) AS said FROM fired GROUP BY candidate_id),
b AS (SELECT *, len(best) = 1 OR (top1 >= {_POLICY.confidence} AND margin >= {_POLICY.margin} AND entropy <= {_POLICY.most_entropy}) AS one FROM a LEFT JOIN k USING (candidate_id) LEFT JOIN f USING (candidate_id)),
m AS (SELECT *, CASE WHEN mode = 'forced_trigger' AND first IS NOT NULL THEN list_filter([first, best_known], lambda x: x IS NOT NULL) WHEN one THEN best[1:1] ELSE best[1:2] END AS selected,
  list_concat(CASE WHEN one THEN ['{routing.SURE}'] ELSE list_filter(['{routing.UNSURE}', CASE WHEN top1 < {_POLICY.confidence} THEN '{routing.LOW_CONFIDENCE}' END, CASE WHEN margin < {_POLICY.margin} THEN '{routing.LOW_MARGIN}' END, CASE WHEN entropy > {_POLICY.most_entropy} THEN '{routing.HIGH_ENTROPY}' END], lambda x: x IS NOT NULL) END,
    coalesce(said, []), CASE WHEN mode = 'forced_trigger' AND first IS NOT NULL THEN ['{routing.FORCED}' || first] ELSE [] END) AS reasons FROM b CROSS JOIN (VALUES ('score_fusion'), ('forced_trigger')) x(mode))"""


@query("feature_triggers", f"WITH {_ROUTED} SELECT candidate_id, family, 0.3::DOUBLE AS score FROM fired")
def feature_triggers(spark, sf):
    """Families that no model has learned and whose rule fires on the candidate's features."""
    r = routing.routes(_candidates(spark, sf), _POLICY)
    return r.select("candidate_id", F.explode("trigger_scores").alias("family", "score"))


@query("rule_routes", f"""WITH {_ROUTED}, {_ROUTES}
SELECT mode, candidate_id, round(top1, 9) AS top1, round(margin, 9) AS margin, round(entropy, 9) AS entropy, array_to_string(selected, ',') AS selected, array_to_string(list_sort(best), ',') AS available, array_to_string(reasons, '; ') AS reasons FROM m""")
def rule_routes(spark, sf):
    """Routes of all candidates in both modes; a candidate of which nothing is known is routed nowhere and left out."""
    c = written(_candidates(spark, sf), "candidates")
    both = [routing.routes(c, _POLICY, mode).withColumn("mode", F.lit(mode)) for mode in routing.MODES]
    r = both[0].unionByName(both[1]).where(F.size("available_families") > 0)
    return r.select("mode", "candidate_id", *[F.round(x, 9).alias(x) for x in ("top1", "margin", "entropy")], F.array_join("selected", ",").alias("selected"), F.array_join("available_families", ",").alias("available"), F.array_join("reasons", "; ").alias("reasons"))
