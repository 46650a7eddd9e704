"""Queries over code spans: joins, stage metrics, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidark.operators import calibration, metrics, ranking, spans
from evidark.plans.registry import query
from evidark.sources.tables import FAMILIES, SPANS, candidates, read, truths

GATE = 0.4


@query("span_overlap_join", f"WITH {SPANS} SELECT candidate_id, truth_id, case_id, file, score FROM pairs")
def span_overlap_join(spark, sf):
    return spans.overlap_join(candidates(spark, sf), truths(spark, sf))


@query("truth_hits_semi", f"WITH {SPANS} SELECT id, case_id, expert FROM truths WHERE id IN (SELECT truth_id FROM pairs)")
def truth_hits_semi(spark, sf):
    return spans.hits(truths(spark, sf), candidates(spark, sf)).select("id", "case_id", "expert")


@query("truth_miss_anti", f"WITH {SPANS} SELECT id, case_id, expert FROM truths WHERE id NOT IN (SELECT truth_id FROM pairs)")
def truth_miss_anti(spark, sf):
    return spans.misses(truths(spark, sf), candidates(spark, sf)).select("id", "case_id", "expert")


@query("truth_candidates", f"WITH {SPANS} SELECT id, case_id, score FROM candidates WHERE id IN (SELECT candidate_id FROM pairs)")
def truth_candidates(spark, sf):
    return spans.hits(candidates(spark, sf), truths(spark, sf)).select("id", "case_id", "score")


@query("label_candidates", f"""WITH {SPANS}, best AS (
  SELECT truth_id, t_expert, candidate_id, row_number() OVER (PARTITION BY truth_id ORDER BY line_end - line_start, -score, candidate_id) AS n FROM pairs)
SELECT candidate_id, string_agg(DISTINCT t_expert, ',' ORDER BY t_expert) AS labels FROM best WHERE n = 1 GROUP BY candidate_id""")
def label_candidates(spark, sf):
    out = spans.label_candidates(candidates(spark, sf), truths(spark, sf))
    return out.select("candidate_id", F.array_join("labels", ",").alias("labels"))


@query("finding_truth_expert", f"WITH {SPANS} SELECT candidate_id, truth_id, c_expert AS expert FROM pairs WHERE c_expert = t_expert")
def finding_truth_expert(spark, sf):
    """Overlap and the truth's own expert."""
    c, t = candidates(spark, sf).alias("c"), truths(spark, sf).alias("t")
    return c.join(t, spans.overlaps("c", "t", ("case_id", "file", "expert"))).select(F.col("c.id").alias("candidate_id"), F.col("t.id").alias("truth_id"), "c.expert")


@query("smallest_container", f"""WITH {SPANS}, held AS (
  SELECT t.id, c.id AS container_id, row_number() OVER (PARTITION BY t.id ORDER BY c.line_end - c.line_start, c.line_start, c.id) AS n
  FROM truths t JOIN candidates c ON t.case_id = c.case_id AND t.file = c.file AND c.line_start <= t.line_start AND c.line_end >= t.line_end)
SELECT id, container_id FROM held WHERE n = 1""")
def smallest_container(spark, sf):
    return spans.smallest_container(truths(spark, sf), candidates(spark, sf))


@query("point_in_interval", f"""WITH {SPANS}, held AS (
  SELECT t.id, t.line_start + 1 AS line, c.id AS interval_id, row_number() OVER (PARTITION BY t.id ORDER BY c.line_end - c.line_start, c.line_start, c.id) AS n
  FROM truths t JOIN candidates c ON t.case_id = c.case_id AND t.file = c.file AND t.line_start + 1 BETWEEN c.line_start AND c.line_end)
SELECT id, line, interval_id FROM held WHERE n = 1""")
def point_in_interval(spark, sf):
    points = truths(spark, sf).select("id", "case_id", "file", (F.col("line_start") + 1).alias("line"))
    return spans.point_in_interval(points, candidates(spark, sf))


@query("nearest_match", f"""WITH {SPANS}, near AS (
  SELECT t.id, c.id AS target_id, abs(t.line_start - c.line_start) AS distance, row_number() OVER (PARTITION BY t.id ORDER BY abs(t.line_start - c.line_start), c.id) AS n
  FROM truths t JOIN candidates c ON t.case_id = c.case_id AND t.file = c.file)
SELECT id, target_id, distance FROM near WHERE n = 1""")
def nearest_match(spark, sf):
    return spans.nearest_match(truths(spark, sf), candidates(spark, sf))


@query("near_span_pairs", f"""WITH {SPANS} SELECT a.id AS a_id, b.id AS b_id FROM truths a JOIN truths b
  ON a.case_id = b.case_id AND a.file = b.file AND a.expert = b.expert AND a.line_start <= b.line_end + 2 AND b.line_start <= a.line_end + 2 AND a.id < b.id""")
def near_span_pairs(spark, sf):
    return spans.near_span_pairs(truths(spark, sf))


@query("ordered_pair_self_join", f"""WITH {SPANS} SELECT a.case_id AS symbol, a.id AS first_id, b.id AS second_id FROM spans a JOIN spans b
  ON a.case_id = b.case_id WHERE a.flag = 'R' AND b.flag = 'A' AND a.line_start < b.line_start""")
def ordered_pair_self_join(spark, sf):
    from evidark.sources.tables import spans as all_spans

    return spans.ordered_pairs(all_spans(spark, sf), "case_id", "line_start", F.col("flag") == "R", F.col("flag") == "A")


@query("greedy_match", f"""WITH RECURSIVE {SPANS}, f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY -score, id) AS n FROM candidates), t AS (SELECT case_id, list({{'id': id, 'file': file, 'a': line_start, 'b': line_end}} ORDER BY line_start, id) AS ts FROM truths GROUP BY case_id),
s AS (SELECT case_id, 0::BIGINT AS n, NULL::VARCHAR AS finding_id, NULL::VARCHAR AS truth_id, ts FROM t
  UNION ALL SELECT case_id, n, finding_id, truth_id, list_filter(ts, lambda x: truth_id IS NULL OR x.id <> truth_id) FROM (SELECT f.case_id, f.n, f.id AS finding_id, list_filter(s.ts, lambda x: x.file = f.file AND f.line_start <= x.b AND f.line_end >= x.a)[1].id AS truth_id, s.ts FROM s JOIN f ON f.case_id = s.case_id AND f.n = s.n + 1))
SELECT case_id, finding_id, truth_id FROM s WHERE truth_id IS NOT NULL""")
def greedy_match(spark, sf):
    return spans.greedy_match(candidates(spark, sf), truths(spark, sf))


@query("analyzer_metrics", f"""WITH {SPANS},
h AS (SELECT count(*) AS truths_hit FROM truths WHERE id IN (SELECT truth_id FROM pairs)),
t AS (SELECT count(*) AS truths, count(DISTINCT case_id) AS truth_cases FROM truths),
c AS (SELECT count(*) AS candidates, count(DISTINCT case_id) AS cases, avg(greatest(line_end - line_start + 1, 1)) AS mean_lines, median(greatest(line_end - line_start + 1, 1)) AS median_lines FROM candidates)
SELECT *, truths_hit::DOUBLE / truths AS recall, candidates::DOUBLE / cases AS per_case, candidates::DOUBLE / truths AS per_truth FROM t, h, c""")
def analyzer_metrics(spark, sf):
    return metrics.analyzer_metrics(candidates(spark, sf), truths(spark, sf))


@query("grouping_sets_metrics", f"""WITH {SPANS}, f AS (SELECT t.id, t.expert, CASE WHEN t.project % 10 < 7 THEN 'train' ELSE 'test' END AS split, t.id IN (SELECT truth_id FROM pairs) AS hit FROM truths t)
SELECT split, expert, count(*) AS truths, count(*) FILTER (hit) AS hits, (count(*) FILTER (hit))::DOUBLE / count(*) AS recall FROM f GROUP BY GROUPING SETS ((), (split), (expert), (split, expert))""")
def grouping_sets_metrics(spark, sf):
    t, c = truths(spark, sf).alias("t"), candidates(spark, sf).alias("c")
    flags = t.join(c, spans.overlaps("t", "c"), "left").groupBy("t.id", "t.expert", "t.project").agg(F.max(F.col("c.id").isNotNull()).alias("hit"))
    flags = flags.withColumn("split", F.when(F.col("project") % 10 < 7, "train").otherwise("test"))
    out = flags.groupingSets([[], ["split"], ["expert"], ["split", "expert"]], "split", "expert").agg(F.count(F.lit(1)).alias("truths"), F.count_if("hit").alias("hits"))
    return out.withColumn("recall", metrics.ratio(F.col("hits"), F.col("truths")))


@query("stage_decomposition", f"""WITH {SPANS}, f AS (SELECT t.id, t.expert, bool_or(p.candidate_id IS NOT NULL) AS hit, bool_or(p.score >= {GATE}) AS kept, bool_or(p.score >= {GATE} AND p.c_expert = t.expert) AS routed
  FROM truths t LEFT JOIN pairs p ON p.truth_id = t.id GROUP BY t.id, t.expert),
g AS (SELECT expert, count(*) AS truths, count(*) FILTER (hit) AS hit, count(*) FILTER (kept) AS kept, count(*) FILTER (routed) AS routed FROM f GROUP BY expert)
SELECT expert, truths, hit, kept, routed, hit::DOUBLE / truths AS recall, CASE WHEN hit = 0 THEN 1.0 ELSE kept::DOUBLE / hit END AS retention, kept::DOUBLE / truths AS gated_recall,
  CASE WHEN kept = 0 THEN 0.0 ELSE routed::DOUBLE / kept END AS conditional, routed::DOUBLE / truths AS end_to_end FROM g""")
def stage_decomposition(spark, sf):
    return metrics.stage_decomposition(candidates(spark, sf), truths(spark, sf), GATE, F.col("c.expert") == F.col("t.expert"))


@query("gate_filter", f"WITH {SPANS} SELECT id, score, score >= {GATE} AS accepted FROM candidates")
def gate_filter(spark, sf):
    """Decisions are kept for all candidates."""
    return candidates(spark, sf).select("id", "score", (F.col("score") >= GATE).alias("accepted"))


@query("gate_metrics", f"WITH {SPANS} SELECT count(*) FILTER (score >= {GATE}) AS accepted, count(*) FILTER (score < {GATE}) AS rejected, (count(*) FILTER (score < {GATE}))::DOUBLE / count(*) AS reduction FROM candidates")
def gate_metrics(spark, sf):
    out = candidates(spark, sf).agg(F.count_if(F.col("score") >= GATE).alias("accepted"), F.count_if(F.col("score") < GATE).alias("rejected"))
    return out.withColumn("reduction", metrics.ratio(F.col("rejected"), F.col("accepted") + F.col("rejected")))


@query("gate_eval", f"""WITH {SPANS}, b AS (SELECT t.id, max(p.score) AS best FROM truths t LEFT JOIN pairs p ON p.truth_id = t.id GROUP BY t.id),
h AS (SELECT count(*) AS truths, count(best) AS hit, count(*) FILTER (best >= {GATE}) AS held FROM b),
o AS (SELECT count(*) FILTER (score >= {GATE}) AS kept, count(*) FILTER (score < {GATE}) AS rejected FROM candidates)
SELECT *, hit::DOUBLE / truths AS recall, held::DOUBLE / truths AS gated_recall, held::DOUBLE / hit AS retention, rejected::DOUBLE / (kept + rejected) AS reduction FROM h, o""")
def gate_eval(spark, sf):
    return calibration.gate_evaluation(candidates(spark, sf), truths(spark, sf), GATE)


@query("gate_calibration", f"""WITH {SPANS}, best AS (SELECT truth_id, max(score) AS score FROM pairs GROUP BY truth_id),
n AS (SELECT (SELECT count(*) FROM candidates) AS kept, (SELECT count(*) FROM best) AS held),
ks AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS kept FROM candidates GROUP BY score),
hs AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS held FROM best GROUP BY score),
th AS (SELECT score FROM candidates UNION SELECT 0.0 UNION SELECT 1.0),
s AS (SELECT th.score AS threshold, coalesce(k.kept, 0) AS kept, coalesce(h.held, 0) AS held FROM th ASOF LEFT JOIN ks k ON k.score >= th.score ASOF LEFT JOIN hs h ON h.score >= th.score),
r AS (SELECT threshold, s.kept, s.held::DOUBLE / n.held AS retention, 1 - s.kept::DOUBLE / n.kept AS reduction FROM s, n)
SELECT threshold, retention, CAST(kept AS BIGINT) AS kept, reduction FROM r ORDER BY retention < 0.98, CASE WHEN retention >= 0.98 THEN 0 ELSE -retention END, kept, CASE WHEN retention >= 0.98 THEN -threshold ELSE threshold END LIMIT 1""")
def gate_calibration(spark, sf):
    return calibration.gate_calibration(candidates(spark, sf), truths(spark, sf))


@query("topk_per_group", f"WITH {SPANS}, r AS (SELECT id, case_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, file, line_start, id) AS rank FROM candidates WHERE score >= {GATE}) SELECT * FROM r WHERE rank <= 3")
def topk_per_group(spark, sf):
    kept = candidates(spark, sf).where(F.col("score") >= GATE)
    return ranking.top_k(kept, ["case_id"], 3, F.desc("score"), F.asc("file"), F.asc("line_start"), F.asc("id")).select("id", "case_id", "score", "rank")


@query("hard_negatives", f"""WITH {SPANS}, c AS (SELECT id, case_id, score, id IN (SELECT candidate_id FROM pairs) AS positive FROM candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, positive ORDER BY score DESC, id) AS nth, count(*) FILTER (positive) OVER (PARTITION BY case_id) AS p, count(*) FILTER (NOT positive) OVER (PARTITION BY case_id) AS n FROM c),
q AS (SELECT *, least(p, 4 - least(1, n, 4)) AS taken FROM r)
SELECT id, case_id, score, positive FROM q WHERE nth <= CASE WHEN positive THEN taken ELSE 4 - taken END""")
def hard_negatives(spark, sf):
    c = candidates(spark, sf)
    positive = spans.hits(c, truths(spark, sf)).select("id").withColumn("hit", F.lit(True))
    marked = c.join(positive, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return ranking.hard_negatives(marked, "case_id", F.col("hit"), 4, 1, F.desc("score"), F.asc("id")).select("id", "case_id", "score", "positive")


@query("diverse_order", f"""WITH {SPANS}, s AS (SELECT id, expert, case_id, row_number() OVER (PARTITION BY expert, case_id ORDER BY id) > 1 AS again FROM truths)
SELECT id, expert, CAST(again AS INTEGER) AS repeat, row_number() OVER (PARTITION BY expert ORDER BY again, id) AS turn FROM s""")
def diverse_order(spark, sf):
    return ranking.diverse_order(truths(spark, sf), "expert", "case_id", F.asc("id")).select("id", "expert", "repeat", "turn")


@query("round_robin", f"""WITH {SPANS}, r AS (SELECT id, expert, row_number() OVER (PARTITION BY expert ORDER BY sha256(id)) AS turn FROM truths) SELECT id, expert, turn, row_number() OVER (ORDER BY turn, expert) AS position FROM r""")
def round_robin(spark, sf):
    rows = truths(spark, sf).select("id", "expert", F.sha2("id", 256).alias("digest"))
    return ranking.round_robin(rows, "expert", F.col("digest"), bin_=F.substring("digest", 1, 3)).select("id", "expert", "turn", "position")


def told_findings(spark, sf):
    """Findings made from the known spans: sinks, evidence and paths by their numbers, as the tables hold none."""
    n = lambda c, k: (F.col(c) % k).cast("string")
    cwes = F.element_at(F.array(*[F.array(F.lit(c)) for c in _CWES], F.array().cast("array<string>")), (F.col("project") % 7 + 1).cast("int"))
    return truths(spark, sf).select(
        F.col("id").alias("finding_no"), F.col("id").alias("finding_id"), "case_id", F.col("case_id").cast("string").alias("candidate_id"), "file", F.lit("f").alias("function"), "expert", "line_start", "line_end", cwes.alias("cwes"), F.col("score").alias("confidence"),
        F.concat(F.lit("m"), n("project", 3)).alias("model_id"), F.when(F.col("project") % 3 > 0, F.concat(F.lit("copy("), n("project", 5), F.lit(")"))).otherwise("").alias("sink"), F.array(F.concat(F.lit("e"), n("project", 9))).alias("evidence_ids"),
        F.when(F.col("line_start") % 4 == 0, F.array(F.concat(F.lit("p"), n("line_end", 6)))).otherwise(F.array().cast("array<string>")).alias("trigger_path"), F.lit("user").alias("source"),
        F.element_at(F.array(*map(F.lit, _SAID)), (F.col("line_end") % 5 + 1).cast("int")).alias("title"), F.lit("").alias("root_cause"), F.lit("").alias("consequence"), F.lit("").alias("missing_guard"),
    )


_CWES = ["CWE-787", "CWE-416", "CWE-190", "CWE-78", "CWE-252", "CWE-362"]
_SAID = ["Use-after-free of a node", "unchecked length", "Tainted format string", "nothing in particular", "integer overflow in size"]
_TOLD = f"""told AS (SELECT id, case_id, file, expert, line_start, line_end, score, project, CASE WHEN project % 7 < 6 THEN [{_CWES}[project % 7 + 1]] ELSE [] END AS cwes, 'm' || project % 3 AS model,
  CASE WHEN project % 3 > 0 THEN 'copy(' || project % 5 || ')' ELSE '' END AS sink, 'e' || project % 9 AS evidence, CASE WHEN line_start % 4 = 0 THEN 'p' || line_end % 6 END AS step, {_SAID}[line_end % 5 + 1] AS title FROM truths),
linked AS (SELECT a.id AS a, b.id AS b FROM told a JOIN told b ON a.case_id = b.case_id AND a.file = b.file AND ((a.line_start <= b.line_end + 2 AND b.line_start <= a.line_end + 2) OR (a.sink <> '' AND a.sink = b.sink) OR a.evidence = b.evidence OR a.step = b.step)),
reach(id, component) USING KEY (id) AS (SELECT a, min(b) FROM linked GROUP BY a UNION (SELECT l.a, min(r.component) FROM linked l JOIN reach r ON r.id = l.b JOIN recurring.reach o ON o.id = l.a GROUP BY l.a HAVING min(r.component) < min(o.component)))"""


@query("finding_components", f"WITH RECURSIVE {SPANS}, {_TOLD} SELECT id, component FROM reach")
def finding_components(spark, sf):
    """Components of findings that meet by lines, sink, evidence or path."""
    from evidark.operators.findings import PLACE, caused

    f = told_findings(spark, sf).select(F.col("finding_id").alias("key"), *PLACE, "line_start", "line_end", "sink", "evidence_ids", "trigger_path")
    return caused(f).select(F.col("key").alias("id"), F.col("root").alias("component"))


@query("fuse_groups", f"""WITH RECURSIVE {SPANS}, {_TOLD}, g AS (SELECT component, told.* FROM told JOIN reach USING (id)), best AS (SELECT component, arg_min(title, (-score, id)) AS title FROM g GROUP BY component)
SELECT CAST(case_id AS VARCHAR) AS candidate_id, file, any_value(best.title) AS title, count(*) AS merged, least(1.0, max(score) + 0.03 * (count(DISTINCT expert) - 1) + 0.02 * (count(DISTINCT model) - 1)) AS confidence, min(line_start) AS line_start, max(line_end) AS line_end,
  string_agg(DISTINCT expert, ',' ORDER BY expert) AS experts, string_agg(DISTINCT model, ',' ORDER BY model) AS models, coalesce(string_agg(DISTINCT cwes[1], ',' ORDER BY cwes[1]), '') AS cwes, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence_ids
FROM g JOIN best USING (component) GROUP BY component, case_id, file""")
def fuse_groups(spark, sf):
    """Findings of one cause as one."""
    from evidark.operators.findings import fuse

    joined = [F.array_join(c, ",").alias(c) for c in ("experts", "models", "cwes", "evidence_ids")]
    return fuse(told_findings(spark, sf)).select("candidate_id", "file", "title", "merged", "confidence", "line_start", "line_end", *joined)


@query("fuse_unnumbered", f"""WITH RECURSIVE {SPANS}, {_TOLD}, g AS (SELECT component, told.* FROM told JOIN reach USING (id))
SELECT CAST(case_id AS VARCHAR) AS candidate_id, file, count(*) AS merged, min(line_start) AS line_start, max(line_end) AS line_end, least(1.0, max(score) + 0.03 * (count(DISTINCT expert) - 1) + 0.02 * (count(DISTINCT model) - 1)) AS confidence,
  coalesce(string_agg(DISTINCT cwes[1], ',' ORDER BY cwes[1]), '') AS cwes FROM g GROUP BY component, case_id, file""")
def fuse_unnumbered(spark, sf):
    """Findings as they come from answers, without a number: all of them, each cause once."""
    from evidark.operators.findings import fuse

    return fuse(told_findings(spark, sf).drop("finding_no")).select("candidate_id", "file", "merged", "line_start", "line_end", "confidence", F.array_join("cwes", ",").alias("cwes"))


@query("feature_pivot", f"""WITH {SPANS} SELECT case_id, {', '.join(f"count(*) FILTER (expert = '{f}') AS {f}_count" for f in FAMILIES)}, coalesce(max(score) FILTER (expert = '{FAMILIES[0]}'), 0) AS memory_score FROM truths GROUP BY case_id""")
def feature_pivot(spark, sf):
    """Counts of each kind, zero filled, over a fixed list of names."""
    named = [F.count_if(F.col("expert") == f).alias(f"{f}_count") for f in FAMILIES]
    return truths(spark, sf).groupBy("case_id").agg(*named, F.coalesce(F.max(F.when(F.col("expert") == FAMILIES[0], F.col("score"))), F.lit(0.0)).alias("memory_score"))


@query("hypothesis_agg", f"""WITH {SPANS}, h AS (SELECT case_id, project % 20 AS cwe, max(score) AS confidence, count(DISTINCT id) AS evidence FROM truths GROUP BY case_id, project % 20),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, cwe) AS rank FROM h) SELECT * FROM r WHERE rank <= 8""")
def hypothesis_agg(spark, sf):
    h = truths(spark, sf).groupBy("case_id", (F.col("project") % 20).alias("cwe")).agg(F.max("score").alias("confidence"), F.countDistinct("id").alias("evidence"))
    return ranking.top_k(h, ["case_id"], 8, F.desc("confidence"), F.asc("cwe"))


@query("smallest_label_join_counts", f"WITH {SPANS} SELECT c_expert AS expert, t_expert AS label, count(*) AS n, count(DISTINCT truth_id) AS truths FROM pairs GROUP BY 1, 2")
def smallest_label_join_counts(spark, sf):
    c, t = candidates(spark, sf).alias("c"), truths(spark, sf).alias("t")
    joined = c.join(t, spans.overlaps("c", "t"))
    return joined.groupBy(F.col("c.expert").alias("expert"), F.col("t.expert").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t.id").alias("truths"))


_KINDS = ["memory_copy", "use_after_release", "arithmetic_to_memory_sink", "source_to_sink", "state", "toctou", "guard_protects_sink", "unchecked_nullable_dereference", "memory_sink"]
_OWNER = "list_transform(range(9), lambda k: 'e' || k)"


def evidence_table(spark, sf):
    """A candidate for each case of the findings: evidence of all kinds; its file, function and version by its number."""
    k = F.col("case_id")
    sink = F.when(k % 2 == 0, (k % 60).cast("string"))
    facts = lambda kind: F.create_map(F.lit("semantically_protective"), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("sink_line"), sink)
    held = [F.struct(F.lit(f"e{i}").alias("evidence_id"), F.lit(kind).alias("kind"), facts(kind).alias("facts")) for i, kind in enumerate(_KINDS)]
    evidence = F.filter(F.array(*held), lambda e: e["evidence_id"] != F.concat(F.lit("e"), (k % 10).cast("string")))
    return truths(spark, sf).select("case_id").distinct().select(
        k.cast("string").alias("candidate_id"), (k % 5 == 0).cast("int").alias("file"), F.when(k % 11 == 0, "g").otherwise("f").alias("function"), F.lit(5).alias("line_start"), (F.lit(40) + k % 30).cast("int").alias("line_end"), evidence.alias("evidence"),
        F.when(k % 4 == 0, F.create_map(F.lit("bounds_guard_count"), F.lit(1.0), F.lit("guard_density"), F.lit(1.5))).otherwise(F.create_map(F.lit("x"), F.lit(0.0))).alias("features"), F.element_at(F.array(F.lit("v1"), F.lit("semantic-cwe-v2")), (k % 2 + 1).cast("int")).alias("feature_schema_version"),
    )


_CATEGORY = "CASE cwes[1] WHEN 'CWE-787' THEN 'memory_spatial' WHEN 'CWE-416' THEN 'memory_temporal' WHEN 'CWE-190' THEN 'integer' WHEN 'CWE-78' THEN 'taint_api' WHEN 'CWE-252' THEN 'control_state' WHEN 'CWE-362' THEN 'concurrency' END"
_CITED = f"""cited AS (SELECT *, {_CATEGORY} AS claimed, 'e' || case_id % 10 <> evidence AS held, CASE WHEN 'e' || case_id % 10 <> evidence THEN {_KINDS}[project % 9 + 1] END AS kind FROM told),
meant AS (SELECT *, CASE kind WHEN 'memory_copy' THEN 'memory_spatial' WHEN 'memory_sink' THEN 'memory_spatial' WHEN 'use_after_release' THEN 'memory_temporal' WHEN 'unchecked_nullable_dereference' THEN 'memory_temporal' WHEN 'arithmetic_to_memory_sink' THEN 'integer' WHEN 'source_to_sink' THEN 'taint_api' WHEN 'state' THEN 'control_state' WHEN 'toctou' THEN 'concurrency' END AS shown FROM cited)"""


@query("validate_rules", f"""WITH RECURSIVE {SPANS}, {_TOLD}, {_CITED}, c AS (SELECT *, file = CAST(case_id % 5 = 0 AS INTEGER) AS file_matches, case_id % 11 <> 0 AS function_matches, line_start <= 40 + case_id % 30 AND line_end >= 5 AS line_reachable, held AS evidence_ids_valid, len(cwes) > 0 AS cwe_present,
    coalesce(claimed = shown OR (claimed = 'memory_spatial' AND kind = 'arithmetic_to_memory_sink'), FALSE) AS cwe_semantics_supported, score >= 0.55 AS confidence_sufficient,
    expert = 'memory_bounds' AND NOT coalesce(kind IN ('use_after_release', 'unchecked_nullable_dereference'), FALSE) AND CASE WHEN case_id % 2 = 1 THEN case_id % 3 = 0 AND case_id % 10 <> 6 AND (case_id % 2 = 1 OR case_id % 60 BETWEEN line_start AND line_end) ELSE case_id % 4 = 0 END AS contradicting_guard FROM meant)
SELECT id, file_matches, function_matches, line_reachable, TRUE AS evidence_exists, evidence_ids_valid, cwe_present, cwe_semantics_supported, confidence_sufficient, contradicting_guard,
  CASE WHEN NOT (file_matches AND function_matches AND line_reachable AND evidence_ids_valid) OR (case_id % 2 = 1 AND NOT (cwe_present AND cwe_semantics_supported)) OR contradicting_guard THEN 'rejected' WHEN NOT confidence_sufficient THEN 'uncertain' ELSE 'validated' END AS verdict FROM c""")
def validate_rules(spark, sf):
    """The nine checks and the verdict of every finding."""
    from evidark.functions.scores import HARD_CHECKS, SEMANTIC_CHECKS
    from evidark.operators.findings import validate

    names = [*HARD_CHECKS, *SEMANTIC_CHECKS, "confidence_sufficient", "contradicting_guard"]
    out = validate(told_findings(spark, sf), evidence_table(spark, sf))
    return out.select(F.col("finding_id").alias("id"), *[F.col("checks")[n].alias(n) for n in names], "verdict")


@query("semantic_match", f"""WITH RECURSIVE {SPANS}, {_TOLD}, {_CITED}, f AS (SELECT *, CASE WHEN claimed IS NOT NULL THEN claimed WHEN title = '{_SAID[0]}' THEN 'memory_temporal' WHEN title = '{_SAID[1]}' THEN 'memory_spatial' WHEN title = '{_SAID[2]}' THEN 'taint_api' WHEN title = '{_SAID[4]}' THEN 'integer'
    WHEN kind = 'unchecked_nullable_dereference' THEN 'control_state' ELSE shown END AS meaning FROM meant),
w AS (SELECT f.id AS finding_id, c.id AS truth_id, held AS evidence_valid, meaning, CASE c.expert WHEN 'memory_bounds' THEN ['memory_spatial', 'memory_temporal'] WHEN 'lifetime_resource' THEN ['memory_temporal'] WHEN 'integer_overflow' THEN ['integer'] ELSE [c.expert] END AS meant,
    kind, sink FROM f JOIN candidates c ON f.case_id = c.case_id AND f.file = c.file AND f.line_start <= c.line_end AND f.line_end >= c.line_start),
r AS (SELECT *, coalesce(list_contains(meant, meaning) OR (meaning = 'integer' AND list_contains(meant, 'memory_spatial') AND coalesce(kind = 'arithmetic_to_memory_sink', FALSE)) OR (meaning = 'taint_api' AND (list_contains(meant, 'memory_spatial') OR list_contains(meant, 'control_state')) AND coalesce(kind = 'source_to_sink', FALSE) AND sink <> ''), FALSE) AS semantic_compatible FROM w)
SELECT finding_id, truth_id, evidence_valid, semantic_compatible, evidence_valid AND semantic_compatible AS matched, array_to_string(meant, ',') AS truth_categories, coalesce(meaning, '') AS finding_categories,
  CASE WHEN evidence_valid AND semantic_compatible THEN 'matched' ELSE 'failed: ' || concat_ws(', ', CASE WHEN NOT evidence_valid THEN 'evidence' END, CASE WHEN NOT semantic_compatible THEN 'semantics' END) END AS reason FROM r""")
def semantic_match(spark, sf):
    """Findings against open spans as truths: place, evidence and meaning."""
    from evidark.operators.findings import match_outcomes

    none = F.array().cast("array<string>")
    t = candidates(spark, sf).select(F.col("id").alias("truth_id"), "case_id", "file", "line_start", "line_end", none.alias("cwes"), F.array("expert").alias("experts"))
    out = match_outcomes(told_findings(spark, sf), t, evidence_table(spark, sf))
    return out.drop("location_match").withColumns({c: F.array_join(c, ",") for c in ("truth_categories", "finding_categories")})


@query("brace_regions", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(sum((length(line) - length(replace(line, 'T', ''))) - (length(line) - length(replace(line, '.', '')))) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS depth FROM l""")
def brace_regions(spark, sf):
    """Depth by line; the test texts hold no braces, so T opens and a full stop closes."""
    from evidark.functions.text import brace_depth

    return brace_depth(read(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "T", ".")
