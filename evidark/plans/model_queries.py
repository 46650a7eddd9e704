"""Queries that fit a model or replay a stream: their rows are checked in tests rather than by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidark.functions.cfront.candidates import analyse_files
from evidark.operators import fitting, models, policies
from evidark.plans.outcome_queries import full_outcomes
from evidark.plans.registry import query
from evidark.sources.session import written
from evidark.sources.tables import labelled, outcomes, read
from evidark.streaming.replay import windowed_counts


@query("softmax_router")
def softmax_router(spark, sf):
    """Fitted on all components of four fifths of the vectors; every vector gets a prediction."""
    held_out = F.coalesce(F.col("vec_id") % 5 == 0, F.lit(False))
    rows = read(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), held_out.alias("held_out"), "embedding")
    model = models.fit_vectors(rows.where("NOT held_out"), "embedding", "label", most_iterations=25)
    top = F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"], e["key"])))
    return model.predict_vectors(rows, "embedding").select("vec_id", "label", "held_out", top["key"].alias("predicted"), top["value"].alias("p"))


@query("binary_router")
def binary_router(spark, sf):
    rows = labelled(spark, sf).select("doc_id", (F.col("quality") == 1).alias("y"), F.create_map(F.lit("p"), F.col("p"), F.lit("n"), F.log1p("n_chars")).alias("features"))
    model = models.fit_binary(rows, ["p", "n"], "y")
    return model.predict(rows).select("doc_id", F.col("scores")["yes"].alias("p"))


@query("utility_models")
def utility_models(spark, sf):
    """A success model for every assignment, all fitted in one pass an iteration."""
    o = outcomes(spark, sf).withColumn("features", F.create_map(F.lit("tokens"), F.col("tokens").cast("double"), F.lit("p"), F.col("probability")))
    o = written(o, "outcomes")  # read by the fit and the prediction
    return fitting.fit_groups(o, ["tokens", "p"], "assignment", "success").predict(o, F.col("assignment")).select("candidate_id", "assignment", "p")


def gated(spark, sf):
    """Outcomes with places, and every candidate's chance, by the fitted gate, that the best two suffice."""
    o = written(policies.ranked(full_outcomes(spark, sf)), "ranked")
    experts = sorted(r[0] for r in o.select("assignment").distinct().collect())  # event types
    enough = fitting.best_two_suffice(o, ["candidate_id"])
    by = o.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("assignment", "probability"))).alias("chances"), F.transform(F.array_sort(F.collect_list(F.struct("place", "assignment"))), lambda x: x["assignment"]).alias("order"), F.max("tokens").cast("double").alias("most"))
    rows = by.withColumn("gate", fitting.gate_features(F.create_map(F.lit("most_tokens"), F.col("most")), F.lit(0.0), F.col("chances"), F.col("order"), experts)).join(enough, "candidate_id")
    rows = written(rows.select("candidate_id", "gate", "sufficient"), "gate")
    return o, fitting.EscalationGate().fit(rows).transform(rows).select("candidate_id", "sufficient", "confidence")


@query("escalation_gate")
def escalation_gate(spark, sf):
    return gated(spark, sf)[1]


@query("gated_policy")
def gated_policy(spark, sf):
    """All measures of the policy that takes every expert where the fitted gate doubts the best two."""
    o, chance = gated(spark, sf)
    choice = policies.baselines(o, [], 0.0, chance.select("candidate_id", (F.col("confidence") < 0.5).alias("escalate")))
    return policies.evaluate(o, choice.where("policy = 'adaptive_gate'"))


# Small C functions; each document's id picks one, so that the parser sees as many files as the table has rows.
SNIPPETS = (
    "void f(char *d, char *s, int len, int cap) { if (len > cap) return; memcpy(d, s, len); }",
    "void f(char *d, char *s, int len) { memcpy(d, s, len * 2); }",
    "void f(char *p) { free(p); p->x = 1; free(p); }",
    "void f(int fd) { char buf[100]; read(fd, buf, 100); char *cmd = buf; system(cmd); }",
    "int f(int n) { int *p = malloc(n * sizeof(int)); for (int i = 0; i < n; i++) p[i] = i; return p[n]; }",
    "void f(char *n) { if (access(n, 0) == 0) { fopen(n, \"r\"); } }",
    "int f(int a) { int x; if (a) x = 1; return x; }",
)


@query("front_end_candidates")
def front_end_candidates(spark, sf):
    code = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    files = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("a.c").alias("file"), code.alias("source"))
    out = analyse_files(files)
    return out.select("case_id", "candidate_id", "function", F.round("suspicion_score", 9).alias("score"), F.size("evidence").alias("facts"), F.array_join(F.transform("hypotheses", lambda h: h["cwe"]), ",").alias("cwes"))


@query("windowed_events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    """The streaming aggregate run as a batch."""
    return windowed_counts(read(spark, sf, "events")).select(F.col("window.start").alias("day"), "event_type", "n")
