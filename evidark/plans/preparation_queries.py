"""Queries that prepare labelled cases: filters, truths, splits, audits, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidark.functions import names, taxonomy
from evidark.operators import cases, preparation, scenarios, splits
from evidark.plans.registry import query
from evidark.sources.tables import SPANS, candidates, read, truths

_W = ", ".join(f"({n}, '{c}', '{x}')" for n, c, x in taxonomy.weaknesses())
_PATHS = f"w(number, category, expert) AS (VALUES {_W}), f AS (SELECT p_partkey, 'CWE' || lpad(CAST(p_partkey % 900 AS VARCHAR), 4, '0') || '/' || p_name AS path FROM part), n AS (SELECT f.*, w.number, category, expert FROM f LEFT JOIN w ON w.number = p_partkey % 900)"
_ALLOWED = ["memory_bounds", "taint_api", "concurrency"]


def _files(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.concat(F.lit("CWE"), F.lpad((F.col("p_partkey") % 900).cast("string"), 4, "0"), F.lit("/"), F.col("p_name")).alias("path"))


@query("supported_files", f"WITH {_PATHS} SELECT p_partkey, path, CAST(number AS INTEGER) AS number, category, expert FROM n WHERE expert IN ('memory_bounds', 'taint_api', 'concurrency')")
def supported_files(spark, sf):
    return preparation.supported(_files(spark, sf), "path", _ALLOWED)[0].select("p_partkey", "path", "number", "category", "expert")


@query("unsupported_count", f"WITH {_PATHS} SELECT count(*) FILTER (coalesce(expert IN ('memory_bounds', 'taint_api', 'concurrency'), FALSE)) AS supported, count(*) FILTER (NOT coalesce(expert IN ('memory_bounds', 'taint_api', 'concurrency'), FALSE)) AS unsupported FROM n")
def unsupported_count(spark, sf):
    return preparation.supported(_files(spark, sf), "path", _ALLOWED)[1]


@query("marked_lines", r"WITH d AS (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d) SELECT doc_id, CAST(n AS INTEGER) AS line FROM l WHERE regexp_matches(line, '(?i)license')")
def marked_lines(spark, sf):
    """Lines that hold a mark; in code it is a flaw's, here a licence's."""
    return preparation.marked_lines(read(spark, sf, "documents"), ["doc_id"], "text", "(?i)license")


@query("truth_spans", f"""WITH {SPANS}, m AS (SELECT DISTINCT c.id, t.line_start AS line FROM candidates c JOIN truths t ON c.case_id = t.case_id AND c.file = t.file AND t.line_start BETWEEN c.line_start AND c.line_end)
SELECT case_id, file, id AS function, line AS line_start, line AS line_end, CAST(row_number() OVER (PARTITION BY id ORDER BY line) AS INTEGER) AS ordinal FROM m JOIN candidates USING (id)
UNION ALL SELECT case_id, file, id, line_start, line_end, 1 FROM candidates WHERE id NOT IN (SELECT id FROM m)""")
def truth_spans(spark, sf):
    """Marked lines of a function, or all of it."""
    f = candidates(spark, sf).select("case_id", "file", F.col("id").alias("function"), "line_start", "line_end")
    return preparation.truth_spans(f, truths(spark, sf).select("case_id", "file", F.col("line_start").alias("line")), ["case_id", "file"])


@query("valid_regions", r"SELECT doc_id, coalesce(doc_id % 4 >= 1 AND doc_id % 4 <= doc_id % 7 AND doc_id % 7 <= greatest(1, len(string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r'))), FALSE) AS valid FROM documents")
def valid_regions(spark, sf):
    d = F.col("doc_id")
    return read(spark, sf, "documents").select("doc_id", preparation.valid_region(F.col("text"), d % 4, d % 7).alias("valid"))


_STRATA = """pairs AS (SELECT DISTINCT o_orderpriority AS family, o_custkey FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('2026:' || family || ':' || o_custkey), o_custkey) AS place, count(*) OVER (PARTITION BY family) AS n FROM pairs),
s AS (SELECT *, greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) AS held FROM p), split AS (SELECT o_custkey, arg_max(CASE WHEN place > n - held THEN 'test' WHEN place > n - 2 * held THEN 'dev' ELSE 'train' END, family) AS split FROM s GROUP BY o_custkey)"""


@query("stratified_split", f"WITH {_STRATA} SELECT o_custkey, split FROM split")
def stratified_split(spark, sf):
    """Shares of each family; a project of several has the last one's split."""
    return splits.stratified_split(read(spark, sf, "orders"), "o_orderpriority", "o_custkey")


@query("inherited_split", "WITH d AS (SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY coalesce(text, chr(1))), doc_id) AS duplicate_of, CASE WHEN doc_id % 7 < 5 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT d.doc_id, d.duplicate_of, coalesce(o.split, d.split) AS split FROM d LEFT JOIN d o ON o.doc_id = d.duplicate_of")
def inherited_split(spark, sf):
    """Copies follow the document they copy."""
    d = splits.exact_duplicates(read(spark, sf, "documents").select("doc_id", "text"), [F.col("text")], "doc_id")
    d = d.select("doc_id", "duplicate_of", F.when(F.col("doc_id") % 7 < 5, "train").otherwise("test").alias("split"))
    return splits.inherited(d, "doc_id", "duplicate_of", "split")


@query("cohort_audit", f"""WITH {_STRATA}, w(number, category, expert) AS (VALUES {_W}), c AS (SELECT o_orderkey AS case_id, o_custkey AS project_id, split, ['memory_bounds', 'integer_overflow', 'taint_api', 'control_state', 'concurrency'][o_orderkey % 5 + 1] AS expert, o_orderkey % 97 AS exact_hash, o_totalprice AS canonical_hash FROM orders JOIN split USING (o_custkey)),
r AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 3 = 0 THEN 'negative' ELSE 'positive' END AS kind, l_linenumber AS line_start, 1 + CAST(l_quantity AS INTEGER) % 5 AS line_end, l_partkey % 900 AS number, ['memory_bounds', 'integer_overflow', 'taint_api', 'control_state', 'concurrency'][l_suppkey % 5 + 1] AS expert FROM lineitem),
bad AS (SELECT *, NOT (1 <= line_start AND line_start <= line_end AND line_end <= 4) AS invalid FROM r)
SELECT 'mapping_mismatch' AS check, count(*) FILTER (w.expert IS DISTINCT FROM r.expert) AS problems FROM r LEFT JOIN w USING (number) WHERE kind = 'positive'
UNION ALL SELECT 'invalid_positive_region', count(*) FILTER (invalid) FROM bad WHERE kind = 'positive' UNION ALL SELECT 'invalid_negative_region', count(*) FILTER (invalid) FROM bad WHERE kind = 'negative'
UNION ALL SELECT 'project_overlap', count(*) FROM (SELECT project_id FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'exact_hash_crosses_splits', count(*) FROM (SELECT exact_hash FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'canonical_hash_crosses_splits', count(*) FROM (SELECT canonical_hash FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'family_count', count(*) FILTER (coalesce(n, 0) <> 300) FROM (SELECT unnest(['memory_bounds', 'integer_overflow', 'taint_api', 'control_state', 'concurrency']) AS expert) LEFT JOIN (SELECT expert, count(*) AS n FROM c GROUP BY 1) USING (expert)
UNION ALL SELECT 'oracle_leak', count(*) FROM c WHERE exact_hash = 5 UNION ALL SELECT 'missing_negative_regions', greatest(0, (SELECT count(*) FROM c) - (SELECT count(*) FROM r WHERE kind = 'negative'))""")
def cohort_audit(spark, sf):
    """All checks of a cohort made from orders (cases) and their lines (regions)."""
    expert = lambda c: F.element_at(F.array(*map(F.lit, preparation.ACTIVE)), (F.col(c) % 5 + 1).cast("int"))
    split = splits.stratified_split(read(spark, sf, "orders"), "o_orderpriority", "o_custkey")
    cases = read(spark, sf, "orders").join(split, "o_custkey").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("project_id"), "split", expert("o_orderkey").alias("expert"), (F.col("o_orderkey") % 97).alias("exact_hash"), F.col("o_totalprice").alias("canonical_hash"))
    regions = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") % 3 == 0, "negative").otherwise("positive").alias("kind"), F.lit("a\nb\nc\nd\n").alias("source"), F.col("l_linenumber").alias("line_start"), (1 + F.round("l_quantity").cast("int") % 5).alias("line_end"), F.concat(F.lit("CWE-"), (F.col("l_partkey") % 900).cast("string")).alias("cwe"), expert("l_suppkey").alias("expert"))
    return preparation.audit_cohort(cases, regions, cases.where("exact_hash = 5").select("case_id"), 300)


@query("live_summary", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 20) AS v, count(*) FILTER (event_type = 'purchase' AND value > 20 AND event_id % 2 = 0) AS m, user_id % 4 AS t, user_id % 3 AS h, sum(CAST(value AS DECIMAL(24,9))) AS cost, count(*) AS p FROM events GROUP BY user_id),
s AS (SELECT count(*) AS case_count, CAST(sum(t) AS BIGINT) AS ground_truth_count, CAST(sum(h) AS BIGINT) AS matched_ground_truth_count, CAST(sum(v) AS BIGINT) AS validated_finding_count, CAST(sum(m) AS BIGINT) AS ground_truth_matched_finding_count, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(2 * sum(p) AS BIGINT) AS completion_tokens, CAST(sum(cost) AS DOUBLE) AS realized_cost_usd FROM c),
r AS (SELECT *, CASE WHEN validated_finding_count = 0 THEN 1.0 ELSE ground_truth_matched_finding_count::DOUBLE / validated_finding_count END AS validated_precision, CASE WHEN ground_truth_count = 0 THEN 1.0 ELSE matched_ground_truth_count::DOUBLE / ground_truth_count END AS ground_truth_recall FROM s)
SELECT *, CASE WHEN validated_precision + ground_truth_recall = 0 THEN 0.0 ELSE 2 * validated_precision * ground_truth_recall / (validated_precision + ground_truth_recall) END AS f1 FROM r""")
def live_summary(spark, sf):
    """Live runs made from events: a user is a case, a purchase a finding."""
    e = read(spark, sf, "events").withColumn("id", F.col("event_id").cast("string"))
    bought = F.col("event_type") == "purchase"
    finding = F.struct(F.col("id").alias("finding_id"), F.when(F.col("value") > 20, "validated").otherwise("rejected").alias("verdict"))
    matched = F.struct(F.col("id").alias("key"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("value"))
    ids = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < F.col("user_id") % n, i.cast("string"))), lambda x: x.isNotNull())
    rows = e.groupBy("user_id").agg(F.collect_list(F.when(bought, finding)).alias("validations"), F.map_from_entries(F.collect_list(F.when(bought, matched))).alias("matched_by_finding"), F.collect_list(F.struct(F.col("value").cast("double").alias("cost"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"))).alias("usage"))
    return preparation.live_summary(rows.withColumns({"ground_truth_ids": ids(4), "matched_truth_ids": ids(3)}))


@query("cached_candidates", f"WITH {SPANS}, k AS (SELECT DISTINCT case_id FROM spans), h AS (SELECT case_id, string_agg(id, ',' ORDER BY -score, file, line_start, id) AS ids FROM candidates GROUP BY case_id) SELECT case_id, coalesce(ids, '') AS ids FROM k LEFT JOIN h USING (case_id)")
def cached_candidates(spark, sf):
    """Every case with its candidates, best first."""
    from evidark.sources.tables import spans as all_spans

    cache = candidates(spark, sf).select("case_id", F.col("id").alias("candidate_id"), F.col("score").alias("suspicion_score"), "file", "line_start")
    out = preparation.with_cache(all_spans(spark, sf).select("case_id").distinct(), cache)
    return out.select("case_id", F.array_join(F.transform("candidates", lambda c: c["candidate_id"]), ",").alias("ids"))


@query("function_names", r"SELECT p_partkey, regexp_extract(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE list_last(string_split(p_type || '::' || p_name, '::')) END, '(\S+)\s*$', 1) AS function, coalesce(list_last(regexp_extract_all(p_type || ' f' || p_size || ' (a) ' || p_brand || '(b', '([A-Za-z_~]\w*)\s*\(', 1)), '') AS context FROM part")
def function_names(spark, sf):
    p = read(spark, sf, "part")
    signature = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("(int a)"))).otherwise(F.concat("p_type", F.lit("::"), "p_name", F.lit(" (char *)")))
    context = F.concat("p_type", F.lit(" f"), F.col("p_size").cast("string"), F.lit(" (a) "), "p_brand", F.lit("(b"))
    return p.select("p_partkey", names.function_name(signature).alias("function"), names.hunk_function(context).alias("context"))


@query("xml_escape", """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")
def xml_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.sha2(names.xml_escaped(F.col("html")), 256).alias("digest"))


@query("knowledge_text", "WITH k AS (SELECT item_id % 10 AS query_id, string_agg('[' || item_id || '] T' || (CASE WHEN item_id % 3 = 0 THEN ' source=s' ELSE '' END) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY item_id) AS said FROM benchmark GROUP BY 1) SELECT query_id, left(said, 400) AS said FROM k")
def knowledge_text(spark, sf):
    """Entries of a query as one bounded text."""
    e = F.struct("item_id", F.col("item_id").cast("string").alias("knowledge_id"), F.lit("T").alias("title"), F.when(F.col("item_id") % 3 == 0, "s").alias("source"), F.col("text").alias("content"))
    g = read(spark, sf, "benchmark").groupBy((F.col("item_id") % 10).alias("query_id")).agg(F.array_sort(F.collect_list(e)).alias("entries"))
    return g.select("query_id", names.knowledge_text(F.col("entries"), 400).alias("said"))


_CRASHES = ["Heap-double-free", "Heap-use-after-free READ 8", "Integer-overflow", "Heap-buffer-overflow WRITE 4", "Null-dereference", "abort"]
_CRASH = [("lifetime_resource", "CWE-415"), ("lifetime_resource", "CWE-416"), ("integer_overflow", "CWE-190"), ("memory_bounds", "CWE-787"), ("control_state", "CWE-476"), ("control_state", "")]


def crash_tables(spark, sf):
    """Crash records from orders, their patches and frames from lines, and fixed sources of numbered lines, as the tables hold none.

    Every seventh line number's file is no source; a source is missing by key and file; every eleventh record's hunks name
    a line that is not there.
    """
    k = F.col("o_orderkey")
    records = read(spark, sf, "orders").select(k.alias("local_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("project"), F.element_at(F.array(*map(F.lit, _CRASHES)), (k % 6 + 1).cast("int")).alias("crash_type"), F.when(k % 13 != 0, F.concat(F.lit("fix"), k.cast("string"))).alias("fix_commit"))
    line = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("local_id"), F.col("l_linenumber").cast("int").alias("j")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"))
    path = F.when(F.col("j") == 7, "doc.txt").when(F.col("j") % 2 == 1, "src/m.c").otherwise("src/n.cpp")
    start, no = 8 * F.col("j") - 5, lambda n: F.concat(F.lit(" L"), n.cast("string"))
    taken = F.when(F.col("p") % 3 == 0, F.array().cast("array<string>")).when(F.col("p") % 3 == 1, F.array(F.lit("-R1"), F.lit("-R2"))).otherwise(F.array(F.lit("-R1")))
    wrong = F.when(F.col("local_id") % 11 == 0, F.lit(" X")).otherwise(no(start))
    hunks = line.select("local_id", path.alias("old_path"), path.alias("path"), F.col("j").alias("hunk_no"), (start + F.col("s") % 5 - 2).cast("int").alias("old_start"), (F.size(taken) + 2).alias("old_count"), start.cast("int").alias("new_start"), F.lit(3).alias("new_count"),
                        F.concat(F.lit("int f"), F.col("j").cast("string"), F.lit("(int a)")).alias("context"), F.concat(F.array(wrong), taken, F.array(F.concat(F.lit("+L"), (start + 1).cast("string")), no(start + 2))).alias("lines"))
    file = F.when(F.col("s") % 3 == 0, F.lit("src/m.c")).when(F.col("s") % 3 == 1, F.lit("lib/src/n.cpp")).otherwise("src/other.c")
    frames = line.select("local_id", F.col("j").alias("depth"), F.concat(F.lit("ns::g"), F.col("j").cast("string"), F.lit("(int)")).alias("function"), file.alias("file"), (F.col("q") * 2).alias("line"))
    n = F.lit(60) + F.col("local_id") % 25
    names = F.filter(F.array(F.struct(F.lit(0).alias("f"), F.lit("src/m.c").alias("path")), F.struct(F.lit(1).alias("f"), F.lit("src/n.cpp").alias("path"))), lambda x: (F.col("local_id") + x["f"]) % 4 != 0)
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("L"), i.cast("string"))), "\n")
    return records, frames, hunks, records.select("local_id", F.explode(names).alias("x")).select("local_id", "x.path", text.alias("text"))


_CRASH_SQL = f"""r AS (SELECT o_orderkey AS id, 'p' || o_custkey % 50 AS project FROM orders),
l AS (SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS j, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN j = 7 THEN 'doc.txt' WHEN j % 2 = 1 THEN 'src/m.c' ELSE 'src/n.cpp' END AS path, 8 * j - 5 AS ns, CAST(8 * j - 5 + s % 5 - 2 AS INTEGER) AS os, CAST(CASE p % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS gone FROM l WHERE id % 13 <> 0),
fr AS (SELECT id, j, q * 2 AS line, CASE s % 3 WHEN 0 THEN 'src/m.c' WHEN 1 THEN 'src/n.cpp' END AS path FROM l),
f AS (SELECT id, path, max(fr.line IS NOT NULL) AS seen, arg_min(fr.line, fr.j) AS line, min(fr.j) AS depth FROM (SELECT DISTINCT id, path FROM h WHERE path <> 'doc.txt') LEFT JOIN fr USING (id, path) WHERE (id + CASE path WHEN 'src/m.c' THEN 0 ELSE 1 END) % 4 <> 0 GROUP BY id, path),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT seen, path) AS n FROM f) WHERE n = 1),
near AS (SELECT h.id, arg_min(struct_pack(os, gone, j), (CASE WHEN c.seen THEN abs(os - c.line) ELSE 0 END, j)) AS x, sum(gone - 1) AS more FROM h JOIN c USING (id, path) GROUP BY h.id),
lines AS (SELECT id, k AS pos, 0 AS sub, 'L' || k AS line FROM c, unnest(range(1, 61 + id % 25)) t(k) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = c.id AND h.path = c.path AND h.ns + 1 = k) UNION ALL SELECT h.id, ns + 1, i, 'R' || i FROM h JOIN c USING (id, path), unnest(range(1, gone + 1)) t(i)),
text AS (SELECT id, string_agg(line, chr(10) ORDER BY pos, sub) AS source FROM lines GROUP BY id),
o AS (SELECT c.*, near.x, text.source, 60 + c.id % 25 + near.more AS total, greatest(near.x.os, 1) AS start FROM c JOIN near USING (id) JOIN text USING (id) WHERE c.id % 11 <> 0)"""


@query("case_building", f"""WITH {_CRASH_SQL} SELECT 'crash-' || o.id AS case_id, project AS project_id, path AS file, sha256(source) AS digest, CAST(CASE WHEN coalesce(line, start) > total THEN least(start, total) ELSE coalesce(line, start) END AS INTEGER) AS line, CASE WHEN seen THEN 'g' || depth ELSE 'f' || x.j END AS function,
  {[e for e, _ in _CRASH]}[o.id % 6 + 1] AS expert, {[c for _, c in _CRASH]}[o.id % 6 + 1] AS cwe, CASE WHEN coalesce(line, start) > total THEN 'patch-hunk-clamped' WHEN seen THEN 'crash-stack+patch' ELSE 'patch-hunk' END AS ground_truth_source, x.os AS patch_old_start, CAST(x.gone + 2 AS INTEGER) AS patch_old_count FROM o JOIN r USING (id)""")
def case_building(spark, sf):
    """Every crash record as a case: its vulnerable text (by digest) and the truth's line."""
    made, _ = cases.build_cases(*crash_tables(spark, sf))
    return made.select("case_id", "project_id", "file", F.sha2("source", 256).alias("digest"), F.col("line_start").alias("line"), "function", "expert", F.array_join("cwes", ",").alias("cwe"), "ground_truth_source", "patch_old_start", "patch_old_count")


@query("case_failures", f"""WITH {_CRASH_SQL} SELECT r.id AS local_id, project, CASE WHEN r.id % 13 = 0 THEN '{cases.NO_FIX}' WHEN c.id IS NULL THEN '{cases.NO_FILE}' ELSE '{cases.NO_PLACE}' END AS reason FROM r LEFT JOIN c USING (id) WHERE r.id % 13 = 0 OR c.id IS NULL OR r.id % 11 = 0""")
def case_failures(spark, sf):
    """Records that make no case, and why."""
    return cases.build_cases(*crash_tables(spark, sf))[1]


@query("lines_carried", """WITH h AS (SELECT l_orderkey AS id, 20 * CAST(l_linenumber AS INTEGER) AS pos, CAST(min(l_partkey) % 4 AS INTEGER) AS old, CAST(min(l_suppkey) % 5 AS INTEGER) AS new FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT o_orderkey AS id, CAST(unnest(range(1, 160, 7)) AS INTEGER) AS line FROM orders), s AS (SELECT *, CASE WHEN old > 0 THEN pos ELSE pos + 1 END AS lo FROM h)
SELECT p.id, p.line, CAST(CASE WHEN count(s.id) FILTER (lo <= line AND line < lo + old) = 0 THEN line + coalesce(sum(new - old) FILTER (lo + old <= line), 0) END AS INTEGER) AS new_line FROM p LEFT JOIN s USING (id) GROUP BY p.id, p.line""")
def lines_carried(spark, sf):
    """Lines of an old revision in the new one: hunks at every twentieth line, with as many old and new lines as keys say."""
    hunks = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 20).cast("int").alias("old_start")).agg((F.min("l_partkey") % 4).cast("int").alias("old_count"), (F.min("l_suppkey") % 5).cast("int").alias("new_count"))
    points = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(159), F.lit(7))).alias("line"))
    return cases.carried(points, hunks, ["id"])


# turns are prose, so comments, quoted texts and names that tell are put around their words
_PUT = [(r"([a-z]+)e ", r'{0}e /* FLAW {0} */ good_{0} = "bad // {0}"; '), (r"([a-z]+)s ", "{0}s x_{0} // fix\n"), ("[^ -~\n]", "u"), ("'", "`")]
_CUT, _NAMES = r'//[^\n]*|/\*[^*]*\*/|"[^"]*"', r"\b[A-Za-z_][A-Za-z0-9_]*"


def _put_in_sql(text: str) -> str:
    for pattern, new in _PUT:
        text = f"""regexp_replace({text}, '{pattern.replace("'", "''")}', '{new.replace("{0}", chr(92) + "1")}', 'g')"""
    return text


def _redone(text: str, pattern: str, change: str) -> str:
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), list_append(regexp_extract_all({text}, '{pattern}'), '')), lambda x: x[1] || {change}), '')"


@query("neutral_texts", f"""WITH t AS (SELECT conv_id, turn, {_put_in_sql('text')} AS text FROM conversations), c AS (SELECT *, {_redone('text', _CUT, "CASE WHEN starts_with(x[2], '/') THEN regexp_replace(x[2], '[^' || chr(10) || ']', ' ', 'g') ELSE x[2] END")} AS bare FROM t),
n AS (SELECT *, {_redone('bare', _NAMES, "CASE WHEN regexp_matches(x[2], '(?i)cwe[0-9]+|bad|good|flaw|fix') THEN left('n' || repeat(translate(sha256(x[2]), 'abcdef', '012345'), 1 + length(x[2]) // 64), length(x[2])) ELSE x[2] END")} AS neutral FROM c)
SELECT conv_id, turn, sha256(neutral) AS digest, length(neutral) = length(text) AS same_length, length(neutral) - length(replace(neutral, chr(10), '')) AS line_feeds, regexp_matches(neutral, '(?i)cwe[_-]?[0-9]+|bad|good|flaw|fix') AS tells FROM n""")
def neutral_texts(spark, sf):
    """Turns with telling comments, names and quoted texts put into them, made neutral."""
    told = F.col("text")
    for pattern, new in _PUT:
        told = F.regexp_replace(told, pattern, new.replace("{0}", "$1"))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", told.alias("text")).withColumn("neutral", scenarios.neutral_text(F.col("text")))
    feeds = F.length("neutral") - F.length(F.replace("neutral", F.lit("\n")))
    return rows.select("conv_id", "turn", F.sha2("neutral", 256).alias("digest"), (F.length("neutral") == F.length("text")).alias("same_length"), feeds.cast("long").alias("line_feeds"), F.rlike("neutral", F.lit(scenarios.LEAK)).alias("tells"))
