"""Queries over documents, pages, conversations and orders: splits, duplicates, text signals, dimensions, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidark.functions import lightweight, scores, taxonomy, text
from evidark.operators import graph, paths, ranking, splits
from evidark.plans.registry import query
from evidark.sources.tables import read

HASH = "sha256('2026:' || CAST(c_custkey AS VARCHAR))"
SPLIT = f"""keys AS (SELECT DISTINCT c_custkey FROM customer), placed AS (SELECT c_custkey, row_number() OVER (ORDER BY {HASH}, c_custkey) AS place, count(*) OVER () AS n FROM keys),
split AS (SELECT c_custkey, CASE WHEN place <= greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) THEN 'test' WHEN place <= 2 * greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) THEN 'dev' ELSE 'train' END AS split FROM placed)"""


def _customer_split(spark, sf):
    return splits.hash_split(read(spark, sf, "customer"), "c_custkey")


@query("hash_split", f"WITH {SPLIT} SELECT c_custkey, split FROM split")
def hash_split(spark, sf):
    return _customer_split(spark, sf)


@query("project_split", f"WITH {SPLIT} SELECT o_orderkey, split FROM orders JOIN split ON o_custkey = c_custkey")
def project_split(spark, sf):
    """Rows follow their project's split."""
    return read(spark, sf, "orders").join(_customer_split(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "split")


@query("project_overlap", f"WITH {SPLIT}, o AS (SELECT o_custkey, split FROM orders JOIN split ON o_custkey = c_custkey) SELECT DISTINCT o_custkey FROM o WHERE split = 'train' INTERSECT SELECT o_custkey FROM o WHERE split = 'test'")
def project_overlap(spark, sf):
    o = read(spark, sf, "orders").join(_customer_split(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return splits.overlap(o.where("split = 'train'"), o.where("split = 'test'"), "o_custkey")


@query("split_leak_audit", f"WITH {SPLIT} SELECT c_nationkey, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM customer JOIN split USING (c_custkey) GROUP BY c_nationkey HAVING count(DISTINCT split) > 1")
def split_leak_audit(spark, sf):
    rows = read(spark, sf, "customer").join(_customer_split(spark, sf), "c_custkey")
    return splits.leaks(rows, "c_nationkey").withColumn("splits", F.array_join("splits", ","))


@query("split_manifest", f"""WITH {SPLIT}, r AS (SELECT split, o_orderpriority, o_custkey FROM orders JOIN split ON o_custkey = c_custkey), f AS (SELECT split, o_orderpriority || '=' || CAST(count(*) AS VARCHAR) AS f FROM r GROUP BY split, o_orderpriority)
SELECT split, (SELECT string_agg(f, ',' ORDER BY f) FROM f WHERE f.split = r.split) AS families, count(*) AS rows, count(DISTINCT o_custkey) AS projects FROM r GROUP BY split""")
def split_manifest(spark, sf):
    rows = read(spark, sf, "orders").join(_customer_split(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return splits.manifest(rows, "split", "o_custkey", "o_orderpriority")


@query("merge_split_audit", f"""WITH {SPLIT}, u AS (SELECT o_orderkey, o_custkey, split FROM orders JOIN split ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, split FROM orders JOIN split ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 1),
t AS (SELECT count(*) AS repeated_keys FROM (SELECT o_orderkey FROM u GROUP BY o_orderkey HAVING count(*) > 1)), l AS (SELECT count(*) AS leaking_projects FROM (SELECT o_custkey FROM u GROUP BY o_custkey HAVING count(DISTINCT split) > 1))
SELECT split, count(*) AS rows, count(DISTINCT o_orderkey) AS keys, any_value(repeated_keys) AS repeated_keys, any_value(leaking_projects) AS leaking_projects FROM u, t, l GROUP BY split""")
def merge_split_audit(spark, sf):
    o = read(spark, sf, "orders").join(_customer_split(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "split")
    return splits.merge_audit([("a", o.where("o_orderkey % 3 <> 0")), ("b", o.where("o_orderkey % 3 <> 1"))], "o_orderkey", "o_custkey")


@query("deficit_assignment", """WITH RECURSIVE c AS (SELECT o_orderpriority AS family, o_custkey AS cluster, count(*) AS size FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY size DESC, cluster) AS n, CAST(sum(size) OVER (PARTITION BY family) AS DOUBLE) AS total FROM c),
w AS (SELECT *, 0.7::DOUBLE * total AS a, 0.15::DOUBLE * total AS b FROM r), s AS (SELECT family, 0::BIGINT AS n, NULL::BIGINT AS cluster, NULL::VARCHAR AS split, 0::BIGINT AS train, 0::BIGINT AS dev, 0::BIGINT AS test FROM r GROUP BY family
  UNION ALL SELECT family, n, cluster, split, train + CASE WHEN split = 'train' THEN size ELSE 0 END, dev + CASE WHEN split = 'dev' THEN size ELSE 0 END, test + CASE WHEN split = 'test' THEN size ELSE 0 END
  FROM (SELECT w.family, w.n, w.cluster, w.size, s.train, s.dev, s.test, CASE WHEN (a - train) / a >= greatest((b - test) / b, (b - dev) / b) THEN 'train' WHEN (b - test) / b >= (b - dev) / b THEN 'test' ELSE 'dev' END AS split FROM s JOIN w ON w.family = s.family AND w.n = s.n + 1))
SELECT family, cluster, split FROM s WHERE n > 0""")
def deficit_assignment(spark, sf):
    c = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return splits.deficit_assignment(c, "family", {"train": 0.7, "dev": 0.15, "test": 0.15})


@query("quota_sample", """WITH RECURSIVE r AS (SELECT p_type, p_partkey AS id, p_brand, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part),
s AS (SELECT p_type, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS p_brand, NULL::BIGINT AS p_size, FALSE AS kept, []::VARCHAR[] AS brands, []::BIGINT[] AS sizes FROM r GROUP BY p_type
  UNION ALL SELECT p_type, n, id, p_brand, p_size, kept, CASE WHEN kept THEN list_append(brands, p_brand) ELSE brands END, CASE WHEN kept THEN list_append(sizes, p_size) ELSE sizes END
  FROM (SELECT r.p_type, r.n, r.id, r.p_brand, CAST(r.p_size AS BIGINT) AS p_size, s.brands, s.sizes, len(list_filter(s.brands, lambda b: b = r.p_brand)) < 12 AND len(list_filter(s.sizes, lambda x: x = r.p_size)) < 5 AS kept FROM s JOIN r ON r.p_type = s.p_type AND r.n = s.n + 1))
SELECT p_type, id, p_brand, p_size FROM s WHERE kept""")
def quota_sample(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand", "p_size")
    return ranking.quota_sample(p, {"p_brand": 12, "p_size": 5}, "p_type")


@query("quota_single", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR))) AS rank FROM part) SELECT p_partkey, p_brand, rank FROM r WHERE rank <= 20")
def quota_single(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", "p_brand")
    return ranking.top_k(rows, ["p_brand"], 20, F.sha2(F.col("p_partkey").cast("string"), 256).asc())


@query("balanced_order", """WITH a AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY sha256('7:' || CAST(p_partkey AS VARCHAR))) AS n FROM part)
SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY n, p_brand) AS turn FROM a""")
def balanced_order(spark, sf):
    """Brands take turns inside a type, each in hash order."""
    rows = ranking.ranked(read(spark, sf, "part"), ["p_type", "p_brand"], ranking.hash_order("7", F.col("p_partkey")).asc(), name="n")
    return ranking.ranked(rows, ["p_type"], F.asc("n"), F.asc("p_brand"), name="turn").select("p_partkey", "p_type", "turn")


@query("largest_remainder", """WITH w AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), e AS (SELECT *, n * 100::DOUBLE / sum(n) OVER () AS exact FROM w),
r AS (SELECT *, floor(exact) AS f, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, p_brand) AS nth FROM e)
SELECT p_brand, n, CAST(f + CASE WHEN nth <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder(spark, sf):
    w = read(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return ranking.largest_remainder(w, "p_brand", "n", 100)


@query("exact_dedup", "SELECT doc_id, sha256(coalesce(text, chr(1))) AS digest, CASE WHEN min(doc_id) OVER (PARTITION BY coalesce(text, chr(1))) <> doc_id THEN min(doc_id) OVER (PARTITION BY coalesce(text, chr(1))) END AS duplicate_of FROM documents")
def exact_dedup(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return splits.exact_duplicates(d, [F.col("text")], "doc_id").select("doc_id", "digest", "duplicate_of")


_FINGERPRINTS = r"WITH f AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n\f\v]+', ' ', 'g'))) AS fingerprint FROM documents) SELECT fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM f GROUP BY fingerprint"


@query("fingerprint_dedup", _FINGERPRINTS)
def fingerprint_dedup(spark, sf):
    """Whole texts alike after white space is collapsed and letters are lower-cased: the first id of each."""
    d = read(spark, sf, "documents").select("doc_id", splits.fingerprint(F.lower("text")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("template_group", "SELECT template, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT lower(regexp_replace(regexp_replace(p_brand || '_' || p_name, '[_#]?[0-9]+.*$', ''), '[^A-Za-z0-9_.]+', '_', 'g')) AS template, p_brand FROM part) GROUP BY template")
def template_group(spark, sf):
    p = read(spark, sf, "part").select(splits.template_group(F.concat_ws("_", "p_brand", "p_name")).alias("template"), "p_brand")
    return p.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"))


def _template(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({url}, '[_#]?[0-9]+.*$', ''), '[^A-Za-z0-9_.]+', '_', 'g'))"


_CLUSTERS = """WITH RECURSIVE n AS ({keys}), first AS (SELECT k, min(id) AS f FROM n WHERE k IS NOT NULL GROUP BY k), e AS (SELECT DISTINCT id AS a, f AS b FROM n JOIN first USING (k) UNION SELECT DISTINCT f, id FROM n JOIN first USING (k) UNION SELECT id, id FROM n),
reach(a, b) USING KEY (a) AS (SELECT a, min(b) FROM e GROUP BY a UNION (SELECT e.a, min(r.b) FROM e JOIN reach r ON r.a = e.b JOIN recurring.reach o ON o.a = e.a GROUP BY e.a HAVING min(r.b) < min(o.b))) SELECT a AS {name}, b AS cluster FROM reach"""


@query("leakage_clusters", _CLUSTERS.format(name="doc_id", keys=r"SELECT doc_id AS id, 't:' || source || ':' || n_chars AS k FROM documents UNION ALL SELECT doc_id, 'h:' || sha256(lower(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')))) FROM documents"))
def leakage_clusters(spark, sf):
    """Documents joined by an equal whole text (canonical) or an equal key of source and length, as names are joined by their template."""
    d = read(spark, sf, "documents")
    key = F.concat(F.col("source"), F.lit(":"), F.col("n_chars").cast("string"))
    return splits.leakage_clusters(d, "doc_id", key, text.canonical_hash(F.col("text")))


@query("leakage_clusters_whole", _CLUSTERS.format(name="page_id", keys=f"SELECT page_id AS id, 't:' || {_template('url')} AS k FROM pages UNION ALL SELECT page_id, 'h:' || sha256(lower(trim(regexp_replace(html, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')))) FROM pages"))
def leakage_clusters_whole(spark, sf):
    """Pages joined by an equal template of the address or an equal whole page."""
    p = read(spark, sf, "pages").select("page_id", "url", "html")
    return splits.leakage_clusters(p, "page_id", splits.template_group(F.col("url")), text.canonical_hash(F.col("html")))


@query("combined_hash", "SELECT conv_id, sha256(string_agg(sha256(text), chr(1) ORDER BY sha256(text))) AS combined, count(*) AS files FROM conversations GROUP BY conv_id")
def combined_hash(spark, sf):
    """One digest of a set of files, whatever their order."""
    g = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("text", 256))), "\u0001"), 256).alias("combined"), F.count(F.lit(1)).alias("files"))
    return g


def _count(p: str) -> str:
    return "CAST(len(regexp_extract_all(text, '" + p.replace("'", "''") + "')) AS INTEGER)"


_SIGNALS = {n: p for n, (_, p) in lightweight.PATTERNS.items()}
# the test texts are prose, so calls, indexes and the like are put around their words
_CODE = ("regexp_replace(regexp_replace(regexp_replace(text, '[^ -~]', 'x', 'g'), '([a-z]+)e ', '\\1[0] size * state ', 'g'), '([a-z]+)s ', 'if (len < 3) free(\\1) + access(\\1); open(\\1) ', 'g')", lambda: F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^ -~]", "x"), "([a-z]+)e ", "$1[0] size * state "), "([a-z]+)s ", "if (len < 3) free($1) + access($1); open($1) "))


@query("regex_signals", f"WITH b AS (SELECT item_id, {_CODE[0]} AS text FROM benchmark) SELECT item_id, " + ", ".join(f"{_count(p)} AS {n}" for n, p in _SIGNALS.items()) + " FROM b")
def regex_signals(spark, sf):
    code = read(spark, sf, "benchmark").select("item_id", _CODE[1]().alias("text"))
    return code.select("item_id", *text.signals(F.col("text"), _SIGNALS))


@query("tokenize", "SELECT conv_id, turn, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{3,}'), lambda w: lower(w)))) AS INTEGER) AS n_tokens FROM conversations")
def tokenize(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("token_overlap_topk", """WITH q AS (SELECT DISTINCT conv_id * 100 + turn AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]{3,}'))) AS token FROM conversations),
e AS (SELECT DISTINCT item_id AS entry_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]{3,}'))) AS token FROM benchmark),
s AS (SELECT query_id, entry_id, count(*) AS shared FROM q JOIN e USING (token) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, entry_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def token_overlap_topk(spark, sf):
    q = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return text.token_overlap(q, read(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), "text"), 3)


@query("canonical_hash", r"SELECT item_id, sha256(lower(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')))) AS digest FROM benchmark")
def canonical_hash(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", text.canonical_hash(F.col("text")).alias("digest"))


@query("leak_lines", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d),
m AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, '[Ll]icensed under|[A-Z]{2}-[A-Z]{2}|[0-9]{2,}')) SELECT doc_id, line_no, line FROM m""")
def leak_lines(spark, sf):
    return text.matching_lines(read(spark, sf, "documents"), "doc_id", "[Ll]icensed under|[A-Z]{2}-[A-Z]{2}|[0-9]{2,}")


@query("normalize_code", "SELECT p_partkey, 'CWE-' || CAST(CAST(regexp_extract(p_brand, '([0-9]{1,9})', 1) AS INTEGER) AS VARCHAR) AS code FROM part")
def normalize_code(spark, sf):
    return read(spark, sf, "part").select("p_partkey", taxonomy.normal_name(F.col("p_brand")).alias("code"))


_VALUES = ", ".join(f"({n}, '{c}', '{x}')" for n, c, x in taxonomy.weaknesses())


@query("dim_lookup", f"WITH w(number, category, expert) AS (VALUES {_VALUES}) SELECT p_partkey, category, expert FROM part LEFT JOIN w ON number = p_partkey % 900")
def dim_lookup(spark, sf):
    w = F.broadcast(taxonomy.weakness_table(spark))  # a fixed table of under a hundred rows
    return read(spark, sf, "part").join(w, F.col("p_partkey") % 900 == F.col("number"), "left").select("p_partkey", "category", "expert")


_NAMES = ["Heap-double-free", "Heap use after free READ 8", "memory_leak", "Integer-overflow", "Data race", "Heap-buffer-overflow WRITE 4", "out-of-bounds read", "Null-dereference", "Use-of-uninitialized-value", "abort", "heap-use-after-free READ 1", "Signed integer overflow", "Memory-leak"]


@query("rule_classify", f"""WITH c AS (SELECT event_id, lower({_NAMES}[CAST(event_id % 13 + 1 AS INTEGER)] || ' ' || props) AS d FROM events)
SELECT event_id, CASE WHEN contains(d, 'double-free') OR contains(d, 'use-after') OR contains(d, 'memory-leak') OR contains(d, 'resource-leak') THEN 'lifetime_resource' WHEN contains(d, 'integer-overflow') OR contains(d, 'integer overflow') THEN 'integer_overflow' WHEN contains(d, 'data-race') OR contains(d, 'deadlock') THEN 'concurrency'
  WHEN contains(d, 'buffer-overflow') OR contains(d, 'buffer-underflow') OR contains(d, 'out-of-bounds') THEN 'memory_bounds' ELSE 'control_state' END AS expert,
  CAST(CASE WHEN contains(d, 'double-free') THEN 415 WHEN contains(d, 'use-after') THEN 416 WHEN contains(d, 'memory-leak') OR contains(d, 'resource-leak') THEN 401 WHEN contains(d, 'integer-overflow') OR contains(d, 'integer overflow') THEN 190 WHEN contains(d, 'data-race') OR contains(d, 'deadlock') THEN 362
  WHEN contains(d, 'buffer-overflow') OR contains(d, 'buffer-underflow') OR contains(d, 'out-of-bounds') THEN CASE WHEN contains(d, 'write') THEN 787 ELSE 125 END WHEN contains(d, 'null-dereference') THEN 476 WHEN contains(d, 'uninitialized') THEN 457 END AS INTEGER) AS number FROM c""")
def rule_classify(spark, sf):
    """Descriptions are the event's own properties behind one of the phrases, as the tables hold no crashes."""
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 13 + 1).cast("int")), "props")
    return read(spark, sf, "events").select("event_id", taxonomy.crash_class(name).alias("c")).select("event_id", "c.expert", "c.number")


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("repository_sources", "SELECT p_partkey, p_name, regexp_extract(p_name, '([^ ]+)$', 1) AS suffix, octet_length(encode(p_name)) AS bytes FROM part WHERE octet_length(encode(p_name)) <= 10")
def repository_sources(spark, sf):
    """Suffix and byte cap, as a source scan applies them."""
    p = read(spark, sf, "part").where(F.octet_length("p_name") <= 10)
    return p.select("p_partkey", "p_name", F.regexp_extract("p_name", "([^ ]+)$", 1).alias("suffix"), F.octet_length("p_name").cast("long").alias("bytes"))


_EDGES = """o AS (SELECT o_orderkey AS node, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
e AS (SELECT a.node AS src, b.node AS dst FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND ((b.place = a.place + 1 AND a.node % 5 <> 0) OR (b.place = a.place + 3 AND a.node % 3 = 0)))"""


def _orders(spark, sf):
    """Every order with its place among its customer's by time, and how many those are."""
    by = Window.partitionBy("o_custkey")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).alias("place"), F.count(F.lit(1)).over(by).alias("n"))


def _edges(orders):
    """Flow from an order to the customer's next one (not from keys divisible by five) and to the third next (from keys divisible by three)."""
    steps = F.filter(F.array(F.when(F.col("node") % 5 != 0, F.col("place") + 1), F.when(F.col("node") % 3 == 0, F.col("place") + 3)), lambda x: x.isNotNull())
    out = orders.select("o_custkey", F.col("node").alias("src"), F.explode(steps).alias("place"))
    return out.join(orders.select("o_custkey", "place", F.col("node").alias("dst")), ["o_custkey", "place"]).select("o_custkey", "src", "dst")


def _paths(at: str, edge: tuple[str, str], passable: str = "TRUE", path: bool = True) -> str:
    """Breadth first from many nodes: distance and the first of the shortest paths."""
    out = ", array_to_string(path, ',') AS path" if path else ""
    return f"""WITH RECURSIVE {_EDGES}, p(start, node, distance, path) USING KEY (start, node) AS (SELECT node, node, 0, [node] FROM o WHERE {at}
UNION (SELECT p.start, e.{edge[1]}, min(p.distance) + 1, list_append(min(p.path), e.{edge[1]}) FROM p JOIN e ON e.{edge[0]} = p.node WHERE (p.distance = 0 OR {passable}) AND NOT EXISTS (SELECT 1 FROM recurring.p r WHERE r.start = p.start AND r.node = e.{edge[1]}) GROUP BY p.start, e.{edge[1]}))
SELECT start, node, CAST(distance AS INTEGER) AS distance{out} FROM p"""


def _told(found):
    return found.select("start", "node", "distance", F.array_join("path", ",").alias("path"))


@query("shortest_path", _paths("place = 1", ("src", "dst")))
def shortest_path(spark, sf):
    """From every customer's first order on: the distance and the nodes of the first shortest path."""
    orders = _orders(spark, sf)
    return _told(graph.distances(_edges(orders), orders.where("place = 1"), by=["o_custkey"]))


@query("path_without_definition", _paths("place = 1", ("src", "dst"), "p.node % 7 <> 0"))
def path_without_definition(spark, sf):
    """Nodes divisible by seven define the symbol: paths may end there, not pass."""
    orders = _orders(spark, sf)
    return _told(graph.distances(_edges(orders), orders.where("place = 1"), passable=F.col("node") % 7 != 0, by=["o_custkey"]))


@query("backward_slice", _paths("place = n", ("dst", "src"), path=False))
def backward_slice(spark, sf):
    """All that flows into every customer's last order."""
    orders = _orders(spark, sf)
    back = _edges(orders).select("o_custkey", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.distances(back, orders.where("place = n"), paths=False, by=["o_custkey"])


_FLOW = """n AS (SELECT DISTINCT l_orderkey AS fn, CAST(l_linenumber AS BIGINT) AS node FROM lineitem), l AS (SELECT l_orderkey AS fn, CAST(l_linenumber AS BIGINT) AS node, l_partkey AS p, l_suppkey AS s, l_quantity AS q, 'p' || l_suppkey % 2 AS a, 'p' || l_partkey % 2 AS b FROM lineitem),
e AS (SELECT DISTINCT x.fn, x.src, x.dst FROM (SELECT fn, node AS src, node + 1 AS dst FROM l WHERE p % 4 <> 0 UNION ALL SELECT fn, node, node + 2 FROM l WHERE s % 2 = 0 UNION ALL SELECT fn, node, node - 2 FROM l WHERE p % 5 = 0) x JOIN n ON n.fn = x.fn AND n.node = x.dst)"""
_EVENTS = """d AS (SELECT DISTINCT fn, node, b AS symbol FROM l WHERE q % 3 = 0), ev AS (SELECT DISTINCT * FROM (SELECT fn, node, a AS symbol, 'release' AS kind FROM l WHERE p % 2 = 0 UNION ALL SELECT fn, node, b, 'access' FROM l UNION ALL SELECT fn, node, a, 'check' FROM l WHERE p % 3 = 0 UNION ALL SELECT fn, node, a, 'use' FROM l WHERE s % 3 = 0)),
w(fn, symbol, start, node, distance, path) USING KEY (fn, symbol, start, node) AS (SELECT DISTINCT fn, symbol, node, node, 0, [node] FROM ev WHERE kind IN ('release', 'check')
UNION (SELECT w.fn, w.symbol, w.start, e.dst, min(w.distance) + 1, list_append(min(w.path), e.dst) FROM w JOIN e ON e.fn = w.fn AND e.src = w.node LEFT JOIN d ON d.fn = w.fn AND d.node = w.node AND d.symbol = w.symbol
  WHERE (w.distance = 0 OR d.fn IS NULL) AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.fn = w.fn AND r.symbol = w.symbol AND r.start = w.start AND r.node = e.dst) GROUP BY w.fn, w.symbol, w.start, e.dst))"""


def _flow(spark, sf):
    """Flow graphs of orders: lines are nodes; steps on, over one line and back two lines by the keys; definitions and events."""
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("node"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("l_partkey") % 2).cast("string")).alias("b"))
    steps = F.array_compact(F.array(F.when(F.col("p") % 4 != 0, F.col("node") + 1), F.when(F.col("s") % 2 == 0, F.col("node") + 2), F.when(F.col("p") % 5 == 0, F.col("node") - 2)))
    edges = line.select("fn", F.col("node").alias("src"), F.explode(steps).alias("dst")).join(line.select("fn", F.col("node").alias("dst")).distinct(), ["fn", "dst"], "left_semi").distinct()
    event = lambda kind, symbol: F.struct(F.lit(kind).alias("kind"), F.col(symbol).alias("symbol"))
    events = F.array_compact(F.array(F.when(F.col("p") % 2 == 0, event("release", "a")), event("access", "b"), F.when(F.col("p") % 3 == 0, event("check", "a")), F.when(F.col("s") % 3 == 0, event("use", "a"))))
    events = line.select("fn", "node", F.explode(events).alias("e")).select("fn", "node", "e.kind", "e.symbol").distinct()
    return edges, line.where("q % 3 = 0").select("fn", "node", F.col("b").alias("symbol")).distinct(), events


@query("path_pairs", f"""WITH RECURSIVE {_FLOW}, {_EVENTS}, f(fact, first, second) AS (VALUES ('use_after_release', 'release', 'access'), ('double_release', 'release', 'release'), ('toctou_check_use', 'check', 'use'))
SELECT fact, w.fn, w.symbol, w.start AS source, w.node AS sink, array_to_string(w.path, ',') AS path FROM w JOIN f ON TRUE JOIN ev a ON a.fn = w.fn AND a.node = w.start AND a.symbol = w.symbol AND a.kind = f.first JOIN ev b ON b.fn = w.fn AND b.node = w.node AND b.symbol = w.symbol AND b.kind = f.second
WHERE w.start <> w.node AND (fact <> 'double_release' OR w.start < w.node)""")
def path_pairs(spark, sf):
    """Uses after release, double releases and uses after a check, each with a path on which nothing defines the symbol."""
    edges, definitions, events = _flow(spark, sf)
    found = paths.lifetime_pairs(edges, definitions, events.withColumns({"id": F.col("node"), "ordinal": F.col("node")}))
    return found.select("fact", "fn", "symbol", "source", "sink", F.array_join("path", ",").alias("path"))


_DOMINATORS = """n AS (SELECT DISTINCT l_orderkey AS fn, CAST(l_linenumber AS BIGINT) AS node FROM lineitem),
e AS (SELECT DISTINCT j.fn, j.src, j.dst FROM (SELECT l_orderkey AS fn, CAST(l_linenumber AS BIGINT) AS src, CAST(l_linenumber + 1 + l_partkey % 2 AS BIGINT) AS dst FROM lineitem) j JOIN n ON n.fn = j.fn AND n.node = j.dst),
entry AS (SELECT n.fn, coalesce(min(n.node) FILTER (e.fn IS NULL), min(n.node)) AS node FROM n LEFT JOIN e ON e.fn = n.fn AND e.dst = n.node GROUP BY n.fn),
avoid(fn, d, node) AS (SELECT n.fn, n.node, entry.node FROM n JOIN entry ON n.fn = entry.fn AND n.node <> entry.node UNION SELECT a.fn, a.d, e.dst FROM avoid a JOIN e ON e.fn = a.fn AND e.src = a.node AND e.dst <> a.d),
met(fn, node) AS (SELECT fn, node FROM entry UNION SELECT m.fn, e.dst FROM met m JOIN e ON e.fn = m.fn AND e.src = m.node),
dom AS (SELECT x.fn, x.node, d.node AS dominator FROM n x JOIN n d ON x.fn = d.fn LEFT JOIN avoid a ON a.fn = x.fn AND a.d = d.node AND a.node = x.node WHERE a.fn IS NULL)"""


def _graphs(spark, sf):
    """Flow graphs made from orders: an order is a function, its lines are nodes in a chain with jumps by part."""
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("node")).distinct()
    jump = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("src"), (F.col("l_linenumber") + 1 + F.col("l_partkey") % 2).cast("long").alias("dst")).distinct()
    return line, jump


@query("dominators", f"WITH RECURSIVE {_DOMINATORS} SELECT fn, node, dominator FROM dom")
def dominators(spark, sf):
    """A node dominates another if no way from the entry avoids it."""
    return graph.dominators(*_graphs(spark, sf))


@query("immediate_dominators", f"""WITH RECURSIVE {_DOMINATORS}, depth AS (SELECT fn, node AS dominator, count(*) AS n FROM dom GROUP BY ALL)
SELECT dom.fn, dom.node, arg_max(dom.dominator, n) AS parent FROM dom JOIN met ON dom.fn = met.fn AND dom.node = met.node JOIN depth ON depth.fn = dom.fn AND depth.dominator = dom.dominator WHERE dom.node <> dom.dominator GROUP BY ALL""")
def immediate_dominators(spark, sf):
    """Of the other dominators of a node that the entry reaches, the one that all others dominate."""
    return graph.dominator_trees(*_graphs(spark, sf)).where("parent IS NOT NULL").select("fn", "node", "parent")


@query("call_graph", r"""WITH f AS (SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey % 1500 WHEN 1 THEN 'ns' || p_partkey % 7 || '::f' || p_partkey % 1500 WHEN 2 THEN 'app::ns' || p_partkey % 5 || '::g' || p_partkey % 900 ELSE 'h' || p_partkey END AS name FROM part),
i AS (SELECT ending, min(key) AS low, max(key) AS high FROM (SELECT key, unnest(list_transform(range(1, len(string_split(name, '::')) + 1), lambda k: array_to_string(list_slice(string_split(name, '::'), k, 99), '::'))) AS ending FROM f) GROUP BY ending),
c AS (SELECT DISTINCT l_partkey AS caller, CASE l_suppkey % 5 WHEN 0 THEN 'f' || l_partkey % 1500 WHEN 1 THEN 'this.h' || l_partkey // 2 WHEN 2 THEN 'ns' || l_suppkey % 7 || '::f' || l_partkey % 1500 WHEN 3 THEN 'x.y.g' || l_partkey % 900 ELSE 'std::h' || (l_suppkey * 4 + 3) END AS said FROM lineitem),
r AS (SELECT caller, said, unnest(list_distinct([said, regexp_extract(said, '([^.]*)$', 1), CASE WHEN contains(said, '::') THEN string_split(said, '::')[-1] ELSE said END])) AS ending FROM c)
SELECT DISTINCT caller, low AS callee FROM (SELECT caller, said, min(low) AS low, max(high) AS high FROM r JOIN i USING (ending) GROUP BY ALL) WHERE low = high""")
def call_graph(spark, sf):
    """Parts as functions, some of qualified names and some of names that others have too; lines as calls of them."""
    k, p, s = F.col("p_partkey"), F.col("l_partkey"), F.col("l_suppkey")
    t = lambda c: c.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("f"), t(k % 1500))).when(k % 4 == 1, F.concat(F.lit("ns"), t(k % 7), F.lit("::f"), t(k % 1500))).when(k % 4 == 2, F.concat(F.lit("app::ns"), t(k % 5), F.lit("::g"), t(k % 900))).otherwise(F.concat(F.lit("h"), t(k)))
    said = F.when(s % 5 == 0, F.concat(F.lit("f"), t(p % 1500))).when(s % 5 == 1, F.concat(F.lit("this -> h"), t(F.floor(p / 2)))).when(s % 5 == 2, F.concat(F.lit("ns"), t(s % 7), F.lit(":: f"), t(p % 1500))).when(s % 5 == 3, F.concat(F.lit("x.y->g"), t(p % 900))).otherwise(F.concat(F.lit("std::h"), t(s * 4 + 3)))
    return graph.call_graph(read(spark, sf, "part").select(k.alias("key"), name.alias("name")), read(spark, sf, "lineitem").select(p.alias("caller"), said.alias("callee")))


@query("anchor_route", """SELECT c_custkey, 'memory_bounds,control_state' || CASE WHEN c_acctbal / 10000 >= 0.5 AND c_acctbal / 10000 >= c_nationkey / 25.0::DOUBLE THEN ',lifetime_resource' ELSE '' END || CASE WHEN c_nationkey / 25.0::DOUBLE >= 0.6 THEN ',taint_api' ELSE '' END
  || CASE WHEN c_acctbal / 10000 >= 0.5 AND NOT (c_acctbal / 10000 >= c_nationkey / 25.0::DOUBLE) THEN ',lifetime_resource' ELSE '' END AS route FROM customer""")
def anchor_route(spark, sf):
    rare = F.create_map(F.lit("lifetime_resource"), F.col("c_acctbal") / 10000, F.lit("taint_api"), F.col("c_nationkey") / 25.0)
    route = scores.anchor_route(["memory_bounds", "control_state"], rare, {"lifetime_resource": 0.5, "taint_api": 0.6})
    return read(spark, sf, "customer").select("c_custkey", F.array_join(route, ",").alias("route"))


@query("utility_route", "SELECT c_custkey, CASE WHEN c_acctbal / 10000 < 0.85 THEN 'a,b,c,d,e' ELSE 'a,b' END AS route FROM customer")
def utility_route(spark, sf):
    ranked = F.array(*map(F.lit, "abcde"))
    return read(spark, sf, "customer").select("c_custkey", F.array_join(scores.utility_route(ranked, F.col("c_acctbal") / 10000, 0.85), ",").alias("route"))


@query("static_floor", "SELECT c_custkey, greatest(c_nationkey / 25.0::DOUBLE, least(greatest(c_acctbal / 8000, 0.0), 1.0)) AS score FROM customer")
def static_floor(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", scores.floor_score(F.col("c_nationkey") / 25.0, F.col("c_acctbal") / 8000).alias("score"))
