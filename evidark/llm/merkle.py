"""Merkle manifest of a table, with DuckDB as the engine of its blocks.

A leaf is the sha256 of a row's values. Within a source, leaves ascend by doc_id (null first; rows of one doc_id by their
digests, so that equal rows alone are free to swap); while there are several nodes, every ``FAN`` consecutive ones become
the sha256 of their digests. What remains of each source is put in order of source and goes on likewise to the root.

1. Spark computes leaves, and numbers them within their source from counts by range, so that no source is one task's.
2. ``FAN ** LEVELS`` consecutive leaves of a source are a bucket, one row. On executors DuckDB runs the levels inside
   buckets over Arrow batches of them: ordered ``string_agg``, then ``sha256``.
3. Spark combines the buckets' roots level by level, and joins to each bucket the siblings on its way to the root.
4. DuckDB runs over the buckets again: siblings on a leaf's way are what stands left and right of it in its runs, then its
   bucket's; a leaf folded with them, from the first level up, must give the root.

Null values and null sources count as the contract has them; a null doc_id is written ``-``, stands first, and is never
tampered with. Empty and very long texts are hashed whole. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidark.llm.common import table, written

FAN, LEVELS = 16, 3
BUCKET = FAN**LEVELS
#: Levels above a leaf in one tree; of more than FAN ** MOST nodes there is no talk.
MOST = 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Memory of DuckDB in a worker; a batch of buckets takes a small part of it.
MEMORY = "256MB"


def part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[part(values[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered (a leaf of the text in lower case where that is tried, else null), and a number that spreads equal rows."""
    values = {c: F.col(c) for c in FIELDS}
    tried = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (F.translate("text", UPPER, LOWER) != F.col("text"))
    tampered = F.when(tried, leaf(values | {"text": F.translate("text", UPPER, LOWER)}))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(values).alias("leaf"), tampered.alias("tampered"), F.rand(11).alias("spread"))


def levels(n: Column, fan: int = FAN) -> Column:
    """Levels until one of ``n`` nodes is left."""
    return sum((F.when(n > fan**k, 1).otherwise(0) for k in range(MOST)), F.lit(0)).cast("int")


def numbered(spark: SparkSession, df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``df`` with pos, a row's place among those of ``by`` in the order of ``order``, and n, their number.

    Rows are sorted by range, so a value of ``by`` may lie in many tasks; places are those in a task plus the rows before.
    """
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ranged = written(spark, ranged.select("*", F.monotonically_increasing_id().alias("id")), name)
    ranged = ranged.withColumn("task", F.shiftright("id", 33))
    counts = ranged.groupBy(by, "task").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("here"))
    near = Window.partitionBy(by).orderBy("task")  # a row for each task that has rows of it
    counts = counts.select(F.col(by).alias("of"), F.col("task").alias("in"), "least", F.coalesce(F.sum("here").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy(by)).alias("n"))
    joined = ranged.join(counts, (ranged["task"] == counts["in"]) & ranged[by].eqNullSafe(counts["of"]))
    return joined.select(*df.columns, (F.col("id") - F.col("least") + F.col("before")).alias("pos"), "n")


def buckets(spark: SparkSession, docs: DataFrame, size: int = BUCKET) -> DataFrame:
    """One row for each bucket (written): source, bucket, n (leaves of the source), leaves in order."""
    placed = numbered(spark, leaves(docs), "source", ["doc_id", "leaf", "spread"], "leaves")
    one = F.struct("pos", "doc_id", "leaf", "tampered")
    grouped = placed.groupBy("source", F.floor(F.col("pos") / size).alias("bucket")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(one)).alias("rows"))  # at most ``size`` rows each
    return written(spark, grouped.select("source", "bucket", "n", "rows.doc_id", "rows.leaf", "rows.tampered"), "buckets")


def connected():
    """A DuckDB of one thread; a task has one core."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})


def inner_levels(n: str, fan: int, most: int) -> str:
    """Levels of a bucket of a tree of ``n`` leaves, in SQL."""
    return " + ".join(f"({n} > {fan**k})::INT" for k in range(most))


def runs(fan: int, most: int) -> str:
    """The levels of all buckets as common tables: ``node{k}`` (b, pos, h) and ``run{k}`` (b, pos, s: its digests in order)."""
    made = [f"given AS (SELECT *, {inner_levels('n', fan, most)} AS deep FROM block)", "node0 AS (SELECT b, deep, unnest(leaf) AS h, generate_subscripts(leaf, 1) - 1 AS pos FROM given)"]
    for k in range(most):
        made.append(f"run{k} AS (SELECT b, deep, pos // {fan} AS pos, string_agg(h, '' ORDER BY pos) AS s FROM node{k} GROUP BY ALL)")
        made.append(f"node{k + 1} AS (SELECT b, deep, pos, CASE WHEN deep > {k} THEN sha256(s) ELSE s END AS h FROM run{k})")
    return ", ".join(made)


def numbered_batch(batch: pa.RecordBatch) -> pa.Table:
    return pa.table({"b": pa.array(range(batch.num_rows), pa.int64())} | {c: batch.column(c) for c in batch.schema.names})


def bucket_roots(made: DataFrame, fan: int = FAN, most: int = LEVELS) -> DataFrame:
    """source, bucket, n, h: the node that the leaves of a bucket come to."""
    sql = f"WITH {runs(fan, most)} SELECT source, bucket, n, h FROM node{most} JOIN given USING (b)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connected()
        for batch in batches:
            con.register("block", numbered_batch(batch))
            yield from con.execute(sql).to_arrow_table().combine_chunks().to_batches()
            con.unregister("block")

    return made.select("source", "bucket", "n", "leaf").mapInArrow(run, "source string, bucket long, n long, h string")


def combined(spark: SparkSession, nodes: DataFrame, by: str, fan: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (``by``, pos, left (nodes of the tree), h): their roots, and the siblings on each node's way.

    The second table has ``by``, pos and way, an array of (l, r): digests left and right of the way at each level. Levels
    shrink by ``fan``, so there are few; each is a written table.
    """
    most = nodes.agg(F.max(levels(F.col("left"), fan))).first()[0] or 0
    now = nodes.select(by, "pos", F.col("pos").alias("at"), "left", F.array().cast("array<struct<l string, r string>>").alias("way"))
    for k in range(most):
        # trees with one node left are as they are; each run's digests in order stand once
        run = nodes.where("left > 1").groupBy(by, F.floor(F.col("pos") / fan).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "").alias("s"))
        run = written(spark, run.select(F.col(by).alias("of"), "run", "s"), f"{name}{k}")
        i = F.col("at") % fan
        own = F.struct(F.substring("s", F.lit(1), (64 * i).cast("int")).alias("l"), F.substring("s", (64 * (i + 1) + 1).cast("int"), F.length("s")).alias("r"))
        reached = now.join(run, now[by].eqNullSafe(run["of"]) & (F.floor(now["at"] / fan) == run["run"]) & (now["left"] > 1), "left")
        way = F.when(F.col("s").isNull(), F.col("way")).otherwise(F.concat("way", F.array(own)))
        now = written(spark, reached.select(by, "pos", F.floor(F.col("at") / fan).alias("at"), F.ceil(F.col("left") / fan).alias("left"), way.alias("way")), f"{name}way{k}")
        done = nodes.where("left = 1")
        sizes = nodes.where("left > 1").select(F.col(by).alias("tree"), F.ceil(F.col("left") / fan).alias("left")).distinct()
        up = run.join(sizes, run["of"].eqNullSafe(sizes["tree"])).select(F.col("of").alias(by), F.col("run").alias("pos"), "left", F.sha2("s", 256).alias("h"))
        nodes = written(spark, done.select(by, "pos", "left", "h").union(up), f"{name}nodes{k}")
    return nodes.select(by, "h"), now.select(by, "pos", "way")


WAYS = "source string, bucket long, way array<struct<l string, r string>>, subroot string"


def outer(spark: SparkSession, made: DataFrame, fan: int = FAN, most: int = LEVELS) -> tuple[DataFrame, str | None]:
    """Of each bucket the siblings from its own root to the table's, and its source's subroot; and the table's root."""
    size = fan**most
    nodes = written(spark, bucket_roots(made, fan, most), "roots").select("source", F.col("bucket").alias("pos"), F.ceil(F.col("n") / size).alias("left"), "h")
    subroots, inside = combined(spark, nodes, "source", fan, "inside")
    ordered = numbered(spark, subroots.withColumn("tree", F.lit(0)), "tree", ["source"], "sources")
    ordered = written(spark, ordered, "ordered")
    root, above = combined(spark, ordered.select("tree", "pos", F.col("n").alias("left"), "h"), "tree", fan, "above")
    of = ordered.select(F.col("source").alias("of"), F.col("pos").alias("at"), F.col("h").alias("subroot"))
    upper = of.join(above.select(F.col("pos").alias("node"), F.col("way").alias("up")), F.col("at") == F.col("node"))
    ways = inside.join(upper, inside["source"].eqNullSafe(upper["of"])).select("source", F.col("pos").alias("bucket"), F.concat("way", "up").alias("way"), "subroot")
    first = root.first()  # one row
    return ways, first["h"] if first else None


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs_sql(root: str, fan: int, most: int) -> str:
    """Every leaf with its proof and the root it folds to."""
    steps = ["path0 AS (SELECT b, deep, unnest(doc_id) AS doc_id, unnest(leaf) AS leaf, coalesce(unnest(tampered), unnest(leaf)) AS h, generate_subscripts(leaf, 1) - 1 AS pos, '' AS proof FROM given)"]
    for k in range(most):
        left, right = f"left(s, 64 * (p.pos % {fan}))", f"substr(s, 64 * (p.pos % {fan}) + 65)"
        steps.append(
            f"path{k + 1} AS (SELECT p.b, p.deep, doc_id, leaf, CASE WHEN p.deep > {k} THEN sha256({left} || h || {right}) ELSE h END AS h, p.pos // {fan} AS pos, "
            f"CASE WHEN p.deep > {k} THEN proof || {left} || {right} ELSE proof END AS proof FROM path{k} p JOIN run{k} r ON p.b = r.b AND p.pos // {fan} = r.pos)"
        )
    folded = "list_reduce(list_prepend(h, [w.l || ':' || w.r FOR w IN way]), LAMBDA x, w: sha256(split_part(w, ':', 1) || x || split_part(w, ':', 2)))"
    tail = "array_to_string([w.l || w.r FOR w IN way], '')"
    return (
        f"WITH {runs(fan, most)}, {', '.join(steps)}, done AS (SELECT p.doc_id, p.leaf, subroot, sha256(proof || {tail}) AS proof_sha256, {folded} AS folded_root FROM path{most} p JOIN given USING (b)) "
        f"SELECT doc_id, leaf, subroot, '{root}' AS root, proof_sha256, folded_root, folded_root = '{root}' AS verified FROM done"
    )


def manifest(spark: SparkSession, docs: DataFrame, fan: int = FAN, most: int = LEVELS) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the leaf, tampered where that is tried, folds to the root."""
    made = buckets(spark, docs, fan**most)
    ways, root = outer(spark, made, fan, most)
    if root is None:
        return spark.createDataFrame([], RESULT)
    sql = proofs_sql(root, fan, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connected()
        for batch in batches:
            con.register("block", numbered_batch(batch))
            yield from con.execute(sql).to_arrow_table().to_batches(max_chunksize=20_000)
            con.unregister("block")

    ways = ways.select(F.col("source").alias("of"), F.col("bucket").alias("at"), "way", "subroot")
    joined = made.join(ways, made["source"].eqNullSafe(ways["of"]) & (made["bucket"] == ways["at"]))
    return joined.select("n", "doc_id", "leaf", "tampered", "way", "subroot").mapInArrow(run, RESULT)


def oracle(most: int = 7) -> str:
    """The same by windows and joins over whole tables, for sources of up to ``FAN ** most`` rows and as many sources."""
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), LAMBDA x, c: {})"
    step = "xor(x, c)"
    for _ in range(8):
        step = f"(LIST_VALUE({step}).list_transform(LAMBDA v: xor(v >> 1, 3988292384::UBIGINT * (v & 1))))[1]"
    told = lambda c, text: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({text})::VARCHAR) || ':' || ({text})::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(told(c, text if c == "text" else c) for c in FIELDS) + ")"
    parts = [
        f"docs AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} AS lower_leaf, coalesce(xor({crc.format(step)}, 4294967295::UBIGINT) % 5 = 0, false) AS tried FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs)",
        "w0 AS (SELECT doc_id, source, leaf, CASE WHEN tried THEN lower_leaf ELSE leaf END AS cur, pos, n, '' AS proof FROM n0)",
        "h0 AS (SELECT source, pos, n, leaf AS h FROM n0)",
    ]

    def level(tree: str, way: str, nodes: str, up: str, way_up: str, by: str, kept: str) -> None:
        left, right = f"left(s, 64 * (w.pos % {FAN}))", f"substr(s, 64 * (w.pos % {FAN}) + 65)"
        parts.append(f"{tree} AS (SELECT {by}, n, pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS s FROM {nodes} GROUP BY ALL)")
        parts.append(f"{up} AS (SELECT {by}, pos, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h FROM {tree})")
        parts.append(
            f"{way_up} AS (SELECT {kept}, CASE WHEN w.n > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, w.pos // {FAN} AS pos, (w.n + {FAN - 1}) // {FAN} AS n, "
            f"CASE WHEN w.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof FROM {way} w JOIN {tree} t ON w.{by} IS NOT DISTINCT FROM t.{by} AND w.pos // {FAN} = t.pos)"
        )

    for k in range(most):
        level(f"t{k}", f"w{k}", f"h{k}", f"h{k + 1}", f"w{k + 1}", "source", "doc_id, w.source, leaf")
    parts.append(f"g0 AS (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM h{most})")
    parts.append(f"v0 AS (SELECT doc_id, leaf, g.h AS subroot, cur, g.pos, g.n, proof, 0 AS one FROM w{most} w JOIN g0 g ON w.source IS NOT DISTINCT FROM g.source)")
    for k in range(most):
        level(f"u{k}", f"v{k}", f"g{k}", f"g{k + 1}", f"v{k + 1}", "one", "doc_id, leaf, subroot, w.one")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, g.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = g.h AS verified FROM v{most} v JOIN g{most} g ON v.one = g.one"


ORACLE = oracle()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, table(spark, sf_dir, "documents"))
