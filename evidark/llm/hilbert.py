"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class. Each curve projects the classes onto random orthonormal directions, shifts the grid, and
orders them by Hilbert index; Spark range-partitions the orders, and each class gets its exact position on each curve.
Positions fall into blocks; a query meets its own block and the two beside it on every curve. Its best neighbours by
exact cosine (double precision, original vectors) are merged over curves, and classes are expanded to their ids again.

A curve has ``BLOCKS`` blocks, or fewer so that none has under ``LEAST`` classes: recall does not sink as the data
grow, even when they have no structure to find (then a query meets about half of all rows over all curves). Blocks are
dealt in pieces of ``PIECE`` rows, so a task holds one piece and the queries beside it.

Rows whose vector is null, zero, or holds a null or non-finite number, take no part, nor do rows with a null id or
whose vector's length is not the most frequent one (the longest of these). Rows with equal ids and vectors are one; an
id with several vectors is as near as its nearest one. A query without neighbours gives no rows, as an empty table does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidark.llm.common import table, written

CURVES, DIMS, BITS = 40, 12, 5
BLOCKS, LEAST, PIECE = 192, 24, 4096
NEAREST, EVERY = 5, 50


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points on a grid of ``2**bits`` cells a side (rows: points)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    level = top
    while level > 1:  # undo the rotations from the coarsest level down
        low = level - 1
        for i in range(len(x)):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn, level = np.zeros(x.shape[1], np.int64), top
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for row in x:
            out = out << 1 | (row >> b) & 1
    return out


def curve(n: int, width: int, dims: int = DIMS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Directions (width by dims) and shift of the n-th curve."""
    rng = np.random.default_rng([seed, n])
    directions = np.linalg.qr(rng.normal(size=(width, max(1, min(width, dims)))))[0]
    return directions, rng.random(directions.shape[1])


def curve_keys(vectors: np.ndarray, n: int) -> np.ndarray:
    """Hilbert index of unit vectors on the n-th curve. Projections beyond four deviations of a random one are clipped."""
    directions, shift = curve(n, vectors.shape[1])
    reach = 4 / np.sqrt(vectors.shape[1])
    at = (np.clip(vectors @ directions, -reach, reach) / reach + 1) / 2  # 0 to 1; the shift needs as much again
    return hilbert_index(np.minimum((at + shift) / 2 * (1 << BITS), (1 << BITS) - 1), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def classes_of(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (vec_id, class) and classes (class, embedding, ids: the smallest NEAREST + 1 of its ids)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite)
    lengths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    valid = valid.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0)).withColumn("digest", F.xxhash64("embedding"))
    firsts = written(spark, valid.groupBy("digest", "embedding").agg(F.min("vec_id").alias("class")), "classes")
    named = written(spark, valid.join(firsts.withColumnRenamed("embedding", "e"), "digest").where("embedding = e").select("vec_id", "class").distinct(), "ids")
    few = named.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("n") <= NEAREST + 1)
    ids = few.groupBy("class").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most NEAREST + 1
    return named, written(spark, firsts.select("class", "embedding").join(ids, "class"), "classes")


def positions(spark: SparkSession, classes: DataFrame, count: int, curves: int) -> tuple[DataFrame, int, int]:
    """class, curve, block, piece; the number of blocks and of pieces of a block."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            v /= np.abs(v).max(1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for n in range(curves):
                yield pa.record_batch([batch.column(0), pa.array(np.full(len(v), n, np.int32)), pa.array(curve_keys(v, n))], ["class", "curve", "key"])

    def count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(curves, np.int64)
        for batch in batches:
            at, nth = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for n in np.unique(at):
                of = np.flatnonzero(at == n)
                nth[of] = seen[n] + np.arange(len(of))
                seen[n] += len(of)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(nth), part, np.int32)), pa.array(nth)], ["class", "curve", "part", "nth"])

    keyed = written(spark, classes.select("class", "embedding").mapInArrow(keys, "class long, curve int, key long"), "keys")
    ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(ways, "curve", "key", "class").sortWithinPartitions("curve", "key", "class")
    ordered = written(spark, ordered.mapInArrow(count_off, "class long, curve int, part int, nth long"), "ordered")
    counts = ordered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("curve", "part", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    blocks = max(1, min(BLOCKS, count // LEAST))
    pieces = -(-count // (blocks * PIECE))
    at = ordered.join(before, ["curve", "part"]).withColumn("position", F.col("before") + F.col("nth"))
    return at.select("class", "curve", F.floor(F.col("position") * blocks / F.lit(max(1, count))).cast("int").alias("block"), (F.col("position") % max(1, pieces)).cast("int").alias("piece")), blocks, max(1, pieces)


def compare(group: pa.Table) -> pa.Table:
    """The nearest of a piece's candidates for each query that is dealt to it."""
    query = group["query"].to_numpy()
    ids, v = group["class"].to_numpy(), matrix(group["embedding"])
    order = np.argsort(ids[~query], kind="stable")  # ties go to the smaller class
    cand, cv = ids[~query][order], v[~query][order]
    qs, qv = ids[query], v[query]
    out: tuple[list, list, list] = ([], [], [])
    if len(cand) and len(qs):
        norms = np.sqrt((cv * cv).sum(1))
        for at in range(0, len(qs), 256):
            q, w = qs[at : at + 256], qv[at : at + 256]
            s = (w @ cv.T) / (np.sqrt((w * w).sum(1))[:, None] * norms)
            s[q[:, None] == cand[None]] = -np.inf
            k = min(NEAREST, len(cand))
            last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if len(cand) > k else np.full((len(q), 1), -np.inf)
            i, j = np.nonzero((s >= last) & (s > -np.inf))
            sort = np.lexsort((j, -s[i, j], i))
            i, j = i[sort], j[sort]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
            for column, x in zip(out, (q[i], cand[j], s[i, j])):
                column.append(x)
    join = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table({"query": join[0], "near": join[1], "score": join[2]})


def nearest(spark: SparkSession, rows: DataFrame, every: int = EVERY, k: int = NEAREST, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for every row whose id is divisible by ``every``."""
    named, classes = classes_of(spark, rows)
    count = classes.count()
    asked = named.where(F.col("vec_id") % every == 0)
    placed, blocks, pieces = positions(spark, classes, count, curves)
    placed = written(spark, placed, "placed")
    vectors = classes.select("class", "embedding")
    near = placed.join(asked.select("class").distinct(), "class", "left_semi")
    beside = near.select("class", "curve", F.explode(F.expr("transform(array(-1, 0, 1), d -> block + d)")).alias("block"))
    beside = beside.where((F.col("block") >= 0) & (F.col("block") < blocks)).select("class", "curve", "block", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    dealt = placed.select("class", "curve", "block", "piece", F.lit(False).alias("query")).union(beside.select("class", "curve", "block", "piece", F.lit(True)))
    dealt = dealt.join(vectors, "class")
    found = dealt.groupBy("curve", "block", "piece").applyInArrow(compare, "query long, near long, score double")
    found = found.groupBy("query", "near").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))).where(F.col("n") <= k)
    best = best.join(classes.select(F.col("class").alias("near"), "ids"), "near")
    others = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("others"))  # at most k
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    own = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", F.col("ids"), (norm / (F.sqrt(norm) * F.sqrt(norm))).alias("own_score"))
    answers = own.join(others, own["class"] == others["query"], "left").select("class", F.flatten(F.transform(F.array_append(F.coalesce("others", F.array().cast("array<struct<score:double,ids:array<bigint>>>")), F.struct(F.col("own_score").alias("score"), F.col("ids").alias("ids"))), lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("down"), i.alias("id"))))).alias("all"))
    answers = written(spark, answers, "answers")
    told = asked.join(answers, "class").select(F.col("vec_id").alias("query_id"), F.slice(F.array_sort(F.filter("all", lambda x: x["id"] != F.col("vec_id"))), 1, 2 * k).alias("all"))
    told = told.select("query_id", F.posexplode("all").alias("n", "x"))
    # an id with several vectors counts once, at its nearest; a query id with several vectors pools them
    told = told.groupBy("query_id", F.col("x.id").alias("vec_id")).agg((-F.min("x.down")).alias("score"))
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return told.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))
