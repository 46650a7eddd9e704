"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 have it. Fingerprints at 3 differing
bits or fewer are linked; documents in a connected component share the smallest doc_id reachable.

Of two halves of 32 bits, one differs in at most one bit between linked fingerprints, which is half the radius. So
every distinct fingerprint emits, for both halves, its half and all variants of it at one bit (66 rows), shuffled and
sorted by variant. Where a variant meets a half that is there itself, the colliding fingerprints are deduplicated and
verified over all 64 bits, and each group of links found becomes a chain to its smallest member.

A variant that over ``LARGE`` fingerprints share is not compared pair by pair. Its fingerprints emit the balls of all
64 bits instead: all variants at one bit or none, and, if the fingerprint has an odd number of bits set, all at two
bits of one half. Linked fingerprints at distance 2 or less share a variant at one bit; at distance 3 exactly one of
them is odd, two of the three bits lie in one half, and the odd one's variant at these meets the even one's at the
third. All that share a variant at one bit are within 2 of each other, and within 3 of those that reach it by two, so a
chain to the smallest one-bit member states every link and nothing else: no pairs are made, however large the group.

Null and empty texts have fingerprint zero, linked as any other. Null ids do not count as the smallest (component_id is
null if a component has no other). Exact copies are one fingerprint from the start. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidark.llm.common import as_bytes, table, whole_row, written
from evidark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints that share a variant and are still compared with each other.
LARGE = 64
_SOME = 65536

HALF = np.array([0, *(1 << np.arange(32, dtype=np.uint64))], np.uint64)
ONE = np.array([0, *(np.uint64(1) << np.arange(64, dtype=np.uint64))], np.uint64)
TWO = np.array([1 << (a + s) | 1 << (b + s) for s in (0, 32) for a, b in combinations(range(32), 2)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-shingle]].tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), _SOME):
        bits = np.unpackbits(np.array(h[at : at + _SOME], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in as_bytes(texts)], np.uint64).view(np.int64))


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns.values()], list(columns))


def half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """variant (half and its side), probe (0 where it is the half itself), fp."""
    probe = np.tile((np.arange(33) > 0).astype(np.int8), 2)
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(every), 4096):
            fp = every[at : at + 4096]
            low, high = fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)
            keys = np.concatenate([low[:, None] ^ HALF, (high[:, None] ^ HALF) | np.uint64(1 << 32)], 1)
            yield _rows({"variant": keys.ravel().view(np.int64), "probe": np.tile(probe, len(fp)), "fp": np.repeat(fp, 66).view(np.int64)})


def chains(fp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (fingerprint, smallest of its links' group) among up to LARGE fingerprints."""
    if len(fp) == 2:
        return [(fp[0], fp[1])] if (int(fp[0]) ^ int(fp[1])).bit_count() <= RADIUS else []
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= RADIUS
    if near.sum() == len(fp):
        return []
    group = np.arange(len(fp))
    while True:
        least = np.where(near, group[None], len(fp)).min(1)
        if (least == group).all():
            return [(fp[i], fp[g]) for i, g in enumerate(group) if g != i]
        group = least


def collisions(batches: Iterator[pa.RecordBatch], most: int = LARGE) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted ``half_variants``; b is null for fingerprints whose variant is shared by too many."""
    key, first, held, large = None, False, [], False  # the variant at hand: is its half there, fingerprints so far
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, probe, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        a: list = []
        b: list = []
        starts = np.flatnonzero(np.diff(variant, prepend=variant[0] - 1 if key is None or variant[0] != key else variant[0]))
        bounds = np.unique(np.r_[0, starts, len(variant)]) if len(variant) else np.array([0])
        sizes = np.diff(bounds)
        # runs of one row inside the batch can be skipped; the first and last run may go on in another batch
        for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            at, to = bounds[i], bounds[i + 1]
            if key is None or variant[at] != key:
                _end(first, held, large, a, b)
                key, first, held, large = variant[at], probe[at] == 0, [], False
            if not first:
                continue
            held.append(fp[at:to])
            if large or sum(map(len, held)) > most:
                large = True
                a.extend(np.concatenate(held).tolist())
                b.extend([None] * sum(map(len, held)))
                held = []
        if a:
            yield _links(a, b)
    a, b = [], []
    _end(first, held, large, a, b)
    if a:
        yield _links(a, b)


def _end(first: bool, held: list, large: bool, a: list, b: list) -> None:
    if first and held and not large and sum(map(len, held)) > 1:
        for x, y in chains(np.concatenate(held)):
            a.append(int(x))
            b.append(int(y))


def _links(a: list, b: list) -> pa.RecordBatch:
    pairs = list(dict.fromkeys(zip(a, b)))
    return pa.record_batch([pa.array([x - (x >> 63 << 64) for x, _ in pairs], pa.int64()), pa.array([None if y is None else y - (y >> 63 << 64) for _, y in pairs], pa.int64())], ["a", "b"])


def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """variant, far (0: at one bit or none; 1: at two), fp."""
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(every), 512):
            fp = every[at : at + 512]
            odd = fp[np.bitwise_count(fp) % 2 == 1]
            near, far = (fp[:, None] ^ ONE).ravel(), (odd[:, None] ^ TWO).ravel()
            yield _rows({
                "variant": np.concatenate([near, far]).view(np.int64),
                "far": np.r_[np.zeros(len(near), np.int8), np.ones(len(far), np.int8)],
                "fp": np.concatenate([np.repeat(fp, len(ONE)), np.repeat(odd, len(TWO))]).view(np.int64),
            })


def ball_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted ``balls``: each row of a variant with the variant's first near one."""
    key, least, near = None, 0, False
    for batch in batches:
        variant, far, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(variant):
            continue
        start = np.r_[key is None or variant[0] != key, variant[1:] != variant[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(variant)), -1))
        head, is_near = np.where(at >= 0, fp[at], least), np.where(at >= 0, far[at] == 0, near)
        use = is_near & (fp != head)
        key, least, near = variant[-1], head[-1], bool(is_near[-1])
        if use.any():
            pairs = np.unique(np.stack([fp[use], head[use]]), axis=1)
            yield _rows({"a": pairs[0], "b": pairs[1]})


def by_variant(df: DataFrame, *then: str) -> DataFrame:
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, "variant").sortWithinPartitions("variant", *then)


def links(spark: SparkSession, distinct: DataFrame, most: int = LARGE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that give the components of all links."""
    found = by_variant(distinct.select("fp").mapInArrow(half_variants, "variant long, probe byte, fp long"), "probe", "fp")
    found = written(spark, found.mapInArrow(partial(collisions, most=most), "a long, b long").distinct(), "collisions")
    crowded = found.where("b IS NULL").select("a")
    rest = by_variant(crowded.mapInArrow(balls, "variant long, far byte, fp long"), "far", "fp").mapInArrow(ball_chains, "a long, b long")
    return found.where("b IS NOT NULL").union(rest)


def near_duplicates(spark: SparkSession, prints: DataFrame, most: int = LARGE) -> DataFrame:
    """fp, least_id, component_id, group (the component's smallest fp) for each distinct fingerprint of ``prints`` (written; columns doc_id, fp)."""
    distinct = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(spark, links(spark, distinct, most))
    least = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("least_id").alias("component"), F.min("fp").alias("group"))
    named = roots.join(least, "root").select("node", "component", "group")
    alone = F.col("node").isNull()
    return distinct.join(named, distinct.fp == named.node, "left").select("fp", "least_id", F.when(alone, F.col("least_id")).otherwise(F.col("component")).alias("component_id"), F.when(alone, F.col("fp")).otherwise(F.col("group")).alias("group"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = written(spark, docs.select("doc_id", fingerprints(F.col("text").cast("string")).alias("fp")), "prints")
    groups = written(spark, near_duplicates(spark, prints), "groups")  # so that the join with many copies can be split
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns of ``docs``.

    Of rows with one id, one stays. Where no document of a group has an id, one of the group's smallest fingerprint does.
    """
    fp = fingerprints(F.col("text").cast("string"))
    prints = written(spark, docs.select("doc_id", fp.alias("fp")), "prints")
    groups = written(spark, near_duplicates(spark, prints), "groups")
    row = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    any_order = F.xxhash64("row")
    stay = groups.where("component_id IS NOT NULL AND least_id = component_id").select(F.col("component_id").alias("id")).distinct()
    named = row.select("row", "id").join(stay, "id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(any_order)))
    bare = groups.where("component_id IS NULL AND fp = group").select("fp")
    unnamed = row.where("id IS NULL").select("row", fingerprints(F.col("text")).alias("fp")).join(bare, "fp", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("fp").orderBy(any_order)))
    return named.where("nth = 1").select("row.*").union(unnamed.where("nth = 1").select("row.*"))
