"""Language-model scores: log-bilinear neural models trained by noise-contrastive estimation, and a unigram base.

Tokens are lower-cased (A-Z) words and one end for each text; a word goes by 64 bits, 56 of a digest and 8 for the class of
its last two bytes. Nothing is cut from what is learnt: every distinct word and every pair of neighbouring words of the
training texts is counted, however many there are.

The neural models predict a unit from the unit one place before and from the unit two places before. Units are the most
frequent words, the end, and classes of all other words; a word has its share of its class by count, (c + 0.5) out of
(n + 0.5 (v + 1)) for n tokens and v words of the class, so unseen words have what 0.5 leaves them. Training sees all pairs
of units of all training texts at both distances, summed on the executors (at most ``UNITS`` squared numbers for each
distance, whatever the corpus); noise-contrastive estimation on those sums takes the noise by expectation instead of by
sampling, and numpy matrix products give all scores, gradients and the normalised log-probabilities of all units. The
places' weights, which sum to one, are fitted by expectation-maximisation over all training tokens. Their mixture p(w | h)
is the prior of what is learnt of whole words: the probability of w after h is (c(h, w) + PRIOR p(w | h)) out of
(c(h) + PRIOR). It sums to one as p does.

Texts are encoded once, in rows of up to ``ROW`` tokens with their distinct words. Words that make up a ``FREQUENT``-th of
all tokens or more (so at most ``FREQUENT`` words) have their counts broadcast, and pairs of words that are units of their
own are in the sums of units. Counts of all other words and pairs are asked for by row: a row sends each key once, with its
count, to the bucket of that key, and gets the sums back. So a hot key sends one number for a row, and a bucket holds about
``KEYS`` numbers, however many there are in all; keys go there by 48 bits beside the bucket's own. Numbers travel as packed
bytes, as they are most of what is shuffled.

Null texts are empty: the end alone. Rows are scored one by one, so repeated rows and null ids are kept; a null id is
learnt from as crc32 of the empty text says. Long texts are read in pieces with the words before them. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.llm.common import as_bytes, remainder, table, written

FREQUENT = 2_000_000
WORDS, CLASSES = 768, 256
UNITS = WORDS + CLASSES
PLACES = 2
DIM, NOISE, STEPS, RATE = 48, 8, 160, 0.05
#: What the neural models' probability weighs against counts of pairs, in tokens.
PRIOR = 5000.0
END = b"\n"
#: Tokens of a row and of a part of a text, and numbers that a bucket holds on average.
ROW, PART, KEYS = 600_000, 10_000, 1_000_000
LOG10 = np.log(10.0)

ROWS = "row long, rid array<long>, doc_id array<long>, training array<boolean>, n array<int>, lead array<int>, key binary, c binary, at binary"


def number(word: bytes) -> int:
    """64 bits of a word; the lowest 8 are its class."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=7).digest() + bytes([zlib.crc32(word[-2:]) % CLASSES]), "big", signed=True)


END_NUMBER = number(END)


CODEC = pa.Codec("zstd", compression_level=1)


def pressed(x: np.ndarray) -> bytes:
    """32-bit numbers compressed, first bytes first: a third of what is written and shuffled are these."""
    return len(x).to_bytes(8, "little") + CODEC.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpressed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.ascontiguousarray(np.frombuffer(CODEC.decompress(data[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n).T).view("<i4").ravel()


def encoded(batches: Iterator[pa.RecordBatch], size: int = ROW) -> Iterator[pa.RecordBatch]:
    """ROWS: distinct words, their counts in training, and each token's place among them. ``lead`` has two words for each text, those before it."""
    task, rows, rid = TaskContext.get().partitionId() << 36, count(), count()

    def fresh():
        place = defaultdict(count().__next__)
        place[END]
        return place, [], ([], [], [], [], [])

    def row(place: dict, at: list[np.ndarray], columns: tuple) -> pa.RecordBatch:
        texts, ids, learnt, n, lead = columns
        joined = np.concatenate(at)
        c = np.bincount(joined[np.repeat(np.array(learnt, bool), n)], minlength=len(place))
        lists = (np.array(texts, np.int64), pa.array(ids, pa.int64()), pa.array(learnt), np.array(n, np.int32), np.array(lead, np.int32))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in lists]
        packed = [np.array([number(w) for w in place], np.int64).tobytes(), pressed(c), pressed(joined)]
        return pa.record_batch([pa.array([task + next(rows)], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in packed]], ["row", "rid", "doc_id", "training", "n", "lead", "key", "c", "at"])

    place, at, columns = fresh()
    held = 0
    for batch in batches:
        for doc, learnt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            words = text.lower().split() if text else []
            words.append(END)
            text_number, before = task + next(rid), [END, END]
            for start in range(0, len(words), PART):
                part = words[start : start + PART]
                if held >= size:
                    yield row(place, at, columns)
                    place, at, columns = fresh()
                    held = 0
                at.append(np.fromiter(map(place.__getitem__, part), np.int32, len(part)))
                for column, x in zip(columns, (text_number, doc, learnt, len(part))):
                    column.append(x)
                columns[4].extend([place[w] for w in before])
                before, held = (before + part[-2:])[-2:], held + len(part)
    if held:
        yield row(place, at, columns)


@dataclass
class Row:
    """One row of ROWS as arrays."""

    row: int
    rid: np.ndarray
    doc_id: list
    training: np.ndarray
    n: np.ndarray
    lead: np.ndarray
    key: np.ndarray
    c: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Iterator[Row]:
        for i in range(batch.num_rows):
            f = {name: batch.column(batch.schema.get_field_index(name))[i] for name in cls.__dataclass_fields__}
            plain = {name: f[name].values.to_numpy(zero_copy_only=False) for name in ("rid", "training", "n", "lead")}
            key, c, at = (f[name].as_py() for name in ("key", "c", "at"))
            yield cls(row=f["row"].as_py(), doc_id=f["doc_id"].values.to_pylist(), **plain, key=np.frombuffer(key, np.int64), c=unpressed(c) if c else np.empty(0, np.int32), at=unpressed(at))

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words one and two before each token."""
        starts = np.cumsum(self.n) - self.n
        one = np.empty_like(self.at)
        one[1:] = self.at[:-1]
        one[starts] = self.lead[1::2]
        two = np.empty_like(self.at)
        two[1:] = one[:-1]
        two[starts] = self.lead[::2]
        return one, two


@dataclass
class Head:
    """Frequent words in the order of their numbers, with counts in training and units; what classes share."""

    key: np.ndarray
    c: np.ndarray
    unit: np.ndarray
    class_rest: np.ndarray  # log10 of each class's denominator
    tokens: int
    distinct: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the arrays; -1 for words that are not there."""
        if not len(self.key):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def units(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        other = WORDS + (keys & (CLASSES - 1))
        return np.where(at >= 0, self.unit[at], other) if len(self.key) else other

    def share(self, c: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its unit."""
        return np.where(unit < WORDS, 0.0, np.log10(c + 0.5) - self.class_rest[np.maximum(unit - WORDS, 0)])


def head_of(spark: SparkSession, rows: DataFrame) -> Head:
    """From counts of every distinct word; the units are chosen by counts in training."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, c = np.frombuffer(key, np.int64), unpressed(c)
                yield pa.record_batch([pa.array(key[c > 0]), pa.array(c[c > 0])], ["key", "c"])

    words = rows.select("key", "c").mapInArrow(counts, "key long, c int").groupBy("key").agg(F.sum("c").alias("c"))
    words = written(spark, words, "words")
    sums = words.groupBy((F.col("key").bitwiseAND(F.lit(CLASSES - 1))).alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row a class
    n, v = (sum(r[x] for r in sums) for x in ("n", "v"))
    frequent = words.where(F.col("c").cast("double") * FREQUENT >= float(n)).toArrow()
    key, c = frequent["key"].to_numpy(), frequent["c"].to_numpy()
    own = np.lexsort((key, -c, key != END_NUMBER))[:WORDS]  # the end is the first unit
    size, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        size[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    np.subtract.at(size, key[own] & (CLASSES - 1), c[own].astype(float))
    np.subtract.at(distinct, key[own] & (CLASSES - 1), 1.0)
    unit = WORDS + (key & (CLASSES - 1))
    unit[own] = np.arange(len(own))
    order = np.argsort(key)
    return Head(key[order], c[order], unit[order], np.log10(size + 0.5 * (distinct + 1)), n, v)


def unit_pairs(rows: DataFrame, head) -> np.ndarray:
    """Sums of pairs of units over all training texts, for each place: place, unit before, unit."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, total = head.value, np.zeros(PLACES * UNITS * UNITS, np.int64)
        for batch in batches:
            for r in Row.of(batch):
                unit, learnt = h.units(r.key, h.find(r.key)), np.repeat(r.training, r.n)
                now = unit[r.at[learnt]]
                for place, before in enumerate(r.before()):
                    total += np.bincount((place * UNITS + unit[before[learnt]]) * UNITS + now, minlength=len(total))
        at = np.flatnonzero(total)
        for start in range(0, len(at), 500_000):
            some = at[start : start + 500_000]
            yield pa.record_batch([pa.array(some), pa.array(total[some])], ["pair", "n"])

    found = rows.select("row", "rid", "doc_id", "training", "n", "lead", "key", "c", "at").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most PLACES times UNITS squared rows
    out = np.zeros(PLACES * UNITS * UNITS)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(PLACES, UNITS, UNITS)


def train(counts: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int | None = None, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of contexts (by the context matrix) and units, and biases: Adam on the expected NCE objective."""
    rng, k, steps = np.random.default_rng(seed), noise, steps or STEPS
    joint = (counts / max(1.0, counts.sum())).astype(np.float32)
    context = joint.sum(1, keepdims=True)
    noise_p = counts.sum(0) + 0.5
    noise_p = (noise_p / noise_p.sum()).astype(np.float32)
    drawn, shift = k * context * noise_p, np.log(k * noise_p)
    p = [rng.normal(0, 0.1, (len(counts), dim)), np.eye(dim), rng.normal(0, 0.1, (len(counts), dim)), np.log(noise_p)]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        r, c, q, b = p
        rc = r @ c
        share = 1 / (1 + np.exp(-np.clip(rc @ q.T + b - shift, -30, 30)))  # of data rather than noise
        g = (joint + drawn) * share - joint
        grc = g @ q
        grads = [grc @ c.T, r.T @ grc, g.T @ rc, g.sum(0)]
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.99 * v[i] + 0.01 * x * x
            p[i] -= rate * (1 - 0.9 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-12)
    return p[0] @ p[1], p[2], p[3]


def log_table(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 P(unit | unit before), normalised over units: one matrix product."""
    contexts, units, bias = (x.astype(np.float64) for x in model)
    s = contexts @ units.T + bias
    s -= s.max(1, keepdims=True)
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / LOG10


@dataclass
class Model:
    """Probabilities of units by place, the places' weights, and how often a unit follows another."""

    chance: np.ndarray
    weight: np.ndarray
    pairs: np.ndarray

    def prior(self, unit: np.ndarray, now: np.ndarray, before: tuple[np.ndarray, ...]) -> np.ndarray:
        return sum(w * p[unit[b], unit[now]] for w, p, b in zip(self.weight, self.chance, before))


def place_weights(rows: DataFrame, head, chance, turns: int = 8) -> np.ndarray:
    """Weights of the places: expectation-maximisation over each row's training tokens, averaged by tokens."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, total, n = head.value, np.zeros(PLACES), 0
        for batch in batches:
            for r in Row.of(batch):
                unit, learnt = h.units(r.key, h.find(r.key)), np.repeat(r.training, r.n)
                now = unit[r.at[learnt]]
                p = np.stack([t[unit[b[learnt]], now] for t, b in zip(chance.value, r.before())])
                w = np.full(PLACES, 1.0 / PLACES, np.float32)
                for _ in range(turns if p.shape[1] else 0):
                    given = w[:, None] * p
                    w = (given / given.sum(0)).mean(1)
                total, n = total + w * p.shape[1], n + p.shape[1]
        yield pa.record_batch([pa.array([float(n)]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "w"])

    said = rows.mapInArrow(fit, "n double, w array<double>").agg(F.sum("n").alias("n"), *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(PLACES)]).first()
    return np.array([said[f"w{i}"] for i in range(PLACES)]) / said["n"] if said["n"] else np.full(PLACES, 1.0 / PLACES)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """64 bits of two numbers in order."""
    b = b.astype(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b)
    z = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
    return z ^ (z >> np.uint64(29))


@dataclass
class Asked:
    """A row's keys in order, each once: pairs of words, and words that are not frequent."""

    keys: np.ndarray
    counts: np.ndarray
    far: np.ndarray  # tokens whose pair is asked for
    pair_at: np.ndarray  # its place among the keys
    rare: np.ndarray  # words that are asked for
    rare_at: np.ndarray

    @classmethod
    def of(cls, r: Row, known: np.ndarray, unit: np.ndarray, before: np.ndarray) -> Asked:
        far = np.flatnonzero((unit[before] >= WORDS) | (unit[r.at] >= WORDS))
        rare = np.flatnonzero(known < 0)
        asked = np.concatenate([mixed(r.key[before[far]], r.key[r.at[far]]), mixed(r.key[rare], 1)])
        n = np.concatenate([np.repeat(r.training, r.n)[far].astype(np.int64), (r.c[rare] if len(r.c) else np.zeros(len(rare))).astype(np.int64)])
        order = np.argsort(asked)
        some = asked[order]
        first = np.r_[True, some[1:] != some[:-1]] if len(some) else np.empty(0, bool)
        starts, place = np.flatnonzero(first), np.empty(len(some), np.int64)
        place[order] = np.cumsum(first) - 1
        return cls(some[starts], np.add.reduceat(n[order], starts) if len(starts) else n, far, place[: len(far)], rare, place[len(far) :])


def packed_keys(keys: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """The first 48 bits of each key's place in its bucket, as six bytes."""
    inside = (keys - bucket.astype(np.uint64) * np.uint64(width)) >> np.uint64(max(0, width.bit_length() - 48))
    return inside.view(np.uint8).reshape(-1, 8)[:, :6]


def opened_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


MOST = 255


def packed_counts(c: np.ndarray) -> bytes:
    """One byte each; what does not fit follows in full."""
    small = np.minimum(c, MOST).astype(np.uint8)
    return small.tobytes() + c[small == MOST].astype(np.int64).tobytes()


def opened_counts(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n)
    out = small.astype(np.int64)
    out[small == MOST] = np.frombuffer(data, np.int64, offset=n)
    return out


def asked_sums(spark: SparkSession, rows: DataFrame, head, buckets: int) -> DataFrame:
    """row, bucket, n, sums: for each row the sums of its keys in that bucket, in the keys' order (packed)."""
    width = 2**64 // buckets + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        for batch in batches:
            for r in Row.of(batch):
                known = h.find(r.key)
                a = Asked.of(r, known, h.units(r.key, known), r.before()[0])
                bucket = (a.keys // np.uint64(width)).astype(np.int64)
                keys, counts = packed_keys(a.keys, bucket, width), a.counts
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
                ends = [*starts[1:].tolist(), len(bucket)]
                spans = list(zip(starts.tolist(), ends))
                yield pa.record_batch(
                    [pa.array(np.full(len(starts), r.row)), pa.array(bucket[starts]), pa.array([b - a for a, b in spans], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([packed_counts(counts[a:b]) for a, b in spans], pa.binary())],
                    ["row", "bucket", "n", "key", "c"],
                )

    def answer(group: pa.Table) -> pa.Table:
        n = group["n"].to_pylist()
        keys = np.concatenate([opened_keys(x) for x in group["key"].to_pylist()])
        c = np.concatenate([opened_counts(x, k) for x, k in zip(group["c"].to_pylist(), n)])
        order = np.argsort(keys)
        some = keys[order]
        first = np.r_[True, some[1:] != some[:-1]]
        sums = np.add.reduceat(c[order], np.flatnonzero(first))
        back = np.empty(len(keys), np.int64)
        back[order] = sums[np.cumsum(first) - 1]
        parts = np.split(back, np.cumsum(n)[:-1])
        return pa.table({"row": group["row"], "bucket": group["bucket"], "n": group["n"], "sums": pa.array([packed_counts(p) for p in parts], pa.binary())})

    sent = rows.mapInArrow(ask, "row long, bucket long, n int, key binary, c binary")
    return sent.groupBy("bucket").applyInArrow(answer, "row long, bucket long, n int, sums binary")


SCORES = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def row_scores(r: Row, h: Head, m: Model, sums: np.ndarray) -> pa.Table:
    """SCORES of the texts of one row; ``sums`` are of its ``Asked.keys``."""
    known, before = h.find(r.key), r.before()
    unit = h.units(r.key, known)
    a = Asked.of(r, known, unit, before[0])
    c = np.where(known >= 0, h.c[known], 0).astype(np.float64) if len(h.key) else np.zeros(len(known))
    c[a.rare] = sums[a.rare_at]
    now, ahead = r.at, before[0]
    pair = m.pairs[unit[ahead], unit[now]]  # of units of their own; the others' follow
    pair[a.far] = sums[a.pair_at]
    prior = m.prior(unit, now, before) * (10.0 ** h.share(c, unit))[now]
    score = np.log10(pair + PRIOR * prior) - np.log10(c + PRIOR)[ahead]
    base = (np.log10(c + 0.5) - np.log10(h.tokens + 0.5 * (h.distinct + 1)))[now]
    starts = np.cumsum(r.n) - r.n
    by_text = lambda x: np.add.reduceat(x, starts)
    return pa.table({"rid": r.rid, "doc_id": pa.array(r.doc_id, pa.int64()), "held_out": ~r.training, "n_tokens": r.n.astype(np.int64), "n_known": by_text((c > 0)[now].astype(np.int64)), "base": by_text(base), "score": by_text(score)})


def lm_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` has doc_id, text and training; see ``op2_bilinear_lm`` for the columns that come back."""
    rows = written(spark, docs.select("doc_id", "training", "text").mapInArrow(partial(encoded, size=ROW), ROWS), "tokens")
    found = head_of(spark, rows)
    head = spark.sparkContext.broadcast(found)
    pairs = unit_pairs(rows, head)
    chance = spark.sparkContext.broadcast([(10.0 ** log_table(train(p))).astype(np.float32) for p in pairs])
    model = spark.sparkContext.broadcast(Model(chance.value, place_weights(rows, head, chance), pairs[0]))
    every = rows.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every // KEYS + 1)
    sums = asked_sums(spark, rows, head, buckets)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        got = [opened_counts(x, n) for x, n in zip(right["sums"].to_pylist(), right["n"].to_pylist())]
        got = np.concatenate([np.empty(0, np.int64), *got])
        return pa.concat_tables([row_scores(r, head.value, model.value, got) for r in Row.of(left.combine_chunks())])

    parts = rows.withColumn("c", F.lit(b"")).groupBy("row").cogroup(sums.groupBy("row")).applyInArrow(finish, SCORES)
    texts = parts.groupBy("rid").agg(*[F.max(x).alias(x) for x in ("doc_id", "held_out")], *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return texts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder(F.col("doc_id")) != 1).alias("training")))
