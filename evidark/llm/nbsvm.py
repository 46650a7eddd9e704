"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams over two alphabets: lower-cased words (1- and 2-grams), and word shapes, which keep
case, digits, symbols and whether the word repeats the one before (1- to 3-grams). They are hashed to 2**18. Indicators
are scaled by the class log-count ratio and then to unit length; a linear hinge-loss model is fitted by dual coordinate
descent, and its margin becomes a probability by a logistic fitted on a fifth of the sample that the first model did
not see.

Fitting takes at most ``MOST_LABELLED`` labelled documents of the table, those with the smallest hashes of their ids, and
one text of each (the smallest, where an id has several). Scoring takes
every whole text. Null texts are empty and score by the intercept; a sample of one class gives its smoothed share.
Labels are grouped by document (1 if most are 1, null ones left out), so repeated labels add no weight; repeated rows
are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidark.llm.common import as_bytes, remainder, table

BITS = 18
MOST_LABELLED = 8000
THRESHOLD = 0.3
COST, PASSES = 4.0, 20
#: Words whose hash and shape are kept at a time.
KEPT = 100_000

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_words: dict[bytes, int] = {}


def describe(word: bytes) -> int:
    """Hash of the lower-cased word and, in the low 16 bits, of its shape."""
    shape = word.translate(_SHAPE)
    short = bytes(c for i, c in enumerate(shape[:24]) if i == 0 or c != shape[i - 1])
    return zlib.crc32(word.lower()) << 16 | zlib.crc32(short[:6]) & 0xFFFF


def features(text: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32)
    if len(_words) > KEPT:
        _words.clear()
    known = _words.get
    described = [known(w) for w in words]
    if None in described:
        for i, (w, d) in enumerate(zip(words, described)):
            if d is None:
                described[i] = d = describe(w)
                if len(w) <= 48:
                    _words[w] = d
    d = np.array(described, np.uint64)
    again = np.r_[False, d[1:] == d[:-1]]
    shape = (d & np.uint64(0xFFFF)) * np.uint64(2) + again
    word = d >> np.uint64(16)
    grams = [word * _MIX[3] + _MIX[0], ((word[:-1] ^ _MIX[1]) * _MIX[2]) ^ (word[1:] * _MIX[0])]
    part = shape * _MIX[0]
    grams.append(part)
    for k in (1, 2):
        if len(d) > k:
            part = (part[:-1] ^ _MIX[3]) * _MIX[2] + shape[k:] * _MIX[1]
            grams.append(part)
    return np.unique((np.concatenate(grams) * _MIX[1]) >> np.uint64(64 - BITS)).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def text_features(texts: pa.Array) -> pa.Array:
    found = [features(t) for t in as_bytes(texts)]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found])))


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratios
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        size = np.sqrt(r @ r)
        return float((r @ self.weight[at]) / size + self.bias if size > 0 else self.bias)

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.shift, -35, 35))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.bincount(np.concatenate([np.empty(0, np.int32), *[r for r, k in zip(rows, y) if k == side]]), minlength=1 << BITS) + 1.0 for side in (1, -1)]
    return np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum())).astype(np.float32)


def hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model: dual coordinate descent; classes cost alike in sum."""
    rng = np.random.default_rng(seed)
    values = [ratio[r] / max(1e-9, float(np.sqrt(ratio[r] @ ratio[r]))) for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    most = {k: cost * len(y) / (2.0 * max(1, (y == k).sum())) for k in (1, -1)}
    w, b, alpha = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(y))
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            k, v, at = y[i], values[i], rows[i]
            g = k * (float(w[at] @ v) + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), most[k])
            if new != alpha[i]:
                step = (new - alpha[i]) * k
                moved = max(moved, abs(step))
                w[at] += np.float32(step) * v
                b += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets and a weak pull to slope 1."""
    up, down = (y == 1).sum(), (y == -1).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        grad = x.T @ (p - target) + 1e-2 * np.array([a[0] - 1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        a = a - np.clip(np.linalg.solve(h, grad), -2, 2)
    return float(a[0]), float(a[1])


def fit(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    y = np.where(quality > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    last = np.arange(len(y)) % 5 == 4
    slope, shift = 4.0, 0.0
    if len(set(y[~last].tolist())) == 2 and last.any():
        seen = [r for r, out in zip(rows, last) if not out]
        ratio = log_count_ratio(seen, y[~last])
        w, b = hinge(seen, y[~last], ratio)
        trial = Model(ratio, w, b, 1.0, 0.0)
        slope, shift = logistic(np.array([trial.margin(r) for r, out in zip(rows, last) if out]), y[last])
    ratio = log_count_ratio(rows, y)
    w, b = hinge(rows, y, ratio)
    return Model(ratio, w, b, slope, shift)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """From at most ``most`` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", (F.col("quality") >= 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # `known` is bounded by `most`
    found = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = found.select("doc_id", "quality", text_features(F.col("text")).alias("at")).toArrow().combine_chunks().sort_by("doc_id")
    lists = rows["at"].combine_chunks() if rows.num_rows else None
    return fit([np.asarray(x.values) for x in lists] if lists is not None else [], rows["quality"].to_numpy())


def scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(features(t)) for t in as_bytes(texts)], pa.float64())

    return lambda text: score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 0


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, learn(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts: all columns of ``docs``."""
    score = scorer(spark, learn(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= THRESHOLD)
