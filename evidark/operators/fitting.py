"""Many binary models in one pass an iteration, and the gate that learns when the best two do not suffice.

A balanced logistic regression for each group of rows (an assignment, a rare family) has its own scales, weights and
intercept. Newton's steps need the gradient and the Hessian of each group: tasks sum both over their rows with the
present coefficients, Spark adds them up by group, and the driver solves one small system for each. So an iteration is one
job over all rows, however many groups there are; the groups' coefficients are what is sent out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.functions.scores import binary_entropy, independence
from evidark.sources.session import reachable, written

#: Groups and features that a fit takes at most: their square goes to the driver as sums, a row a group.
MOST_GROUPS, MOST_FEATURES = 2_000, 400
VERSION = "grouped-logistic-v1"


@dataclass
class GroupedModels:
    """By group: (scale, coefficients of scaled features, intercept), or the constant where one class alone was seen."""

    names: list[str]
    fitted: dict[str, tuple[list[float], list[float], float]]
    constant: dict[str, float]

    def predict(self, rows: DataFrame, group: Column, features: str = "features", out: str = "p") -> DataFrame:
        """``rows`` with the chance of the positive class in the row's group; null in a group that was not fitted."""
        told = {g: [b, *[c / s for c, s in zip(coef, scale)]] for g, (scale, coef, b) in self.fitted.items()}
        spark = rows.sparkSession
        table = spark.createDataFrame([(g, w, None) for g, w in told.items()] + [(g, None, c) for g, c in self.constant.items()], "_group string, _w array<double>, _c double")
        linear = F.col("_w")[0]
        for i, n in enumerate(self.names):
            linear = linear + F.col("_w")[i + 1] * feature(features, n)
        p = F.coalesce("_c", 1 / (1 + F.exp(-linear)))
        joined = rows.withColumn("_key", group.cast("string")).join(F.broadcast(table), F.col("_key") == F.col("_group"), "left")  # at most MOST_GROUPS rows
        return joined.withColumn(out, p).select(*rows.columns, out)

    def save(self, path: str) -> None:
        head = {"version": VERSION, "names": self.names, "fitted": self.fitted, "constant": self.constant}
        SparkSession.active().createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> GroupedModels:
        head = json.loads(SparkSession.active().read.text(path).first()[0])
        if head.get("version") != VERSION:
            raise ValueError(f"model version {head.get('version')} is not {VERSION}")
        return GroupedModels(head["names"], {g: tuple(x) for g, x in head["fitted"].items()}, head["constant"])


def feature(features: str, name: str) -> Column:
    return F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0))


def fit_groups(rows: DataFrame, names: list[str], group: str, label: str, features: str = "features", penalty: float = 1.0, most_iterations: int = 50, tolerance: float = 1e-10) -> GroupedModels:
    """Balanced logistic regressions of ``label`` (boolean), one for each value of ``group``.

    Each has the optimum of ``models.fit_binary`` on its rows: deviations of its own rows scale its features, classes weigh
    alike, and L2 of 1 / penalty holds the coefficients. Rows without a label or group teach nothing.
    """
    reachable(rows.sparkSession)
    if len(names) > MOST_FEATURES:
        raise ValueError(f"{len(names)} features; a fit takes {MOST_FEATURES}")
    x = F.array(*[feature(features, n) for n in names]) if names else F.array().cast("array<double>")
    ready = written(rows.select(F.col(group).cast("string").alias("g"), F.col(label).cast("boolean").alias("y"), x.cast("array<double>").alias("x")).where("g IS NOT NULL AND y IS NOT NULL"), "fit")
    moments = ready.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("yes"), F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(len(names))]).alias("sd")).limit(MOST_GROUPS + 1).collect()
    if len(moments) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    constant = {r["g"]: float(r["yes"] > 0) for r in moments if r["yes"] in (0, r["n"])}
    open_ = {r["g"]: r for r in moments if r["g"] not in constant}
    scale = {g: np.array([s or 1.0 for s in r["sd"]]) for g, r in open_.items()}
    weight = {g: (r["n"] / (2 * (r["n"] - r["yes"])), r["n"] / (2 * r["yes"])) for g, r in open_.items()}
    at = {g: np.zeros(len(names) + 1) for g in open_}
    ridge = np.diag([0.0] + [1.0 / penalty] * len(names))
    waiting = set(open_)
    for _ in range(most_iterations):
        if not waiting:
            break
        for g, (gradient, hessian) in sums(ready, {g: (scale[g], weight[g], at[g]) for g in waiting}, len(names)).items():
            step = np.linalg.solve(hessian + ridge, gradient + ridge @ at[g])
            at[g] = at[g] - step * min(1.0, 20.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < tolerance:
                waiting.discard(g)
    return GroupedModels(list(names), {g: (scale[g].tolist(), b[1:].tolist(), float(b[0])) for g, b in at.items()}, constant)


def sums(ready: DataFrame, state: dict[str, tuple[np.ndarray, tuple[float, float], np.ndarray]], width: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian of each group's loss at its coefficients, from one job."""
    size = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            g, y = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(y), 0))
            code = g.indices.to_numpy()
            for k, name in enumerate(g.dictionary.to_pylist()):
                if name not in state:
                    continue
                scale, (no, yes), b = state[name]
                rows = code == k
                one = np.c_[np.ones(rows.sum()), x[rows] / scale]
                w, p = np.where(y[rows], yes, no), 1 / (1 + np.exp(-np.clip(one @ b, -500, 500)))
                both = np.c_[one.T @ (w * (p - y[rows])), (one.T * (w * p * (1 - p))) @ one].ravel()
                total[name] = total.get(name, 0) + both
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["g", "v"])

    parts = ready.mapInArrow(run, "g string, v array<double>").select("g", F.posexplode("v").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {g: np.zeros(size * (size + 1)) for g in state}
    for r in parts.collect():  # size * (size + 1) numbers a group
        out[r["g"]][r["k"]] = r["v"]
    return {g: (v.reshape(size, size + 1)[:, 0], v.reshape(size, size + 1)[:, 1:]) for g, v in out.items()}


def fit_rare(samples: DataFrame, names: list[str], anchors: list[str], rare: list[str] | None = None, features: str = "features") -> GroupedModels:
    """A trigger for each rare family (``rare``, else all labels that are no anchor), on all samples (labels, features)."""
    found = rare if rare is not None else sorted(r[0] for r in samples.select(F.explode("labels").alias("l")).distinct().collect() if r[0] not in anchors)  # families are few
    if not found:
        raise ValueError("no rare family among the labels")
    each = samples.withColumn("_family", F.explode(F.array(*map(F.lit, found)))).withColumn("_y", F.array_contains("labels", F.col("_family")))
    return fit_groups(each, names, "_family", "_y", features)


def rare_scores(model: GroupedModels, samples: DataFrame, features: str = "features", out: str = "rare") -> DataFrame:
    """``samples`` with a map of rare family to its chance."""
    keyed = samples.withColumn("_row", F.struct(*samples.columns))
    families = sorted([*model.fitted, *model.constant])
    wide = keyed
    for f in families:
        wide = model.predict(wide, F.lit(f), features, f"_p_{f}")
    pairs = [x for f in families for x in (F.lit(f), F.col(f"_p_{f}"))]
    return wide.withColumn(out, F.create_map(*pairs)).select("_row.*", out)


def gate_features(features: Column, suspicion: Column, chances: Column, ranked: Column, experts: list[str]) -> Column:
    """What the gate learns from: the candidate's features, every expert's chance, the best two and how sure they are."""
    held = [F.least(F.greatest(F.coalesce(F.try_element_at(chances, F.lit(e)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for e in experts]
    order = F.reverse(F.array_sort(F.array(*held)))
    p1, p2 = (F.coalesce(F.try_element_at(order, F.lit(i)), F.lit(0.0)) for i in (1, 2))
    entropy = sum((binary_entropy(p) for p in held), F.lit(0.0)) / max(1, len(experts))
    named = {"candidate::suspicion_score": suspicion, "gate::p1": p1, "gate::p2": p2, "gate::margin": p1 - p2, "gate::independence_confidence": independence(p1, p2), "gate::mean_binary_entropy": entropy}
    named |= {f"probability::{e}": p for e, p in zip(experts, held)}
    named |= {f"top{i}::{e}": (F.try_element_at(ranked, F.lit(i)) == e).cast("double") for i in (1, 2) for e in experts}
    own = F.transform_keys(F.coalesce(features, F.create_map().cast("map<string,double>")), lambda k, _: F.concat(F.lit("candidate::"), k))
    made = F.create_map(*[x for n, c in named.items() for x in (F.lit(n), F.coalesce(c.cast("double"), F.lit(0.0)))])
    return F.map_concat(F.map_filter(own, lambda k, _: k != "candidate::suspicion_score"), made)


def best_two_suffice(outcomes: DataFrame, by: list[str], place: str = "place", top: int = 2) -> DataFrame:
    """``by``, sufficient: whether the best ``top`` outcomes match every truth that any of the candidate's outcomes names."""
    empty = F.array().cast("array<string>")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    g = outcomes.groupBy(*by).agg(union(F.coalesce("ground_truth_ids", empty)).alias("t"), union(F.when(F.col(place) <= top, F.coalesce("matched_truth_ids", empty)).otherwise(empty)).alias("m"))
    return g.select(*by, (F.size(F.array_except("t", "m")) == 0).alias("sufficient"))


class EscalationGate(Estimator):
    """Learns the chance that the best two suffice, from rows with a map of features and a boolean label."""

    def __init__(self, features: str = "gate", label: str = "sufficient", prediction: str = "confidence", penalty: float = 1.0):
        super().__init__()
        self.features, self.label, self.prediction, self.penalty = features, label, prediction, penalty

    def _fit(self, dataset: DataFrame) -> EscalationGateModel:
        names = sorted(r[0] for r in dataset.select(F.explode(F.map_keys(self.features))).distinct().limit(MOST_FEATURES + 1).collect())
        fitted = fit_groups(dataset.withColumn("_one", F.lit("gate")), names, "_one", self.label, self.features, self.penalty)
        if not fitted.fitted and not fitted.constant:
            raise ValueError("the gate needs rows with a label")
        return EscalationGateModel(fitted, self.features, self.prediction)


class EscalationGateModel(Model):
    """``transform`` adds the chance that the best two suffice; candidates below a threshold are escalated."""

    def __init__(self, fitted: GroupedModels, features: str = "gate", prediction: str = "confidence"):
        super().__init__()
        self.fitted, self.features, self.prediction = fitted, features, prediction

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset, F.lit("gate"), self.features, self.prediction)

    def save(self, path: str) -> None:
        self.fitted.save(path)

    @staticmethod
    def load(path: str, features: str = "gate", prediction: str = "confidence") -> EscalationGateModel:
        return EscalationGateModel(GroupedModels.load(path), features, prediction)
