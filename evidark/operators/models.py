"""Learned operators on pyspark.ml: softmax and binary routing models, utility models, persisted with a version."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.operators.fitting import GroupedModels, fit_groups

VERSION = "routing-model-v1"


def one_version(rows: DataFrame, column: str = "feature_schema_version") -> str:
    """The only feature version of a training set; several or none raise."""
    found = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"training needs exactly one feature schema version, found {found}")
    return found[0]


@dataclass
class RoutingModel:
    """Probabilities of labels from named features: scaled by population deviation, classes weighted alike, L2."""

    names: list[str]
    scale: list[float]
    labels: list[str]
    model: LogisticRegressionModel | None  # None: one label alone was seen
    constant: float = 1.0

    def predict(self, rows: DataFrame, features: str = "features", out: str = "scores") -> DataFrame:
        """``rows`` with a map of label to probability."""
        if self.model is None:
            pairs = [x for k in self.labels for x in (F.lit(k), F.lit(self.constant))]
            return rows.withColumn(out, F.create_map(*pairs))
        with_vector = rows.withColumn("_v", scaled(features, self.names, self.scale))
        names = [f"_x{i}" for i in range(len(self.names))]
        wide = with_vector.select("*", *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])
        got = self.model.transform(VectorAssembler(inputCols=names, outputCol="_f").transform(wide))
        p = vector_to_array("_probability")
        pairs = [x for i, k in enumerate(self.labels) for x in (F.lit(k), p[i])]
        return got.withColumn(out, F.create_map(*pairs)).select(*rows.columns, out)

    def predict_vectors(self, rows: DataFrame, vector: str, out: str = "scores") -> DataFrame:
        """``rows`` with a map of label to probability; ``vector`` is an array that has the features in the order of the names."""
        if self.model is None:
            return self.predict(rows, vector, out)
        by = F.array(*map(F.lit, self.scale))
        got = self.model.transform(rows.withColumn("_f", array_to_vector(F.zip_with(padded(vector, len(self.names)), by, lambda x, s: x / s))))
        p = vector_to_array("_probability")
        pairs = [x for i, k in enumerate(self.labels) for x in (F.lit(k), p[i])]
        return got.withColumn(out, F.create_map(*pairs)).select(*rows.columns, out)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        head = {"version": VERSION, "names": self.names, "scale": self.scale, "labels": self.labels, "constant": self.constant, "fitted": self.model is not None}
        spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(path: str) -> RoutingModel:
        head = json.loads(SparkSession.active().read.text(f"{path}/head").first()[0])
        if head["version"] != VERSION:
            raise ValueError(f"model version {head['version']} is not {VERSION}")
        return RoutingModel(head["names"], head["scale"], head["labels"], LogisticRegressionModel.load(f"{path}/model") if head["fitted"] else None, head["constant"])


def scaled(features: str, names: list[str], scale: list[float]):
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) / F.lit(s) for n, s in zip(names, scale)])


def padded(vector: str, width: int) -> Column:
    """An array of ``width`` doubles: those of ``vector``, and 0 where it is null or ends."""
    given = F.transform(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    return F.slice(F.concat(given, F.array_repeat(F.lit(0.0), width)), 1, width)


def fit_vectors(rows: DataFrame, vector: str, label: str, penalty: float = 1.0, most_iterations: int = 200) -> RoutingModel:
    """As ``fit``, on all components of an array column; the longest array gives their number. Rows without a label teach nothing."""
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.col(vector).alias("_a"))
    counts, width = {}, 0
    for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.size("_a"), F.lit(0))).alias("width")).collect():  # labels are few
        counts[r["_label"]], width = r["n"], max(width, r["width"])
    names, labels, n = [f"x{i}" for i in range(width)], sorted(counts), sum(counts.values())
    if len(labels) < 2 or not width:
        return RoutingModel(names, [1.0] * width, labels, None, 1.0 / max(1, len(labels)))
    ready = rows.select("_label", array_to_vector(padded("_a", width)).alias("_v"))
    deviation = ready.agg(Summarizer.std(F.col("_v")).alias("std")).first()["std"].toArray() * ((n - 1) / n) ** 0.5
    scale = [float(s) if s else 1.0 for s in deviation]
    by = F.array(*map(F.lit, scale))
    at = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, float(i))])
    weight = F.create_map(*[F.lit(x) for k in labels for x in (k, n / (len(labels) * counts[k]))])
    ready = rows.select(at[F.col("_label")].alias("label"), weight[F.col("_label")].alias("weight"), array_to_vector(F.zip_with(padded("_a", width), by, lambda x, s: x / s)).alias("_f"))
    return RoutingModel(names, scale, labels, logistic(len(labels), n, penalty, most_iterations).fit(ready))


def logistic(labels: int, n: int, penalty: float, most_iterations: int) -> LogisticRegression:
    family = "binomial" if labels == 2 else "multinomial"
    return LogisticRegression(featuresCol="_f", labelCol="label", weightCol="weight", family=family, regParam=1.0 / (penalty * n), elasticNetParam=0.0, standardization=False, maxIter=most_iterations, tol=1e-8, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")


def fit(rows: DataFrame, names: list[str], label: str, features: str = "features", penalty: float = 1.0, most_iterations: int = 200) -> RoutingModel:
    """Balanced logistic regression; two labels give the binomial model, more the multinomial one.

    The mean loss with weights n / (k n_c) and L2 of 1 / (penalty n) has the optimum of the summed loss with inverse
    strength ``penalty``. The deviations and label counts come from one pass.
    """
    wide = rows.select(F.col(label).alias("_label"), *[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)).alias(f"_x{i}") for i, n in enumerate(names)])
    moments = wide.agg(*[F.stddev_pop(f"_x{i}").alias(f"_x{i}") for i in range(len(names))]).first()
    counts = {r["_label"]: r["n"] for r in wide.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).orderBy("_label").collect()}  # labels are few
    scale = [float(s) if s else 1.0 for s in moments]
    labels, n = sorted(counts), sum(counts.values())
    if len(labels) < 2:
        return RoutingModel(names, scale, labels, None)
    at = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, float(i))])
    weight = F.create_map(*[F.lit(x) for k in labels for x in (k, n / (len(labels) * counts[k]))])
    ready = wide.select(at[F.col("_label")].alias("label"), weight[F.col("_label")].alias("weight"), *[(F.col(f"_x{i}") / s).alias(f"_x{i}") for i, s in enumerate(scale)])
    ready = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(names))], outputCol="_f").transform(ready).select("label", "weight", "_f")
    return RoutingModel(names, scale, labels, logistic(len(labels), n, penalty, most_iterations).fit(ready))


def fit_binary(rows: DataFrame, names: list[str], positive: str, features: str = "features") -> RoutingModel:
    """Probability that ``positive`` holds; training data of one class gives a constant."""
    model = fit(rows.withColumn("_y", F.when(F.col(positive), "yes").otherwise("no")), names, "_y", features)
    if model.model is None:
        return RoutingModel(names, model.scale, ["no", "yes"], None, 1.0 if model.labels == ["yes"] else 0.0)
    return model


def fit_by_assignment(outcomes: DataFrame, names: list[str], assignments: list[str]) -> GroupedModels:
    """Success models of all assignments in one pass an iteration; one that is missing raises."""
    model = fit_groups(outcomes.where(F.col("assignment").isin(assignments)), names, "assignment", "success")
    if missing := sorted(set(assignments) - set(model.fitted) - set(model.constant)):
        raise ValueError(f"no outcomes for {missing}")
    return model


def importance(model: RoutingModel, k: int = 10) -> DataFrame:
    """label, feature, coefficient, rank of the largest and smallest ``k`` coefficients of each label."""
    spark = SparkSession.active()
    if model.model is None:
        return spark.createDataFrame([], "label string, feature string, coefficient double, rank int")
    m = model.model.coefficientMatrix.toArray()
    labels = model.labels if len(m) > 1 else model.labels[1:]
    rows = []
    for label, row in zip(labels, m):
        order = sorted(range(len(row)), key=lambda i: (-row[i], model.names[i]))
        for rank, i in enumerate(order[:k] + order[max(k, len(order) - k):]):
            rows.append((label, model.names[i], float(row[i]), rank + 1))
    return spark.createDataFrame(rows, "label string, feature string, coefficient double, rank int")
