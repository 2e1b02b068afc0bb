"""Will a play be skipped? Logistic regression on standardized features."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from earshot.models import logistic, metrics as mt
from earshot.models.base import LinearModel
from earshot.plans.stored import stored


class SkipPredictor(LinearModel):
    """L2-penalized logistic regression, classes weighted equally by default."""

    def __init__(self, C: float = 1.0, max_iter: int = 1000, class_weight: str | None = "balanced",
                 random_state: int = 42):
        super().__init__(random_state)
        self.C, self.max_iter, self.class_weight = C, max_iter, class_weight

    def _config(self) -> dict:
        return {"C": self.C, "max_iter": self.max_iter, "class_weight": self.class_weight,
                "random_state": self.random_state}

    def _weights(self, sizes: dict[int, int]) -> dict[int, float]:
        total = sum(sizes.values())
        return {k: total / (len(sizes) * n) if self.class_weight == "balanced" else 1.0 for k, n in sizes.items()}

    def _part(self, sizes: dict[int, int], scales: dict[str, tuple[float, float]], left_out: int | None = None) -> logistic.Part:
        # The penalty is per unit of weight: 1 / (C * sum of weights), and the weights sum to n.
        total, weights = sum(sizes.values()), self._weights(sizes)
        return logistic.Part(left_out, np.array([m for m, _ in scales.values()]), np.array([s for _, s in scales.values()]),
                             (weights[0], weights[1]), 1.0 / (self.C * total), total)

    def _pipeline(self, scales: dict[str, tuple[float, float]], point: np.ndarray) -> PipelineModel:
        fitted = (logistic.as_model(point).setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw"))
        return PipelineModel([*self._scaling(scales), fitted])

    def _fit(self, train: DataFrame, features: list[str], label: str):
        """``train`` is read once a step of the solver, so it should be stored or persisted."""
        sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
        scales = self._scales(train, features)
        if set(sizes) == {0, 1}:
            return self._pipeline(scales, *logistic.fit(train, features, label, [self._part(sizes, scales)], self.max_iter))
        # One class has no optimum, and other labels are an error: Spark's solver says what comes of them.
        weights = self._weights(sizes)
        weight = F.when(F.col(label) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
        fit = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight",
                                 maxIter=self.max_iter, regParam=1.0 / (self.C * sum(sizes.values())), tol=1e-8,
                                 standardization=False, probabilityCol="_probability",
                                 rawPredictionCol="_raw")
        return Pipeline(stages=[*self._scaling(scales), fit]).fit(train.withColumn("_weight", weight))

    def train(self, df: DataFrame, features: list[str], label: str = "skipped",
              validation_split: float = 0.2, key: list[str] | None = None) -> dict[str, float]:
        """Fit on a stratified part, measure on both; ``key`` identifies a row."""
        self.feature_names = list(features)
        train, held_out = self._split(
            df.select(*dict.fromkeys([*(key or []), *features, label])), key, validation_split, label)
        self.pipeline = self._fit(train, self.feature_names, label)
        first, second = self._measure(train, label), self._measure(held_out, label)
        self.metrics = {"train_accuracy": first["accuracy"], "train_auc": first["auc_roc"],
                        **{f"val_{n}": second[k] for n, k in
                           (("accuracy", "accuracy"), ("auc", "auc_roc"), ("precision", "precision"),
                            ("recall", "recall"), ("f1", "f1"))}}
        return self.metrics

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction`` (0/1) and ``probability`` of a skip."""
        return (self._apply(df).withColumn("probability", vector_to_array("_probability")[1])
                .withColumn("prediction", F.col("prediction").cast("int")).drop("_probability", "_raw"))

    def _measure(self, df: DataFrame, label: str) -> dict[str, float]:
        scored = self.predict(df).select(F.col(label).cast("int").alias("label"), "prediction", "probability")
        return {**mt.classification_metrics(scored).head().asDict(), **mt.auc(scored).head().asDict()}

    def evaluate(self, df: DataFrame, label: str = "skipped") -> dict[str, float]:
        """accuracy, auc_roc, precision, recall and f1."""
        self._check_fitted()
        return self._measure(df, label)

    def report(self, df: DataFrame, label: str = "skipped") -> DataFrame:
        return mt.classification_report(self.predict(df), label)

    def roc_curve(self, df: DataFrame, label: str = "skipped") -> DataFrame:
        return mt.roc_curve(self.predict(df), label)

    def _fit_folds(self, data: DataFrame, features: list[str], label: str, cv: int) -> list[PipelineModel]:
        """For each fold the model of all others; every step of the solver reads the rows once for all models."""
        found = data.groupBy("_fold", label).agg(F.count(F.lit(1)).alias("n"), *(
            F.struct(F.avg(f).alias("m"), F.var_pop(f).alias("v"), F.count_if(F.col(f).isNotNull()).alias("n")).alias(f) for f in features)).collect()
        if {r[label] for r in found} != {0, 1} or any(r[f]["n"] < r["n"] for r in found for f in features):
            return [self._fit(data.where(F.col("_fold") != k), features, label) for k in range(cv)]
        parts, scalings = [], []
        for k in range(cv):
            others = [r for r in found if r["_fold"] != k]
            sizes = {c: sum(r["n"] for r in others if r[label] == c) for c in (0, 1)}
            if not all(sizes.values()):
                return [self._fit(data.where(F.col("_fold") != k), features, label) for k in range(cv)]
            n = np.array([r["n"] for r in others], float)
            scales = {}
            for f in features:
                means = np.array([r[f]["m"] for r in others])
                middle = float(n @ means / n.sum())
                spread = float(n @ (np.array([r[f]["v"] for r in others]) + (means - middle) ** 2) / n.sum())
                scales[f] = (middle, spread ** 0.5 or 1.0)
            parts.append(self._part(sizes, scales, k))
            scalings.append(scales)
        return [self._pipeline(s, b) for s, b in zip(scalings, logistic.fit(data, features, label, parts, self.max_iter, "_fold"))]

    def cross_validate(self, df: DataFrame, features: list[str], label: str = "skipped", cv: int = 5,
                       key: list[str] | None = None) -> dict:
        """AUC over ``cv`` hash folds with even shares of both classes: mean, population deviation, scores."""
        names = list(dict.fromkeys([*(key or []), *features, label]))
        rows = stored(df.select(*names), "model-rows")
        data = stored(self._stratified_folds(rows, key or names, label, cv), "folded-rows")
        scores = []
        for k, pipeline in enumerate(self._fit_folds(data, list(features), label, cv)):
            part = type(self)(**self._config())
            part.feature_names, part.pipeline = list(features), pipeline
            scored = part.predict(data.where(F.col("_fold") == k)).select(
                F.col(label).cast("int").alias("label"), "probability")
            scores.append(mt.auc(scored).head()[0])
        return {"cv_auc_mean": _mean(scores), "cv_auc_std": _deviation(scores), "cv_scores": scores}


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _deviation(values: list[float]) -> float:
    middle = _mean(values)
    return (sum((v - middle) ** 2 for v in values) / len(values)) ** 0.5
