"""How long will a user listen? Linear, ridge or lasso regression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from earshot.models import gram, metrics as mt
from earshot.models.base import LinearModel
from earshot.models.skip import _deviation, _mean

MODEL_TYPES = ("linear", "ridge", "lasso")


class SessionForecaster(LinearModel):
    """Regression on the features with the largest univariate F statistic."""

    def __init__(self, model_type: str = "ridge", alpha: float = 1.0, n_features: int = 20,
                 random_state: int = 42):
        super().__init__(random_state)
        if model_type not in MODEL_TYPES:
            raise ValueError(f"model_type must be one of {MODEL_TYPES}, not {model_type!r}")
        self.model_type, self.alpha, self.n_features = model_type, alpha, n_features
        self.selected_features: list[str] = []

    def _config(self) -> dict:
        return {"model_type": self.model_type, "alpha": self.alpha, "n_features": self.n_features,
                "random_state": self.random_state}

    def _extra(self) -> dict:
        return {"selected_features": self.selected_features}

    def _used_features(self) -> list[str]:
        return self.selected_features

    def _select(self, train: DataFrame, features: list[str], label: str) -> list[str]:
        scores = {r["feature"]: r["f_score"] for r in mt.f_scores(train, features, label).collect()}
        best = sorted(features, key=lambda f: -(scores[f] if scores[f] is not None
                                                and scores[f] == scores[f] else -1.0))
        chosen = set(best[:self.n_features])
        return [f for f in features if f in chosen]

    def _fit(self, train: DataFrame, features: list[str], label: str):
        common = {"featuresCol": "_features", "labelCol": label, "standardization": False}
        if self.model_type == "linear":
            fit = LinearRegression(solver="normal", **common)
        elif self.model_type == "ridge":
            # The solver divides the loss by n and measures the label in its own deviations.
            n, spread = train.agg(F.count(label), F.stddev_pop(label)).head()
            fit = LinearRegression(solver="normal", regParam=self.alpha * (spread or 1.0) / n, **common)
        else:
            fit = LinearRegression(solver="l-bfgs", regParam=self.alpha, elasticNetParam=1.0,
                                   maxIter=1000, tol=1e-9, **common)
        return Pipeline(stages=[*self._scaling(self._scales(train, features)), fit]).fit(train)

    @staticmethod
    def _ready(df: DataFrame, key, features, label) -> DataFrame:
        return df.select(*(key or []), *(F.col(f).cast("double").alias(f) for f in features if f not in (key or [])),
                         F.col(label).cast("double").alias(label))

    def train(self, df: DataFrame, features: list[str], label: str = "avg_duration",
              validation_split: float = 0.2, key: list[str] | None = None) -> dict[str, float]:
        """Fit on one part, measure on both; ``key`` identifies a row."""
        self.feature_names = list(features)
        train, held_out = self._split(self._ready(df, key, features, label), key, validation_split, None)
        self.selected_features = self._select(train, self.feature_names, label)
        self.pipeline = self._fit(train, self.selected_features, label)
        first, second = (mt.regression_metrics(self.predict(d), label).head().asDict() for d in (train, held_out))
        self.metrics = {**{f"train_{k}": first[k] for k in ("r2", "rmse", "mae")},
                        **{f"val_{k}": second[k] for k in ("r2", "rmse", "mae")},
                        "n_features_selected": len(self.selected_features)}
        return self.metrics

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with the forecast as ``prediction``."""
        return self._apply(df)

    def evaluate(self, df: DataFrame, label: str = "avg_duration") -> dict[str, float]:
        """r2, rmse, mae and mape."""
        self._check_fitted()
        return mt.regression_metrics(self.predict(df), label).head().asDict()

    def residuals(self, df: DataFrame, label: str = "avg_duration") -> DataFrame:
        """One-row summary of label minus forecast."""
        return mt.residual_summary(self.predict(df), label)

    def cross_validate(self, df: DataFrame, features: list[str], label: str = "avg_duration", cv: int = 5,
                       key: list[str] | None = None) -> dict:
        """R2 over ``cv`` hash folds with all features: mean, population deviation, scores.

        All folds are fitted and scored on moments that one pass over the rows gathers; see :mod:`earshot.models.gram`.
        """
        ready = self._ready(df, key, features, label).where(F.col(label).isNotNull())
        data = ready.withColumn("_fold", self._fold(key or ready.columns, cv))
        found = gram.held_out_r2(gram.moments_by(data, list(features), label, "_fold"), self.model_type, self.alpha)
        if len(found) < cv or None in found.values():
            raise ValueError(f"too few rows, or labels without spread, for {cv} folds")
        scores = list(found.values())
        return {"cv_r2_mean": _mean(scores), "cv_r2_std": _deviation(scores), "cv_scores": scores}
