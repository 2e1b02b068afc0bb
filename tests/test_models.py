"""Fits are checked by their optimality conditions, metrics by brute force."""

import numpy as np
import pytest

from earshot import SessionForecaster, SkipPredictor, calculate_metrics
from earshot.models import metrics as mt

FEATURES = [f"feature_{i}" for i in range(1, 6)]


def frame(spark, x, y, kind="double"):
    data = [(i, *map(float, row), (int if kind == "int" else float)(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, " + ", ".join(f"{f} double" for f in FEATURES) + f", label {kind}").persist()


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1000, 5))
    y = rng.random(1000) < 1 / (1 + np.exp(-(x[:, 0] + 0.5 * x[:, 1])))
    return frame(spark, x, y, "int")


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1000, 5)) * [1, 2, 3, 4, 5] + 7
    y = 2 * x[:, 0] + 1.5 * x[:, 1] + rng.normal(size=1000) * 0.5
    return frame(spark, x, y)


@pytest.fixture(scope="module")
def predictor(classes):
    model = SkipPredictor()
    model.train(classes, FEATURES, "label", key=["id"])
    return model


def arrays(df):
    pdf = df.orderBy("id").toPandas()
    return pdf[FEATURES].to_numpy(), pdf["label"].to_numpy(float)


def test_skip_metrics(predictor):
    assert predictor.is_fitted and predictor.metrics["val_auc"] > 0.5
    assert set(predictor.metrics) == {"train_accuracy", "train_auc", "val_accuracy", "val_auc", "val_precision", "val_recall", "val_f1"}


def test_logistic_fit_is_the_optimum(classes):
    model = SkipPredictor(C=0.1)
    model.pipeline = model._fit(classes, FEATURES, "label")
    x, y = arrays(classes)
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, bias = model.linear.coefficients.toArray(), model.linear.intercept
    slope = w * (1 / (1 + np.exp(-(z @ beta + bias))) - y)
    assert np.abs(0.1 * (z.T @ slope) + beta).max() < 1e-3 and abs(slope.sum()) < 1e-2


def test_predictions(predictor, classes):
    out = predictor.predict(classes).toPandas()
    assert len(out) == 1000 and set(out["prediction"]) <= {0, 1} and out["probability"].between(0, 1).all()
    assert ((out["probability"] > 0.5) == (out["prediction"] == 1)).all()


def test_skip_evaluation(predictor, classes):
    got, out = predictor.evaluate(classes, "label"), predictor.predict(classes).toPandas()
    assert got["accuracy"] == pytest.approx((out.prediction == out.label).mean())
    pos, neg = out.probability[out.label == 1].to_numpy(), out.probability[out.label == 0].to_numpy()
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert got["auc_roc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert {"precision", "recall", "f1"} <= set(got)
    assert [r["class"] for r in predictor.report(classes, "label").collect()] == [0, 1]


def test_roc_curve_ends_and_area(predictor, classes):
    points = predictor.roc_curve(classes, "label").toPandas().sort_values(["fpr", "tpr"])
    assert tuple(points.iloc[0][["fpr", "tpr"]]) == (0, 0) and tuple(points.iloc[-1][["fpr", "tpr"]]) == (1, 1)
    assert np.trapezoid(points["tpr"], points["fpr"]) == pytest.approx(predictor.evaluate(classes, "label")["auc_roc"])
    full = mt.roc_curve(predictor.predict(classes), "label", drop_intermediate=False)
    assert full.count() > len(points)


def test_importance(predictor, spark):
    rows = predictor.feature_importance(spark, 5).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and rows[0]["feature"] == "feature_1"


def test_skip_cross_validation(classes):
    got = SkipPredictor().cross_validate(classes, FEATURES, "label", cv=3, key=["id"])
    assert len(got["cv_scores"]) == 3 and got["cv_auc_mean"] == pytest.approx(np.mean(got["cv_scores"]))
    assert got["cv_auc_std"] == pytest.approx(np.std(got["cv_scores"]))


def test_save_and_load(predictor, classes, numbers, tmp_path):
    predictor.save(str(tmp_path / "skip"))
    loaded = SkipPredictor.load(str(tmp_path / "skip"))
    assert loaded.is_fitted and loaded.metrics == predictor.metrics
    a, b = (m.predict(classes).orderBy("id").toPandas() for m in (predictor, loaded))
    assert (a["prediction"] == b["prediction"]).all()
    forecaster = SessionForecaster(n_features=3)
    forecaster.train(numbers, FEATURES, "label", key=["id"])
    forecaster.save(str(tmp_path / "duration"))
    again = SessionForecaster.load(str(tmp_path / "duration"))
    assert again.selected_features == forecaster.selected_features
    a, b = (m.predict(numbers).orderBy("id").toPandas() for m in (forecaster, again))
    np.testing.assert_allclose(a["prediction"], b["prediction"])


def test_not_fitted(classes):
    for model in (SkipPredictor(), SessionForecaster()):
        with pytest.raises(ValueError, match="not fitted"):
            model.predict(classes)
        with pytest.raises(ValueError, match="not fitted"):
            model.save("/nowhere")


def test_unknown_type():
    with pytest.raises(ValueError, match="model_type"):
        SessionForecaster("forest")


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_regression_is_the_optimum(numbers, kind):
    model = SessionForecaster(kind, alpha=0.3)
    model.pipeline = model._fit(numbers, FEATURES, "label")
    x, y = arrays(numbers)
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    beta = model.linear.coefficients.toArray()
    assert model.linear.intercept == pytest.approx(y.mean())
    pull = z.T @ (t - z @ beta)
    if kind == "linear":
        assert np.abs(pull).max() < 1e-6
    elif kind == "ridge":
        np.testing.assert_allclose(beta, np.linalg.solve(z.T @ z + 0.3 * np.eye(5), z.T @ t), rtol=1e-6)
    else:
        used = beta != 0
        np.testing.assert_allclose(pull[used] / len(y), 0.3 * np.sign(beta[used]), atol=1e-4)
        assert (np.abs(pull[~used]) / len(y) <= 0.3 + 1e-4).all()


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_forecast_metrics(numbers, kind):
    metrics = SessionForecaster(kind, alpha=0.1, n_features=5).train(numbers, FEATURES, "label", key=["id"])
    assert metrics["val_r2"] > 0 and metrics["n_features_selected"] == 5


def test_selection_and_evaluation(numbers):
    model = SessionForecaster(n_features=2)
    model.train(numbers, FEATURES, "label", key=["id"])
    assert model.selected_features == ["feature_1", "feature_2"]
    out, got = model.predict(numbers).toPandas(), model.evaluate(numbers, "label")
    error = out["label"] - out["prediction"]
    assert got["r2"] == pytest.approx(1 - (error ** 2).sum() / ((out["label"] - out["label"].mean()) ** 2).sum())
    assert got["mape"] == pytest.approx((error / out["label"]).abs().mean() * 100)
    rest = model.residuals(numbers, "label").head()
    assert rest["skewness"] == pytest.approx(error.skew()) and rest["kurtosis"] == pytest.approx(error.kurtosis())
    assert len(SessionForecaster().cross_validate(numbers, FEATURES, "label", 3, ["id"])["cv_scores"]) == 3


def test_metrics_without_positives(rows):
    df = rows([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, probability double")
    assert calculate_metrics(df) == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert calculate_metrics(df, probability="probability")["auc_roc"] is None
