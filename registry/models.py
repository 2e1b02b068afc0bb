"""Models and their metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from earshot.models import metrics as mt
from earshot.models.duration import SessionForecaster
from earshot.models.skip import SkipPredictor
from earshot.operators import features as fe, skip_features as sk
from earshot.operators.preparation import mark_split
from earshot.plans.stored import stored
from registry.base import SKIPD, query

# A fixed score, so that metrics can be checked apart from any fit: the skip rate of
# the play's track among its earlier plays, in steps, the time of day breaking few ties.
SCORED = f"""p as (select s.session_id, cast(skipped as int) as label,
 round(avg({SKIPD}) over (partition by track_id), 2) as score from sessions s),
scored as (select *, case when score >= 0.34 then 1 else 0 end as prediction from p)"""


def _scored(m):
    rate = m.sessions.groupBy("track_id").agg(F.round(F.avg(F.col("skipped").cast("double")), 2).alias("score"))
    return (m.sessions.join(rate, "track_id")
            .select(F.col("skipped").cast("int").alias("label"), "score",
                    F.when(F.col("score") >= 0.34, 1).otherwise(0).alias("prediction")))


@query("classification_metrics", "accuracy:d, precision:d, recall:d, f1:d", ctes=SCORED, sql="""
select (tp + tn) * 1e0 / n as accuracy, tp * 1e0 / (tp + fp) as precision, tp * 1e0 / (tp + fn) as recall, 2e0 * tp / (2 * tp + fp + fn) as f1
from (select count(*) as n, count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 1) as fp,
 count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 0 and prediction = 0) as tn from scored) x""")
def classification_metrics(m):
    return mt.classification_metrics(_scored(m))


@query("classification_report", "class:i, precision:d, recall:d, f1:d, support:i", ctes=SCORED, sql="""
select k as class, tp * 1e0 / (tp + fp) as precision, tp * 1e0 / (tp + fn) as recall, 2e0 * tp / (2 * tp + fp + fn) as f1, tp + fn as support
from (select k, count(*) filter (label = k and prediction = k) as tp, count(*) filter (label <> k and prediction = k) as fp,
 count(*) filter (label = k and prediction <> k) as fn from scored, (select unnest([0, 1]) as k) c group by k) x""")
def classification_report(m):
    return mt.classification_report(_scored(m))


_BY_SCORE = SCORED + """, g as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1)"""


@query("auc_exact", "auc_roc:d", ctes=_BY_SCORE, sql="""
select sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)) as auc_roc
from (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from g) x""")
def auc_exact(m):
    return mt.auc(_scored(m), score="score")


@query("roc_curve", "fpr:d, tpr:d, threshold:d", ctes=_BY_SCORE, sql="""
select 0e0 as fpr, 0e0 as tpr, null as threshold
union all select f * 1e0 / tf, t * 1e0 / tt, score from (
 select score, sum(neg) over w as f, sum(pos) over w as t, sum(neg) over () as tf, sum(pos) over () as tt, pos, neg,
  lead(pos) over (order by score desc) as np, lead(neg) over (order by score desc) as nn
 from g window w as (order by score desc rows unbounded preceding)) x where np is null or np <> pos or nn <> neg""")
def roc_curve(m):
    """The infinite first threshold is shown as null."""
    curve = mt.roc_curve(_scored(m), score="score")
    return curve.withColumn("threshold", F.when(F.col("threshold") != float("inf"), F.col("threshold")))


FORECAST = ["std_duration", "min_duration", "max_duration", "session_count", "skip_rate", "avg_hour", "weekend_ratio"]
_USERS = f"""u as (select user_id, avg(listen_duration_ms) as y, stddev_samp(listen_duration_ms) as std_duration,
 min(listen_duration_ms) as min_duration, max(listen_duration_ms) as max_duration, count(*) as session_count,
 avg({SKIPD}) as skip_rate, avg(extract(hour from timestamp)) as avg_hour,
 avg(case when extract(isodow from timestamp) >= 6 then 1e0 else 0e0 end) as weekend_ratio from sessions group by 1)"""


@query("feature_f_scores", "feature, correlation:d, f_score:d", ctes=_USERS,
       sql="select feature, r as correlation, r * r * (n - 2) / (1 - r * r) as f_score from (" + " union all ".join(
           f"select '{f}' as feature, corr({f}, y) as r, count(y) as n from u" for f in FORECAST) + ") x")
def feature_f_scores(m):
    return mt.f_scores(fe.forecast_features(m.sessions), FORECAST, "avg_duration")


_SIMPLE = _USERS + """, f as (select y, regr_intercept(y, std_duration) over () + regr_slope(y, std_duration) over () * std_duration as prediction
 from u where std_duration is not null)"""


def _line(m):
    """Least squares on one feature, which SQL has too."""
    data = fe.forecast_features(m.sessions).where("std_duration is not null")
    model = SessionForecaster("linear")
    ready = stored(model._ready(data, ["user_id"], ["std_duration"], "avg_duration"), "forecast-rows")  # read by each pass of the fit
    model.feature_names = model.selected_features = ["std_duration"]
    model.pipeline = model._fit(ready, model.feature_names, "avg_duration")
    return model.predict(ready)


@query("regression_metrics", "r2:d, rmse:d, mae:d, mape:d", ctes=_SIMPLE, sql="""
select 1 - sum(pow(y - prediction, 2)) / (var_pop(y) * count(*)) as r2, sqrt(avg(pow(y - prediction, 2))) as rmse,
 avg(abs(y - prediction)) as mae, avg(abs((y - prediction) / y)) * 100 as mape from f""")
def regression_metrics(m):
    return mt.regression_metrics(_line(m), "avg_duration")


@query("residual_summary", "std:d, min:d, max:d, skewness:d, kurtosis:d", ctes=_SIMPLE, sql="""
select stddev_samp(y - prediction) as std, min(y - prediction) as min, max(y - prediction) as max,
 skewness(y - prediction) as skewness, kurtosis(y - prediction) as kurtosis from f""")
def residual_summary(m):
    return mt.residual_summary(_line(m), "avg_duration").drop("mean")  # zero up to rounding


_PENALIZED = _USERS + """, z as (select user_id, y, (skip_rate - avg(skip_rate) over ()) / stddev_pop(skip_rate) over () as z from u),
c as (select avg(y) as middle, covar_pop(z, y) as pull, count(*) as n from z)"""


def _penalized(m, kind, alpha):
    data = fe.forecast_features(m.sessions)
    model = SessionForecaster(kind, alpha=alpha)
    ready = stored(model._ready(data, ["user_id"], ["skip_rate"], "avg_duration"), "forecast-rows")
    model.feature_names = model.selected_features = ["skip_rate"]
    model.pipeline = model._fit(ready, model.feature_names, "avg_duration")
    return model.predict(ready).select("user_id", F.round("prediction", 2).alias("prediction"))


@query("ridge_forecasts", "user_id:i, prediction:d", ctes=_PENALIZED, sql="""
select user_id, round(middle + z * pull * n / (n + 200), 2) as prediction from z, c""")
def ridge_forecasts(m):
    """One feature, where the penalized optimum has a closed form."""
    return _penalized(m, "ridge", 200.0)


@query("lasso_forecasts", "user_id:i, prediction:d", ctes=_PENALIZED, sql="""
select user_id, round(middle + z * sign(pull) * greatest(abs(pull) - 20, 0), 2) as prediction from z, c""")
def lasso_forecasts(m):
    return _penalized(m, "lasso", 20.0)


PLAY_KEY = ["session_id", "user_id", "track_id"]


_models: dict[tuple[str, str], SkipPredictor] = {}


def _trained_skip_model(m, names):
    """The model, fitted once per session and data, and the rows of features it was made from, stored."""
    data = stored(sk.skip_features(m.stored_sessions, m.tracks).select(*PLAY_KEY, *names, "skipped"), "skip-rows")
    place = (m.spark.sparkContext.applicationId, m.directory)
    if place not in _models:
        model = SkipPredictor()
        model.train(data, names, key=PLAY_KEY)
        _models[place] = model
    return _models[place], data


def _fitted_rows(data):
    """The rows that the model was fitted on, split off again by the same hash, and stored for several readings."""
    return stored(mark_split(data, PLAY_KEY, 0.2, 42, "skipped").where(~F.col("is_test")), "fitted-rows")


@query("skip_model_training", "feature, stationary:b", sql=" union all ".join(
    f"select '{f}' as feature, true as stationary" for f in sk.SKIP_FEATURES))
def skip_model_training(m):
    """Whether the fit on all features is an optimum: the slope of the penalized loss along each coefficient.

    No other coefficients pass, those of an unfitted model least of all.
    """
    model, data = _trained_skip_model(m, list(sk.SKIP_FEATURES))
    train = _fitted_rows(data)
    sizes = {r["skipped"]: r["count"] for r in train.groupBy("skipped").count().collect()}
    total = sum(sizes.values())
    y = F.col("skipped").cast("double")
    weight = F.when(F.col("skipped") == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
    scored = model.pipeline.transform(train)
    miss = weight * (vector_to_array("_probability")[1] - y)
    slopes = scored.agg(*(F.avg(miss * F.col(f"_z_{f}")).alias(f) for f in sk.SKIP_FEATURES)).head()
    return m.spark.createDataFrame(
        [(f, abs(slopes[f] + c / (model.C * total)) < 1e-4) for f, c in zip(sk.SKIP_FEATURES, model.linear.coefficients.toArray().tolist())],
        "feature string, stationary boolean")


@query("skip_model_importance", "rank:i, feature_known:b, falling:b, of_the_model:b, weighs:b", sql=f"""
select rank, true as feature_known, true as falling, true as of_the_model, rank > 1 or true as weighs
from (select unnest(range(1, {len(sk.SKIP_FEATURES) + 1})) as rank) r""")
def skip_model_importance(m):
    """All features ranked from 1 on by falling absolute coefficient, held against the fitted coefficients one by one."""
    model, _ = _trained_skip_model(m, list(sk.SKIP_FEATURES))
    fitted = m.spark.createDataFrame(list(zip(sk.SKIP_FEATURES, model.linear.coefficients.toArray().tolist())), "feature string, fitted double")
    ranked = model.feature_importance(m.spark, len(sk.SKIP_FEATURES)).join(fitted, "feature", "left")
    before = F.lag("abs_coefficient").over(Window.orderBy("rank"))  # one row per feature
    return ranked.select(
        "rank", F.col("fitted").isNotNull().alias("feature_known"), F.coalesce(before >= F.col("abs_coefficient"), F.lit(True)).alias("falling"),
        ((F.col("coefficient") == F.col("fitted")) & (F.col("abs_coefficient") == F.abs("fitted"))).alias("of_the_model"),
        ((F.col("rank") > 1) | (F.col("abs_coefficient") > 0.01)).alias("weighs"))


@query("skip_model_predictions", "session_id:i, user_id:i, track_id:i, plays:i, sound:b", sql="""
select session_id, user_id, track_id, count(*) as plays, true as sound from sessions group by 1, 2, 3""")
def skip_model_predictions(m):
    """Every play's probability against the sigmoid of the stored coefficients, and its class on its side of one half."""
    names = list(sk.SKIP_FEATURES)
    model, data = _trained_skip_model(m, names)
    middle = _fitted_rows(data).agg(*(F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in names)).head()
    weights = dict(zip(names, model.linear.coefficients.toArray().tolist()))
    logit = F.lit(model.linear.intercept)
    for f in names:
        logit = logit + (F.col(f) - middle[f]["m"]) / (middle[f]["s"] or 1.0) * weights[f]
    expected = 1 / (1 + F.exp(-logit))
    sound = (F.abs(F.col("probability") - expected) < 1e-9) & ((F.col("probability") > 0.5) == (F.col("prediction") == 1))
    scored = model.predict(data)
    return scored.groupBy(*PLAY_KEY).agg(F.count("*").alias("plays"), F.min(sound).alias("sound"))


@query("skip_model_cross_validation", "fold:i, above_chance:b, below_one:b", sql="""
select fold, true as above_chance, true as below_one from (select unnest(range(4)) as fold) f""")
def skip_model_cross_validation(m):
    """AUC over four folds with even classes, on all features; their mean and deviation must be those of the scores."""
    data = sk.skip_features(m.stored_sessions, m.tracks)
    out = SkipPredictor().cross_validate(data, list(sk.SKIP_FEATURES), "skipped", cv=4, key=PLAY_KEY)
    scores = out["cv_scores"]
    mean = sum(scores) / len(scores)
    agree = abs(mean - out["cv_auc_mean"]) < 1e-12 and abs(sum((s - mean) ** 2 for s in scores) / len(scores) - out["cv_auc_std"] ** 2) < 1e-12
    return m.spark.createDataFrame([(i, agree and s > 0.5, s < 1) for i, s in enumerate(scores)], "fold int, above_chance boolean, below_one boolean")


@query("skip_model_folds", "fold:i, label:i, plays:i", ctes="""
h as (select cast(skipped as int) as label, substr(md5(concat('42:', length(cast(session_id as varchar)), ':', session_id, ':',
  length(cast(user_id as varchar)), ':', user_id, ':', length(cast(track_id as varchar)), ':', track_id)), 1, 3) as cell from sessions),
c as (select label, cell, count(*) as n from h group by 1, 2),
f as (select label, n, floor((sum(n) over (partition by label order by cell) - n) * 4e0 / sum(n) over (partition by label)) as fold from c)""",
       sql="select fold, label, sum(n) as plays from f group by 1, 2")
def skip_model_folds(m):
    """Plays by fold and class of the cross validation."""
    data = m.sessions.select(*PLAY_KEY, F.col("skipped").cast("int").alias("label"))
    return SkipPredictor()._stratified_folds(data, PLAY_KEY, "label", 4).groupBy(F.col("_fold").alias("fold"), "label").agg(
        F.count("*").alias("plays"))


# Ridge in SQL: the normal equations of all scaled features, solved by elimination. One system for each value of ``part``,
# over the rows for which ``of`` holds; only the ``n_best`` features by absolute correlation get a weight.
def _ridge_sql(parts: str, of: str, n_best: int, alpha: float = 1.0) -> str:
    p = len(FORECAST)
    moments = ", ".join(
        [f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}, abs(corr({f}, y)) as c_{f}" for f in FORECAST]
        + [f"covar_pop({a}, {b}) as v_{i}_{j}" for i, a in enumerate(FORECAST) for j, b in enumerate([*FORECAST, "y"]) if j >= i])

    def cell(i: int, j: int) -> str:
        """Row i, column j of the system; unused features have a row of their own and no weight."""
        used = f"list_contains(best, {i})" + (f" and list_contains(best, {j})" if j < p else "")
        value = f"n * v_{min(i, j)}_{max(i, j)} / (s_{FORECAST[i]}" + (f" * s_{FORECAST[j]})" if j < p else ")")
        return f"case when {used} then {value} else 0 end" + (f" + {alpha}" if i == j else "")
    rows = ", ".join("[" + ", ".join(cell(i, j) for j in range(p + 1)) + "]" for i in range(p))
    order = ", ".join(f"struct_pack(c := -coalesce(c_{f}, -1), i := {i})" for i, f in enumerate(FORECAST))
    spots = range(1, p + 1)
    steps = ", ".join(
        f"s{k} as (select part, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: case when i = {k} then a[i][j] "
        f"else a[i][j] - a[i][{k}] / a[{k}][{k}] * a[{k}][j] end)) as a from s{k - 1})" for k in spots)
    weights = ", ".join(f"a[{i}][{p + 1}] / a[{i}][{i}] as w{i}" for i in spots)
    forecast = " + ".join(f"w{i} * ({f} - m_{f}) / s_{f}" for i, f in zip(spots, FORECAST))
    return f"""
t as (select part, count(*) * 1e0 as n, avg(y) as my, {moments} from h, (select unnest({parts}) as part) q where {of} group by part),
b as (select *, list_transform(list_slice(list_sort([{order}]), 1, {n_best}), lambda x: x.i) as best from t),
s0 as (select part, [{rows}] as a from b),
{steps},
w as (select part, {weights} from s{p}),
f as (select h.*, t.part, my + {forecast} as p from h, t join w using (part))"""


_SEVEN = f"""{_USERS}, u7 as (select user_id, y, {', '.join(f'coalesce({f}, 0) * 1e0 as {f}' for f in FORECAST)} from u)"""
_TRAINED = _SEVEN + """,
h as (select *, row_number() over (order by md5(concat('42:', cast(user_id as varchar)))) <= ceil(count(*) over () * 0.2e0) as is_test from u7),
""" + _ridge_sql("[0]", "not is_test", 5)
_FOLDED = _SEVEN + """,
h as (select *, cast(strpos('0123456789abcdef', substr(md5(concat('42:', cast(user_id as varchar))), 1, 1)) - 1 as int) // 4 as fold from u7),
""" + _ridge_sql("range(4)", "fold <> part", len(FORECAST))


def _ridge(m):
    data = fe.forecast_features(m.sessions).fillna(0.0)
    model = SessionForecaster(n_features=5)
    return model, model.train(data, FORECAST, key=["user_id"]), model._ready(data, ["user_id"], FORECAST, "avg_duration")


@query("duration_model_training", "part, r2:d, rmse:d, mae:d", ctes=_TRAINED, sql="""
select case when is_test then 'val' else 'train' end as part, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 5) as r2,
 round(sqrt(avg(pow(y - p, 2))), 2) as rmse, round(avg(abs(y - p)), 2) as mae from f group by is_test""")
def duration_model_training(m):
    """Train and validation metrics of the ridge model on all users: the five best of seven features."""
    _, found, _ = _ridge(m)
    rows = [(part, round(found[f"{part}_r2"], 5), round(found[f"{part}_rmse"], 2), round(found[f"{part}_mae"], 2)) for part in ("train", "val")]
    return m.spark.createDataFrame(rows, "part string, r2 double, rmse double, mae double")


@query("duration_model_forecasts", "user_id:i, prediction:d", ctes=_TRAINED, sql="select user_id, round(p, 2) as prediction from f")
def duration_model_forecasts(m):
    model, _, data = _ridge(m)
    return model.predict(data).select("user_id", F.round("prediction", 2).alias("prediction"))


@query("duration_model_cross_validation", "fold:i, r2:d", ctes=_FOLDED, sql="""
select fold, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) as r2 from f where fold = part group by fold""")
def duration_model_cross_validation(m):
    """Ridge on all seven features, each quarter of the hashes held out in turn, from one pass over the users."""
    data = fe.forecast_features(m.sessions).fillna(0.0)
    out = SessionForecaster("ridge").cross_validate(data, FORECAST, cv=4, key=["user_id"])
    return m.spark.createDataFrame([(i, round(s, 6)) for i, s in enumerate(out["cv_scores"])], "fold int, r2 double")


@query("duration_model_cross_validation_linear", "fold:i, r2:d", ctes=_USERS + """,
h as (select y, coalesce(skip_rate, 0) as x, cast(strpos('0123456789abcdef', substr(md5(concat('42:', cast(user_id as varchar))), 1, 1)) - 1 as int) // 4 as fold from u),
l as (select k, regr_slope(y, x) as b, regr_intercept(y, x) as a from h, (select unnest(range(4)) as k) g where fold <> k group by k)""", sql="""
select fold, round(1 - sum(pow(y - a - b * x, 2)) / (var_pop(y) * count(*)), 5) as r2 from h join l on fold = k group by fold""")
def duration_model_cross_validation_linear(m):
    """A line on one feature, each quarter of the hashes held out in turn."""
    data = fe.forecast_features(m.sessions).fillna(0.0)
    out = SessionForecaster("linear").cross_validate(data, ["skip_rate"], cv=4, key=["user_id"])
    return m.spark.createDataFrame([(i, round(s, 5)) for i, s in enumerate(out["cv_scores"])], "fold int, r2 double")
