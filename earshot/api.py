"""Object interface: one class per area, thin over the operator functions.

Results are lazy DataFrames. Objects remember their inputs' frames, never
rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.functions.numbers import format_duration, format_number
from earshot.models import metrics as mt
from earshot.models.duration import SessionForecaster
from earshot.models.skip import SkipPredictor
from earshot.operators import (
    cohorts, engagement, features, funnels, preparation, quality, skip_features,
)
from earshot.operators import experiments as ab, sequential
from earshot.sources import readers, writers
from earshot.sources.writers import save_results
from earshot.streaming import live


class DataLoader:
    """Loading, validating and sampling tables."""

    def __init__(self, spark: SparkSession, jdbc: dict | None = None):
        self.spark, self.jdbc = spark, jdbc

    def load_csv(self, path: str, schema=None, **options) -> DataFrame:
        return readers.load_csv(self.spark, path, schema, **options)

    def load_all_csv(self, directory: str, schemas: dict | None = None) -> dict[str, DataFrame]:
        return readers.load_all_csv(self.spark, directory, schemas)

    def load_parquet(self, path: str, columns: list[str] | None = None) -> DataFrame:
        return readers.load_parquet(self.spark, path, columns)

    def load_from_db(self, query: str, params: dict | None = None) -> DataFrame:
        return readers.load_query(self.spark, query, params, self.jdbc)

    def load_table(self, name: str, **splitting) -> DataFrame:
        return readers.load_table(self.spark, name, self.jdbc, **splitting)

    @staticmethod
    def validate_data(df: DataFrame, required_columns: list[str],
                      date_columns: list[str] | None = None) -> DataFrame:
        return quality.validate(df, required_columns, date_columns)

    @staticmethod
    def sample_data(df: DataFrame, n: int | None = None, frac: float | None = None,
                    random_state: int = 42) -> DataFrame:
        return preparation.sample(df, n, frac, random_state)


class DataPreparer:
    """Missing values and splits."""

    @staticmethod
    def handle_missing_values(df: DataFrame, strategy: str = "drop", fill_value=None,
                              columns: list[str] | None = None) -> DataFrame:
        return preparation.handle_missing(df, strategy, fill_value, columns)

    @staticmethod
    def create_train_test_split(df: DataFrame, test_size: float = 0.2, random_state: int = 42,
                                stratify_column: str | None = None,
                                key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return preparation.train_test_split(df, key or df.columns, test_size, random_state, stratify_column)


class FeatureEngineer:
    """The wide per-user feature frame."""

    def __init__(self):
        self.feature_names: list[str] = []

    def create_all_features(self, sessions: DataFrame, users: DataFrame, tracks: DataFrame) -> DataFrame:
        out = features.user_features(sessions, users, tracks)
        self.feature_names = out.columns
        return out

    @staticmethod
    def get_feature_importance_groups() -> dict[str, list[str]]:
        return features.feature_groups()


def create_skip_prediction_features(sessions: DataFrame, tracks: DataFrame) -> tuple[DataFrame, list[str], str]:
    """(rows with ids, names of the feature columns, name of the label)."""
    return skip_features.skip_features(sessions, tracks), list(skip_features.SKIP_FEATURES), "skipped"


def create_session_features(sessions: DataFrame) -> tuple[DataFrame, list[str], str]:
    """(rows per user, names of the feature columns, name of the target)."""
    out = features.forecast_features(sessions)
    return out, [c for c in out.columns if c not in ("user_id", "avg_duration")], "avg_duration"


class CohortAnalyzer:
    """Retention and engagement of signup cohorts of one period length."""

    def __init__(self, period: str = "monthly"):
        self.period = period
        self.retention: DataFrame | None = None
        self.retention_matrix: DataFrame | None = None
        self.cohort_stats: DataFrame | None = None

    def calculate_retention(self, users: DataFrame, sessions: DataFrame, periods: int = 12) -> DataFrame:
        self.retention = cohorts.retention(users, sessions, self.period, periods)
        self.retention_matrix = cohorts.retention_matrix(self.retention, periods)
        self.cohort_stats = cohorts.cohort_stats(users, self.retention, self.period)
        return self.retention_matrix

    def calculate_cohort_engagement(self, users: DataFrame, sessions: DataFrame) -> DataFrame:
        return cohorts.cohort_engagement(users, sessions, self.period)

    @staticmethod
    def identify_churn_risk(users: DataFrame, sessions: DataFrame, days_inactive: int = 30) -> DataFrame:
        return cohorts.churn_risk(users, sessions, days_inactive)

    def get_retention_summary(self) -> DataFrame:
        if self.retention is None:
            raise ValueError("there is no retention matrix yet: call calculate_retention")
        return cohorts.retention_summary(self.retention, self.period)


@dataclass
class FunnelStage:
    """One stage of an evaluated funnel."""
    name: str
    users: int
    conversion_rate: float
    drop_off_rate: float


class FunnelAnalyzer:
    """Completion, activation and custom funnels; remembers the last one."""

    def __init__(self):
        self._counts: DataFrame | None = None
        self._stages: list[str] = []
        self.funnel_data: DataFrame | None = None

    def _remember(self, counts: DataFrame, stages: list[str]) -> None:
        self._counts, self._stages = counts, stages
        self.funnel_data = funnels.stage_table(counts, stages)

    @property
    def funnel_stages(self) -> list[FunnelStage]:
        """The stages, evaluated: one row each."""
        if self.funnel_data is None:
            return []
        return [FunnelStage(r["stage"], r["users"], r["conversion_rate"], r["drop_off_rate"])
                for r in self.funnel_data.orderBy("stage_no").collect()]

    def analyze_playlist_completion(self, sessions: DataFrame, playlists: DataFrame | None = None,
                                    playlist_tracks: DataFrame | None = None, playlist_length: int = 20) -> DataFrame:
        """``playlists`` names the lists that count, ``playlist_tracks`` their contents; see ``playlist_progress``."""
        if playlists is not None and "playlist_id" in sessions.columns:
            sessions = sessions.join(playlists.select("playlist_id").distinct(), "playlist_id", "left_semi")
        progress = funnels.playlist_progress(sessions, playlist_length, playlist_tracks)
        self._remember(funnels.completion_counts(progress), list(funnels.COMPLETION_STAGES))
        return funnels.completion_metrics(progress)

    def analyze_user_activation(self, users: DataFrame, sessions: DataFrame) -> DataFrame:
        self._remember(funnels.activation_counts(users, sessions), funnels.ACTIVATION_STAGES)
        return funnels.activation_rates(users, sessions)

    def analyze_events(self, events: DataFrame, stages: list[str], **columns: str) -> DataFrame:
        """A custom funnel of ordered events."""
        counts = funnels.event_counts(events, stages, **columns)
        self._remember(counts, stages)
        return self.funnel_data

    def get_recommendations(self) -> list[str]:
        if self._counts is None:
            return ["Nothing to advise yet: analyse a funnel first."]
        rows = funnels.recommendations(self._counts, self._stages).orderBy("position").collect()
        return [r["recommendation"] for r in rows]


@dataclass
class ExperimentConfig:
    name: str
    description: str = ""
    significance_level: float = ab.SIGNIFICANCE


@dataclass
class ExperimentResults:
    """The outcome of one test on one metric."""
    control_mean: float
    treatment_mean: float
    control_std: float
    treatment_std: float
    control_n: int
    treatment_n: int
    absolute_effect: float
    relative_effect: float
    p_value: float
    confidence_interval: tuple[float, float]
    is_significant: bool
    power: float
    effect_size: float


@dataclass
class ABTestFramework:
    """Design, assignment and analysis of tests by name."""

    significance_level: float = ab.SIGNIFICANCE
    experiments: dict[str, ExperimentConfig] = field(default_factory=dict)
    assignments: dict[str, DataFrame] = field(default_factory=dict)
    results: dict[str, ExperimentResults] = field(default_factory=dict)
    _rows: dict[str, DataFrame] = field(default_factory=dict)

    def calculate_sample_size(self, baseline_rate: float, mde: float, power: float = ab.POWER) -> int:
        return ab.sample_size_of(baseline_rate, mde, power, self.significance_level)

    def create_experiment(self, name: str, control_users: DataFrame, treatment_users: DataFrame,
                          description: str = "") -> None:
        self.experiments[name] = ExperimentConfig(name, description,
                                                  significance_level=self.significance_level)
        self.assignments[name] = ab.create_experiment(name, control_users, treatment_users)

    @staticmethod
    def assign_users_randomly(users: DataFrame, treatment_ratio: float = 0.5,
                              seed: int = 42) -> tuple[DataFrame, DataFrame]:
        """(control, treatment) user ids with exact sizes."""
        out = ab.assign(users, "", treatment_ratio, seed, exact=True)
        return (out.where("variant = 'control'").select("user_id"),
                out.where("variant = 'treatment'").select("user_id"))

    def analyze_results(self, experiment_name: str, metric_data: DataFrame, metric_column: str,
                        user_column: str = "user_id") -> ExperimentResults:
        """Evaluate one metric; a single row comes back to the driver."""
        long = metric_data.select(F.col(user_column).alias("user_id"), F.lit(experiment_name).alias("test_name"),
                                  F.lit(metric_column).alias("metric_name"),
                                  F.col(metric_column).cast("double").alias("metric_value"))
        analysis = ab.analyze(self.assignments[experiment_name], long, self.significance_level)
        first = analysis.head()
        if first is None:
            raise ValueError(f"no assigned user of {experiment_name!r} has a value of {metric_column!r}")
        row = first.asDict()
        spark = metric_data.sparkSession
        self._rows[experiment_name] = spark.createDataFrame([tuple(row.values())], analysis.schema)
        known = {k: v for k, v in row.items() if k in ExperimentResults.__dataclass_fields__}
        outcome = ExperimentResults(confidence_interval=(row["ci_lower"], row["ci_upper"]), **known)
        self.results[experiment_name] = outcome
        return outcome

    def monitor(self, experiment_name: str, metric_data: DataFrame, metric_column: str, scale: float,
                ts: str = "timestamp", user_column: str = "user_id", expected: float = 0.0) -> DataFrame:
        """One row per day of a running test with a verdict that is valid at every look.

        ``scale`` is the size of effect the test is meant to find, ``expected`` the mean that its plan expects.
        """
        long = metric_data.select(F.col(user_column).alias("user_id"), F.lit(experiment_name).alias("test_name"),
                                  F.lit(metric_column).alias("metric_name"), F.col(ts).alias("_ts"),
                                  F.col(metric_column).cast("double").alias("metric_value"))
        daily = live.daily_moments(long, self.assignments[experiment_name], "_ts", expected)
        return sequential.looks(daily, scale, self.significance_level)

    def generate_report(self, experiment_name: str) -> str:
        return ab.report(self._rows[experiment_name]).head()["report"]


class DashboardGenerator:
    """The dashboard extracts and their export."""

    def __init__(self, output_dir: str = "dashboards"):
        self.output_dir = output_dir

    calculate_dau_mau = staticmethod(engagement.dau_mau)
    calculate_skip_rates = staticmethod(engagement.skip_rates)
    calculate_retention_curve = staticmethod(engagement.retention_curve)

    def export_for_tableau(self, dau_mau: DataFrame, skip_rates: dict[str, DataFrame],
                           retention: DataFrame) -> None:
        writers.export_dashboard(dau_mau, skip_rates, retention, self.output_dir)


def calculate_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                      probability: str | None = None) -> dict[str, float]:
    """accuracy, precision, recall, f1 and, given probabilities, auc_roc."""
    out = mt.classification_metrics(scored, label, prediction).head().asDict()
    if probability:
        out.update(mt.auc(scored, label, probability).head().asDict())
    return out


__all__ = [
    "ABTestFramework", "CohortAnalyzer", "DashboardGenerator", "DataLoader", "DataPreparer",
    "ExperimentConfig", "ExperimentResults", "FeatureEngineer", "FunnelAnalyzer", "FunnelStage",
    "SessionForecaster", "SkipPredictor", "calculate_metrics", "create_session_features",
    "create_skip_prediction_features", "format_duration", "format_number", "save_results",
]
