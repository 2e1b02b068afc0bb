"""What the two linear models share: scaling, fitting state, storage."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from earshot.operators.preparation import hash_share, mark_split
from earshot.plans.hashpick import row_hash
from earshot.plans.stored import stored


class LinearModel:
    """A standardized linear model on named feature columns."""

    def __init__(self, random_state: int = 42):
        self.random_state = random_state
        self.pipeline: PipelineModel | None = None
        self.feature_names: list[str] = []
        self.metrics: dict[str, float] = {}

    @property
    def is_fitted(self) -> bool:
        return self.pipeline is not None

    def _check_fitted(self) -> None:
        if not self.is_fitted:
            raise ValueError("model not fitted: train it or load one")

    def _split(self, df: DataFrame, key, share: float, stratify: str | None):
        """(train, validation).

        The rows are stored before the split reads them several times, and stored again with their mark for every pass of
        the fit: no memory holds them, and no pass repeats what made them.
        """
        if not key:
            raise ValueError("training needs a key: columns that identify a row and never change between runs")
        marked = stored(mark_split(stored(df, "model-rows"), key, share, self.random_state, stratify), "split-rows")
        return marked.where(~F.col("is_test")), marked.where("is_test")

    def _fold(self, key: list[str], folds: int):
        return F.floor(hash_share(key, self.random_state) * folds).cast("int")

    def _stratified_folds(self, df: DataFrame, key: list[str], label: str, folds: int) -> DataFrame:
        """``df`` with ``_fold``: every class is dealt evenly over the folds.

        Rows are counted by class and hash cell; the running count of a class says which fold a cell belongs to. A class
        has at most 4,096 cells, so their window and the join are small whatever the rows.
        """
        celled = df.where(F.col(label).isNotNull()).withColumn("_cell", F.substring(row_hash(key, self.random_state), 1, 3))
        cells = celled.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
        of_class = Window.partitionBy(label)
        before = F.sum("_n").over(of_class.orderBy("_cell")) - F.col("_n")
        placed = cells.select(label, "_cell", F.floor(before * folds / F.sum("_n").over(of_class)).cast("int").alias("_fold"))
        return celled.join(placed, [label, "_cell"]).drop("_cell")

    @staticmethod
    def _scales(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
        """Mean and population deviation by feature; a constant column is only centred."""
        row = df.agg(*(F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f)
                       for f in features)).head()
        empty = [f for f in features if row[f]["m"] is None or row[f]["m"] != row[f]["m"]]
        if empty:
            raise ValueError(f"features without a mean, since values are missing or NaN: {empty}")
        return {f: (row[f]["m"], row[f]["s"] or 1.0) for f in features}

    @staticmethod
    def _scaling(scales: dict[str, tuple[float, float]]) -> list:
        """Stages from raw columns to a standardized vector."""
        features = list(scales)
        scaled = ", ".join(f"(`{f}` - ({m!r}D)) / {s!r}D AS `_z_{f}`" for f, (m, s) in scales.items())
        return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
                VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="_features")]

    def _apply(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        out = self.pipeline.transform(df)
        return out.drop("_features", *(c for c in out.columns if c.startswith("_z_")))

    @property
    def linear(self):
        self._check_fitted()
        return self.pipeline.stages[-1]

    def _used_features(self) -> list[str]:
        return self.feature_names

    def feature_importance(self, spark: SparkSession, top_n: int = 20) -> DataFrame:
        """Coefficients by absolute size with their rank, the ``top_n`` largest."""
        self._check_fitted()
        pairs = zip(self._used_features(), self.linear.coefficients.toArray().tolist())
        ordered = sorted(((f, c, abs(c)) for f, c in pairs), key=lambda r: -r[2])[:top_n]
        return spark.createDataFrame([(*r, i) for i, r in enumerate(ordered, start=1)],
                                     "feature string, coefficient double, abs_coefficient double, rank int")

    # --- storage ---

    def _config(self) -> dict:
        raise NotImplementedError

    def _extra(self) -> dict:
        return {}

    def save(self, path: str) -> None:
        """Write pipeline and settings under ``path``, on any Hadoop file system."""
        self._check_fitted()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        about = {"config": self._config(), "feature_names": self.feature_names, "metrics": self.metrics,
                 **self._extra()}
        spark = SparkSession.active()
        spark.range(1).select(F.lit(json.dumps(about)).alias("value")).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str):
        about = json.loads(SparkSession.active().read.text(f"{path}/about").head()[0])
        model = cls(**about["config"])
        model.pipeline = PipelineModel.load(f"{path}/pipeline")
        model.feature_names, model.metrics = about["feature_names"], about["metrics"]
        for name in model._extra():
            setattr(model, name, about[name])
        return model
