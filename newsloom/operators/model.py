"""Gradient-boosted trees on the sentiment features: fit, predict, save, load by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.features import feature_columns, require_columns

HAS_NEWS = "has_news"


def with_missing_flag(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spark's trees take no missing values: whether there was news becomes a column, gaps are filled with zero."""
    require_columns(frame, columns)
    out = frame.withColumn(HAS_NEWS, F.col(columns[0]).isNotNull().cast("double"))
    return out.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def feature_matrix(frame: DataFrame, columns: Sequence[str] | None = None, output: str = "features") -> DataFrame:
    """Adds the vector of mean, n, std (and whether there was news)."""
    columns = list(columns or feature_columns())
    flagged = with_missing_flag(frame, columns)
    return VectorAssembler(inputCols=[*(f"_{c}" for c in columns), HAS_NEWS], outputCol=output).transform(flagged).drop(*(f"_{c}" for c in columns), HAS_NEWS)


class TreeModel:
    """One of the named models. `rounds`, `depth`, `rate`, `share` are trees, depth, learning rate, row share;
    `columns_share` is the share of the columns looked at in a split."""

    def __init__(self, kind: str, label: str, columns: Sequence[str] | None = None, rounds: int = 200, depth: int = 4, rate: float = 0.05, share: float = 0.8, columns_share: float = 1.0, seed: int = 42):
        self.columns, self.label, self.kind = list(columns or feature_columns()), label, kind
        cls = {"regressor": GBTRegressor, "classifier": GBTClassifier}[kind]
        self.estimator = cls(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, featureSubsetStrategy=str(columns_share) if columns_share < 1 else "all", seed=seed)
        self.model: PipelineModel | None = None

    def fit(self, frame: DataFrame) -> TreeModel:
        self.model = Pipeline(stages=[self.estimator]).fit(feature_matrix(frame, self.columns))
        return self

    def predict(self, frame: DataFrame, output: str = "prediction") -> DataFrame:
        if self.model is None:
            raise ValueError("the model is not fitted")
        out = self.model.transform(feature_matrix(frame, self.columns)).drop("features", "rawPrediction", "probability")
        return out.withColumnRenamed("prediction", output) if output != "prediction" else out

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("the model is not fitted")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> TreeModel:
        self.model = PipelineModel.load(path)
        return self


#: Default parameters by name.
MODELS = {
    "gbt_regressor": {"kind": "regressor", "rounds": 200, "depth": 4, "rate": 0.05, "share": 0.8, "columns_share": 0.8, "seed": 42},
    "gbt_classifier": {"kind": "classifier", "rounds": 100, "depth": 4, "rate": 0.1, "share": 1.0, "seed": 42},
}


def get_model(name: str, label: str, **params) -> TreeModel:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted(MODELS))}")
    return TreeModel(label=label, **(MODELS[name] | params))
