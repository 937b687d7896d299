"""Models of pyspark.ml, trained and applied as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def train(df: DataFrame, features: list[str], label: str, kind: str = "linear"):
    """A fitted pipeline: "linear" or "logistic"."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    makers = {"linear": LinearRegression, "logistic": LogisticRegression}
    if kind not in makers:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), makers[kind](featuresCol="_features", labelCol=label)]).fit(df)


def predict(model, df: DataFrame, to: str = "prediction") -> DataFrame:
    out = model.transform(df).select(*df.columns, "prediction")
    return out.withColumnRenamed("prediction", to)
