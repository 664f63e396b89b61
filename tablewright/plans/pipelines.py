"""A whole preparation and model in one ``pyspark.ml`` pipeline."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ApplyToCols, DatetimeEncoder, Ordinal, SquashingScaler, StringEncoder, TableVectorizer
from tablewright.operators.columns import with_shared
from tablewright.types import is_numeric, quoted

TREES = ("GBT", "RandomForest", "DecisionTree")


class TabularPipeline:
    """Vectorise a table as suits the estimator, impute, scale, assemble, fit.

    Trees get ordinal categories and raw numbers; other estimators one-hot
    categories, spline times, medians for missing values with indicators, and
    squashed numbers.
    """

    def __init__(self, estimator, label: str):
        self.estimator, self.label = estimator, label
        self.trees = type(estimator).__name__.startswith(TREES)

    def fit(self, df: DataFrame) -> TabularPipeline:
        features = df.drop(self.label)
        low = Ordinal() if self.trees else None
        times = DatetimeEncoder() if self.trees else DatetimeEncoder(periodic_encoding="spline")
        self.vectorizer_ = TableVectorizer(low_cardinality=low, datetime=times, high_cardinality=StringEncoder(10), specific={})
        table = self.vectorizer_.fit_transform(features)
        self.names_ = [f.name for f in table.schema if is_numeric(f)]
        self.inner_ = [f"x{j}" for j in range(len(self.names_))]
        numbers = self._numbers(features)
        self.imputer_ = Imputer(inputCols=self.inner_, outputCols=self.inner_, strategy="median").fit(numbers)
        filled = self.imputer_.transform(numbers)
        self.scaler_ = None if self.trees else ApplyToCols(SquashingScaler(5.0), self.inner_).fit(filled.select(self.inner_))
        self.model_ = self.estimator.copy({self.estimator.featuresCol: "features", self.estimator.labelCol: self.label}).fit(self._assembled(df))
        return self

    def _numbers(self, features: DataFrame) -> DataFrame:
        table = self.vectorizer_.transform(features)
        return table.select(*[quoted(c).cast("double").alias(i) for c, i in zip(self.names_, self.inner_, strict=True)])

    def _assembled(self, df: DataFrame) -> DataFrame:
        """Features beside the label: carried through the vectoriser as one more column."""
        features = df.drop(self.label)
        cleaned = features
        for step in self.vectorizer_.cleaner_.fitted_:
            cleaned = self.vectorizer_._on_others(step, cleaned)
        keep = self.label in df.columns
        whole = df if keep else features
        for step in self.vectorizer_.cleaner_.fitted_:
            whole = self.vectorizer_._on_others(step, whole)
        columns = [e for f in cleaned.schema for e in self.vectorizer_.models_[f.name].exprs(f)]
        whole = with_shared(whole, {f.name: self.vectorizer_.models_[f.name] for f in cleaned.schema})
        wide = whole.select(*columns, *([quoted(self.label)] if keep else []))
        numbers = wide.select(*[quoted(c).cast("double").alias(i) for c, i in zip(self.names_, self.inner_, strict=True)], *([quoted(self.label)] if keep else []))
        flags = [F.when(F.col(i).isNull(), 1.0).otherwise(0.0).alias(f"{i}_missing") for i in self.inner_]
        filled = self.imputer_.transform(numbers.select("*", *([] if self.trees else flags)))
        if self.scaler_ is not None:
            schema = {f.name: f for f in filled.schema}
            filled = filled.withColumns({i: self.scaler_.models_[i].exprs(schema[i])[0] for i in self.inner_})
        inputs = self.inner_ + ([] if self.trees else [f"{i}_missing" for i in self.inner_])
        return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(filled)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model_.transform(self._assembled(df))


def tabular_pipeline(estimator, label: str) -> TabularPipeline:
    return TabularPipeline(estimator, label)
