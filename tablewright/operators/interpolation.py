"""Join by prediction: one model per auxiliary column."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.primitives import total_seconds
from tablewright.operators.columns import OneHot, with_shared
from tablewright.operators.encoders import StringEncoder
from tablewright.operators.relational import check_keys
from tablewright.stats import distinct_counts
from tablewright.types import classify, fresh_names, is_numeric, no_nan, quoted


class InterpolationJoiner:
    """Predict each auxiliary column from the key and add the predictions.

    Keys are numbers, times, and strings, the last one-hot where they are few
    and by ``string_encoder`` otherwise.
    Numbers by gradient-boosted trees, strings and booleans by a random forest
    (``regressor`` and ``classifier`` may be other estimators of ``pyspark.ml``).
    Rows where a column is null do not train it.  A column whose model fails is
    null, and the failure is raised, warned of or passed over.
    """

    def __init__(self, aux_table: DataFrame, *, key=None, main_key=None, aux_key=None, suffix: str = "", regressor=None, classifier=None, string_encoder=None, cardinality_threshold: int = 40, on_estimator_failure: str = "warn"):
        if on_estimator_failure not in ("warn", "raise", "pass"):
            raise ValueError("on_estimator_failure must be 'warn', 'raise' or 'pass'")
        self.aux, self.keys, self.suffix, self.on_failure = aux_table, (key, main_key, aux_key), suffix, on_estimator_failure
        self.string_encoder, self.cardinality_threshold = string_encoder or StringEncoder(10), cardinality_threshold
        self.regressor, self.classifier = regressor or GBTRegressor(maxIter=20, seed=0), classifier or RandomForestClassifier(seed=0)

    def _fit_keys(self) -> None:
        """Operators that make numbers of the keys: times in seconds, strings one-hot or by their n-grams."""
        self.key_models_ = {}
        for c in self.aux_keys_:
            field = self.aux.schema[c]
            if is_numeric(field) or classify(field) == "date":
                continue
            if classify(field) not in ("string", "category", "bool"):
                raise ValueError(f"key column {c!r} must hold numbers, times or strings")
            few = distinct_counts(self.aux, {c: quoted(c)})[c] < self.cardinality_threshold
            self.key_models_[c] = (OneHot(drop_binary=False) if few else self.string_encoder).fit(self.aux, c)

    def _features(self, df: DataFrame, keys: list[str]) -> DataFrame:
        named = df.withColumns({f"__key_{j}": quoted(c) for j, c in enumerate(keys)})
        models, numbers = {}, []
        for j, c in enumerate(self.aux_keys_):
            field = named.schema[f"__key_{j}"]
            if c in self.key_models_:
                models[field.name] = self.key_models_[c]
            else:
                x = total_seconds(field) if classify(field) == "date" else no_nan(field).cast("double")
                numbers.append(F.coalesce(x, F.lit(0.0)))
        named = with_shared(named, models)
        numbers += [F.coalesce(e.cast("double"), F.lit(0.0)) for name, m in models.items() for e in m.exprs(named.schema[name])]
        names = [f"__x{j}" for j in range(len(numbers))]
        wide = named.select(*[quoted(c) for c in df.columns], *[x.alias(n) for x, n in zip(numbers, names, strict=True)])
        return VectorAssembler(inputCols=names, outputCol="__features").transform(wide).drop(*names)

    def fit(self, X: DataFrame) -> InterpolationJoiner:
        self.main_keys_, self.aux_keys_ = check_keys(X, self.aux, *self.keys)
        self._fit_keys()
        train = self._features(self.aux, self.aux_keys_).persist()  # only to spare a rereading for each column
        self.models_ = {}
        for field in self.aux.schema:
            if field.name in self.aux_keys_:
                continue
            rows = train.where(no_nan(field).isNotNull())
            try:
                if is_numeric(field):
                    label = rows.select("__features", quoted(field.name).cast("double").alias("__y"))
                    model = self.regressor.copy({self.regressor.featuresCol: "__features", self.regressor.labelCol: "__y", self.regressor.predictionCol: "__p"}).fit(label)
                    self.models_[field.name] = (field, model, None)
                else:
                    text = rows.select("__features", quoted(field.name).cast("string").alias("__t"))
                    index = StringIndexer(inputCol="__t", outputCol="__y", stringOrderType="alphabetAsc").fit(text)
                    forest = self.classifier
                    settings = {forest.featuresCol: "__features", forest.labelCol: "__y", forest.predictionCol: "__p"}
                    model = forest.copy(settings).fit(index.transform(text))
                    self.models_[field.name] = (field, model, index.labels)
            except Exception as error:
                if self.on_failure == "raise":
                    raise
                if self.on_failure == "warn":
                    warnings.warn(f"no model for {field.name!r}: {error}", stacklevel=2)
                self.models_[field.name] = (field, None, None)
        train.unpersist()
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        names = fresh_names([f"{c}{self.suffix}" for c in self.models_], X.columns)
        out = self._features(X, self.main_keys_)
        for (field, model, labels), name in zip(self.models_.values(), names, strict=True):
            kept = [c for c in out.columns]
            if model is None:
                out = out.withColumn(name, F.lit(None).cast(field.dataType))
                continue
            predicted = model.transform(out)
            if labels is not None:
                predicted = IndexToString(inputCol="__p", outputCol="__s", labels=labels).transform(predicted).withColumn("__p", quoted("__s").cast(field.dataType))
            out = predicted.select(*[quoted(c) for c in kept], F.col("__p").cast(field.dataType).alias(name))
        return out.drop("__features")

    def fit_transform(self, X: DataFrame) -> DataFrame:
        return self.fit(X).transform(X)
