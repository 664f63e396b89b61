"""Apply operators to columns, and the Cleaner and TableVectorizer built so."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright import selectors as s
from tablewright.config import get_config
from tablewright.operators.columns import (
    SAMPLE_ROWS, CleanNullStrings, ColumnTransformer, DatetimeEncoder, DropUninformative, DurationToFloat, OneHot, PassThrough, Reject, ToDatetime, ToFloat, ToStr, with_shared,
)
from tablewright.operators.encoders import StringEncoder
from tablewright.operators.relational import check_columns
from tablewright.stats import distinct_counts, profile
from tablewright.types import classify, fresh_names, is_numeric, no_nan, quoted


class ApplyToCols:
    """A single-column operator on each selected column, outputs in its place.

    All fits share one aggregate job.  With ``allow_reject`` a column that the
    operator rejects stays as it is; else the rejection is raised.
    """

    def __init__(self, transformer: ColumnTransformer, cols=None, exclude_cols=None, allow_reject: bool = False, keep_original: bool = False, rename_columns: str = "{}"):
        self.transformer, self.allow_reject, self.keep_original, self.rename = transformer, allow_reject, keep_original, rename_columns
        self.selector = (s.all() if cols is None else s.make_selector(cols)) - (s.cols() if exclude_cols is None else s.make_selector(exclude_cols))

    def questions(self, df: DataFrame) -> tuple[dict[str, ColumnTransformer], dict]:
        """The operator to fit on each column that takes it, and the statistics they need."""
        eligible = []
        for name in self.selector.expand(df):
            try:
                self.transformer.check(df.schema[name])
                eligible.append(name)
            except Reject:
                if not self.allow_reject:
                    raise
        needed = [c for c in eligible if self.transformer.requests(df, df.schema[c])]
        chosen = dict.fromkeys(eligible, self.transformer)
        if needed and type(self.transformer).narrowed is not ColumnTransformer.narrowed:
            chosen |= self.transformer.narrowed(df.select(*[quoted(c) for c in needed]).limit(SAMPLE_ROWS), needed)
        return chosen, {(c, k): e for c, step in chosen.items() for k, e in step.requests(df, df.schema[c]).items()}

    def fit(self, df: DataFrame, known: dict | None = None, chosen: dict | None = None) -> ApplyToCols:
        """``known`` are statistics that were gathered before for the operators ``chosen``."""
        self.columns_, self.models_ = list(df.columns), {}
        if chosen is None:
            chosen, asked = self.questions(df)
            known = profile(df, asked)
        for name, step in chosen.items():
            if name not in df.columns:
                continue
            try:
                step.check(df.schema[name])
                self.models_[name] = step.fitted(df, df.schema[name], {k: v for (c, k), v in known.items() if c == name})
            except Reject:
                if not self.allow_reject:
                    raise
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        check_columns(df, self.columns_)
        out, schema = [], df.schema
        df = with_shared(df, self.models_)
        for field in schema:
            model = self.models_.get(field.name)
            if model is None or self.keep_original:
                out.append(quoted(field.name))
            if model is not None:
                exprs = model.exprs(field)
                if self.rename != "{}" or self.keep_original:
                    names = df.select(*exprs).columns
                    wanted = [self.rename.format(n) for n in names]
                    wanted = fresh_names(wanted, self.columns_) if self.keep_original else wanted
                    exprs = [e.alias(n) for e, n in zip(exprs, wanted, strict=True)]
                out += exprs
        return df.select(*out)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class ApplyToSubFrame:
    """A frame operator (``fit``/``transform``) on the selected columns, outputs last.

    ``fit`` sees the selected columns alone, and may return a model as estimators
    of ``pyspark.ml`` do.  ``transform`` adds or replaces columns of the frame it
    gets; other columns travel along, so rows stay together without a join.
    """

    def __init__(self, transformer, cols=None, keep_original: bool = False):
        self.transformer, self.keep_original = transformer, keep_original
        self.selector = s.all() if cols is None else s.make_selector(cols)

    def fit(self, df: DataFrame) -> ApplyToSubFrame:
        self.columns_, self.cols_ = list(df.columns), self.selector.expand(df)
        self.model_ = self.transformer.fit(df.select(*[quoted(c) for c in self.cols_])) or self.transformer
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        check_columns(df, self.columns_)
        after = self.model_.transform(df)
        new = [c for c in after.columns if c not in df.columns]
        kept = [c for c in df.columns if self.keep_original or c not in self.cols_]
        return after.select(*[quoted(c) for c in kept], *[quoted(c) for c in new])


def wrap_transformer(transformer, cols=None, allow_reject: bool = False, keep_original: bool = False, rename_columns: str = "{}"):
    """The wrapper that suits an operator: by column for column operators, else on the subframe."""
    if isinstance(transformer, ColumnTransformer):
        return ApplyToCols(transformer, cols, allow_reject=allow_reject, keep_original=keep_original, rename_columns=rename_columns)
    if not hasattr(transformer, "fit"):
        raise TypeError(f"{type(transformer).__name__} is no operator")
    return ApplyToSubFrame(transformer, cols, keep_original)


class SelectCols:
    """Keep the selected columns; which, is settled at fit."""

    def __init__(self, cols):
        self.cols = cols

    def _kept(self, df: DataFrame) -> list[str]:
        return s.make_selector(self.cols).expand(df)

    def fit(self, df: DataFrame) -> SelectCols:
        self.kept_ = self._kept(df)
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        absent = [c for c in self.kept_ if c not in df.columns]
        if absent:
            raise ValueError(f"columns not found: {absent}")
        return df.select(*[quoted(c) for c in self.kept_])


class DropCols(SelectCols):
    """Leave out the selected columns."""

    def _kept(self, df: DataFrame) -> list[str]:
        return s.inv(self.cols).expand(df)


class _Steps:
    """Operators one after the other; each is fitted on the output of those before."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.columns_ = list(df.columns)
        self.fitted_ = []
        for step in self.steps():
            df = step.fit_transform(df)
            self.fitted_.append(step)
        self.output_columns_ = list(df.columns)
        return df

    def fit(self, df: DataFrame):
        self.fit_transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        check_columns(df, self.columns_)
        for step in self.fitted_:
            df = step.transform(df)
        return df


def _takes(transformer: ColumnTransformer, field) -> bool:
    try:
        transformer.check(field)
        return True
    except Reject:
        return False


class Cleaner(_Steps):
    """Null strings, uninformative columns, dates, durations, numbers; in this order.

    ``null_strings`` are read as missing besides the usual ones; with None no string is.
    """

    def __init__(
        self, drop_null_fraction: float | None = 1.0, drop_if_constant: bool = False, drop_if_unique: bool = False, datetime_format: str | None = None,
        null_strings: tuple[str, ...] | None = (), parse_numbers: bool = False, cast_to_float32: bool = False, cast_to_str: bool = False,
    ):
        self.options = (drop_null_fraction, drop_if_constant, drop_if_unique, datetime_format, null_strings, parse_numbers, cast_to_float32, cast_to_str)

    def steps(self):
        fraction, constant, unique, fmt, nulls, parse, float32, as_str = self.options
        yield ApplyToCols(PassThrough() if nulls is None else CleanNullStrings(nulls), allow_reject=True)
        yield ApplyToCols(DropUninformative(constant, unique, fraction))
        yield ApplyToCols(ToDatetime(fmt), s.string(), allow_reject=True)
        yield ApplyToCols(DurationToFloat(), allow_reject=True)
        if parse:
            yield ApplyToCols(ToFloat(), s.string() | s.numeric() if float32 else s.string(), allow_reject=True)
        elif float32:
            yield ApplyToCols(ToFloat(), s.numeric(), allow_reject=True)
        if as_str:
            yield ApplyToCols(ToStr(), allow_reject=True)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit all steps from one pass over the data (and a look at a few rows).

        No step but the first changes a value that a later one counts, so what
        each would ask of the table as it enters the second is asked at once.
        """
        self.columns_, self.fitted_ = list(df.columns), []
        first, *later = self.steps()
        df = first.fit_transform(df)
        self.fitted_.append(first)
        asked, chosen = {}, []
        for j, step in enumerate(later):
            steps, questions = step.questions(df)
            chosen.append(steps)
            asked |= {(j, c, k): e for (c, k), e in questions.items()}
        known = profile(df, asked)
        before = {f.name: f.dataType for f in df.schema}
        for j, step in enumerate(later):
            changed = [f.name for f in df.schema if before.get(f.name) != f.dataType]
            if any(step.transformer.requests(df, df.schema[c]) for c in changed if c in step.selector.expand(df) and _takes(step.transformer, df.schema[c])):
                step.fit(df)  # a column that an earlier step turned into something this one counts
            else:
                own = {c: s for c, s in chosen[j].items()} | {c: step.transformer for c in step.selector.expand(df) if c in changed and _takes(step.transformer, df.schema[c])}
                step.fit(df, {(c, k): v for (i, c, k), v in known.items() if i == j}, own)
            df = step.transform(df)
            self.fitted_.append(step)
        self.output_columns_ = list(df.columns)
        return df


class TableVectorizer:
    """Clean a table, then numeric, time, and few- or many-valued text columns each their way.

    Columns of ``specific`` (name: operator) come first and are not cleaned.  The
    first that fits of numeric, datetime, low and high cardinality handles a
    column; ``kind_to_columns_`` and ``input_to_outputs_`` tell which.
    """

    def __init__(
        self, cardinality_threshold: int | None = None, low_cardinality=None, high_cardinality=None, numeric=None, datetime=None, specific: dict | None = None, **clean
    ):
        self.threshold = get_config()["cardinality_threshold"] if cardinality_threshold is None else cardinality_threshold
        self.low, self.numeric, self.datetime = low_cardinality or OneHot(), numeric or PassThrough(), datetime or DatetimeEncoder()
        self.high = high_cardinality or StringEncoder()
        self.specific, self.clean = specific or {}, clean

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.columns_ = list(df.columns)
        plain = [c for c in df.columns if c not in self.specific]
        self.cleaner_ = Cleaner(parse_numbers=True, cast_to_float32=True, **self.clean)
        cleaned = self.cleaner_.fit_transform(df.select(*[quoted(c) for c in plain]))
        kinds = {}
        texts = [f for f in cleaned.schema if classify(f) in ("string", "category", "bool")]
        counts = distinct_counts(cleaned, {f.name: no_nan(f) for f in texts})
        for f in cleaned.schema:
            kinds[f.name] = (
                "numeric" if is_numeric(f) else "datetime" if classify(f) == "date" else "low_cardinality" if counts.get(f.name, self.threshold) < self.threshold else "high_cardinality"
            )
        self.kind_to_columns_ = {k: [c for c in kinds if kinds[c] == k] for k in ("numeric", "datetime", "low_cardinality", "high_cardinality")}
        self.kind_to_columns_["specific"] = list(self.specific)
        of_kind = {"numeric": self.numeric, "datetime": self.datetime, "low_cardinality": self.low, "high_cardinality": self.high}
        whole = self._joined(df, cleaned)
        self.models_, self.input_to_outputs_ = {}, {}
        asked, chosen = {}, {}
        for name in whole.columns:
            step = self.specific.get(name) or of_kind[kinds[name]]
            chosen[name] = step
            if isinstance(step, ColumnTransformer):
                asked |= {(name, k): e for k, e in step.requests(whole, whole.schema[name]).items()}
        stats = profile(whole, asked)
        for name, step in chosen.items():
            if isinstance(step, ColumnTransformer):
                self.models_[name] = step.fitted(whole, whole.schema[name], {k: v for (c, k), v in stats.items() if c == name})
            else:
                self.models_[name] = step.fitted_for(whole, name)
        return self.transform(df)

    fit = lambda self, df: (self.fit_transform(df), self)[1]

    def _joined(self, df: DataFrame, cleaned: DataFrame) -> DataFrame:
        """Cleaned columns and specific ones: one projection of ``df``."""
        if not self.specific:
            return cleaned
        for step in (f for f in self.cleaner_.fitted_):
            df = self._on_others(step, df)
        return df

    def _on_others(self, step: ApplyToCols, df: DataFrame) -> DataFrame:
        out = []
        for field in df.schema:
            model = step.models_.get(field.name) if field.name not in self.specific else None
            out += model.exprs(field) if model is not None else [quoted(field.name)]
        return df.select(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        check_columns(df, self.columns_)
        plain = df.select(*[quoted(c) for c in df.columns if c not in self.specific])
        whole = self._joined(df, plain if self.specific else self.cleaner_.transform(plain))
        out, schema = [], whole.schema
        whole = with_shared(whole, self.models_)
        for field in schema:
            model = self.models_[field.name]
            exprs = model.exprs(field)
            self.input_to_outputs_[field.name] = whole.select(*exprs).columns if exprs else []
            out += exprs
        return whole.select(*out)
