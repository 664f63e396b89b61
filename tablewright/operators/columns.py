"""Single-column operators: cleaning, parsing, dates and scaling.

An operator names the aggregates it needs (``requests``), decides from their
values (``fitted``) and then is a list of expressions (``exprs``).  Fits of many
columns share one aggregate job; a transform is one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.primitives import NUMBER, total_seconds
from tablewright.stats import Quantiles, distinct_values, profile
from tablewright.types import classify, is_numeric, missing, no_nan, quoted

#: Strings read as missing besides blank ones.
NULL_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "none", "?", "...",
)


class Reject(ValueError):
    """An operator does not apply to a column."""


class ColumnTransformer:
    """Base of single-column operators."""

    def check(self, field: T.StructField) -> None:
        """Raise :class:`Reject` where the column's type does not fit."""

    def requests(self, df: DataFrame, field: T.StructField) -> dict[str, Column]:
        return {}

    def fitted(self, df: DataFrame, field: T.StructField, stats: dict) -> ColumnTransformer:
        """A copy that holds what the statistics tell; may raise :class:`Reject`."""
        return self

    def narrowed(self, sample: DataFrame, names: list[str]) -> dict[str, ColumnTransformer]:
        """The operator to fit on each column, after a look at a few rows.

        The sample may only rule out what would fail on all rows, too.
        """
        return dict.fromkeys(names, self)

    def shared(self, field: T.StructField) -> list[dict[str, Column]]:
        """Columns that several of ``exprs`` use, computed once before them, layer by layer."""
        return []

    def exprs(self, field: T.StructField) -> list[Column]:
        raise NotImplementedError

    def fit(self, df: DataFrame, column: str) -> ColumnTransformer:
        field = df.schema[column]
        self.check(field)
        return self.fitted(df, field, profile(df, self.requests(df, field)))

    def fit_transform(self, df: DataFrame, column: str) -> DataFrame:
        model = self.fit(df, column)
        return with_shared(df, {column: model}).select(*model.exprs(df.schema[column]))


def with_shared(df: DataFrame, models: dict[str, ColumnTransformer]) -> DataFrame:
    """``df`` with the shared columns of the models of its columns."""
    layers: list[dict[str, Column]] = []
    for name, model in models.items():
        for j, layer in enumerate(model.shared(df.schema[name])):
            layers += [{}] * (j + 1 - len(layers))
            layers[j] = layers[j] | layer
    for layer in layers:
        df = df.withColumns(layer)
    return df


def _copy(transformer, **values):
    new = object.__new__(type(transformer))
    new.__dict__.update(transformer.__dict__ | values)
    return new


class PassThrough(ColumnTransformer):
    def exprs(self, field):
        return [quoted(field.name)]


class Drop(ColumnTransformer):
    def exprs(self, field):
        return []


class CleanNullStrings(ColumnTransformer):
    """Blank strings and names of missing values become null."""

    def __init__(self, null_strings: tuple[str, ...] = ()):
        self.null_strings = tuple(NULL_STRINGS) + tuple(null_strings)

    def check(self, field):
        if classify(field) != "string":
            raise Reject(f"{field.name} holds no strings")

    def exprs(self, field):
        c = quoted(field.name)
        return [F.when(~(c.rlike(r"^\s*$") | c.isin(*self.null_strings)), c).alias(field.name)]


class DropUninformative(ColumnTransformer):
    """Drop columns with too many nulls, and constant or all-different ones on demand."""

    def __init__(self, drop_if_constant: bool = False, drop_if_unique: bool = False, drop_null_fraction: float | None = 1.0):
        if drop_null_fraction is not None and not 0 <= drop_null_fraction <= 1:
            raise ValueError("drop_null_fraction must lie between 0 and 1, or be None")
        self.drop_if_constant, self.drop_if_unique, self.drop_null_fraction = drop_if_constant, drop_if_unique, drop_null_fraction
        self.drops = False

    def requests(self, df, field):
        out = {"n": F.count(F.lit(1)), "known": F.count(F.when(~missing(field), 1))}
        if self.drop_if_constant or self.drop_if_unique:
            out["distinct"] = F.count_distinct(no_nan(field))
        return out

    def decide(self, field, stats) -> bool:
        n, known = stats["n"], stats["known"]
        share = (n - known) / n if n else 0.0
        limit = self.drop_null_fraction
        if limit is not None and n and (known == 0 if limit == 1.0 else share > limit):
            return True
        if self.drop_if_constant and known == n and stats["distinct"] == 1:
            return True
        return self.drop_if_unique and not is_numeric(field) and known == n and stats["distinct"] == n > 0

    def fitted(self, df, field, stats):
        return _copy(self, drops=self.decide(field, stats))

    def exprs(self, field):
        return [] if self.drops else [quoted(field.name)]


#: Date formats tried in turn, month first where both fit.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd",
    "dd MMM yyyy", "MMM dd, yyyy", "dd MMMM yyyy",
)


#: Rows that are looked at to rule formats out.
SAMPLE_ROWS = 200


def _parsed(column: Column, fmt: str) -> Column:
    return F.try_to_timestamp(column, F.lit(fmt))


class ToDatetime(ColumnTransformer):
    """Strings become timestamps when one format reads all of them; later bad ones are null.

    The format is checked on all values, not on a sample.
    """

    def __init__(self, format: str | None = None):
        self.format, self.formats = format, [format] if format else list(DATE_FORMATS)

    def check(self, field):
        if classify(field) not in ("string", "date"):
            raise Reject(f"{field.name} holds no dates")

    def narrowed(self, sample, names):
        """A format that fails on some of a few values cannot read all: it is not tried on the rest."""
        names = [c for c in names if classify(sample.schema[c]) == "string"]
        asked = {(c, k): e for c in names for k, e in self.requests(sample, sample.schema[c]).items()}
        seen = profile(sample, asked)
        return {c: _copy(self, formats=[f for (d, f), n in seen.items() if d == c and f != "known" and n == seen[c, "known"]]) for c in names}

    def requests(self, df, field):
        if classify(field) == "date":
            return {}
        c = quoted(field.name)
        return {"known": F.count(c)} | {f: F.count(_parsed(c, f)) for f in self.formats}

    def fitted(self, df, field, stats):
        if classify(field) == "date":
            return self
        known = stats.pop("known")
        good = [f for f, n in stats.items() if n == known and known]
        if not good:
            raise Reject(f"{field.name} does not hold dates of one format")
        return _copy(self, format=good[0])

    def exprs(self, field):
        c = quoted(field.name)
        return [c] if classify(field) == "date" else [_parsed(c, self.format).alias(field.name)]


def to_datetime(df: DataFrame, format: str | None = None) -> DataFrame:
    """Parse all columns that hold dates; others stay."""
    out, fields = [], list(df.schema)
    steps = ToDatetime(format).narrowed(df.limit(SAMPLE_ROWS), [f.name for f in fields])
    asked = {f.name: steps[f.name].requests(df, f) for f in fields if f.name in steps}
    stats = profile(df, {f"{c}\0{k}": e for c, r in asked.items() for k, e in r.items()})
    for f in fields:
        try:
            own = {k: stats[f"{f.name}\0{k}"] for k in asked.get(f.name, {})}
            step = steps.get(f.name, ToDatetime(format))
            step.check(f)
            out += step.fitted(df, f, own).exprs(f)
        except Reject:
            out.append(quoted(f.name))
    return df.select(*out)


def time_zone_of(df: DataFrame, column: str) -> str | None:
    """The zone in which a column's times are shown: the session's, or None for local times."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return None
    raise Reject(f"{column} holds no times")


def convert_time_zone(df: DataFrame, column: str, to: str | None, source: str = "UTC") -> DataFrame:
    """Local times of zone ``source``, or instants, as local times of zone ``to``.

    With ``to`` None, local times of ``source`` become instants.
    """
    c = quoted(column)
    if time_zone_of(df, column) is not None:
        local = F.convert_timezone(F.lit(time_zone_of(df, column)), F.lit(to), c.cast("timestamp_ntz")) if to else c
    elif to:
        local = F.convert_timezone(F.lit(source), F.lit(to), c.cast("timestamp_ntz"))
    else:
        local = F.to_utc_timestamp(F.convert_timezone(F.lit(source), F.lit(df.sparkSession.conf.get("spark.sql.session.timeZone")), c.cast("timestamp_ntz")).cast("timestamp"), "UTC")
    return df.withColumn(column, local)


class ToFloat(ColumnTransformer):
    """Numbers written as text become floats; one bad value at fit rejects the column."""

    def __init__(self, decimal: str = ".", thousand: str | None = None, parentheses: bool = False):
        if decimal == thousand:
            raise ValueError("the decimal and the thousand separator must differ")
        self.decimal, self.thousand, self.parentheses = decimal, thousand, parentheses

    def check(self, field):
        if classify(field) not in ("string", "int", "float", "decimal", "bool"):
            raise Reject(f"{field.name} holds no numbers")

    def number(self, field) -> Column:
        c = quoted(field.name)
        if classify(field) != "string":
            return no_nan(field).cast("float")
        if self.parentheses:
            c = F.regexp_replace(c, r"^\s*\((.*)\)\s*$", "-$1")
        if self.thousand:
            c = F.replace(c, F.lit(self.thousand), F.lit(""))
        if self.decimal != ".":
            c = F.replace(c, F.lit(self.decimal), F.lit("."))
        return F.when(c.rlike(NUMBER), c.try_cast("float"))

    def requests(self, df, field):
        return {"known": F.count(F.when(~missing(field), 1)), "good": F.count(self.number(field))}

    def fitted(self, df, field, stats):
        if classify(field) == "string" and (stats["good"] < stats["known"] or not stats["known"]):
            raise Reject(f"{field.name} holds other things than numbers")
        return self

    def exprs(self, field):
        return [self.number(field).alias(field.name)]


class ToStr(ColumnTransformer):
    def __init__(self, convert_category: bool = False):
        self.convert_category = convert_category

    def check(self, field):
        kind = classify(field)
        if kind in ("int", "float", "decimal", "date") or kind == "category" and not self.convert_category:
            raise Reject(f"{field.name} is not text")

    def exprs(self, field):
        c = quoted(field.name)
        text = F.to_json(c) if classify(field) == "nested" else c.cast("string")
        return [text.alias(field.name, metadata={})]


class ToCategorical(ColumnTransformer):
    """Mark a string column as categorical in its metadata."""

    def check(self, field):
        if classify(field) not in ("string", "category"):
            raise Reject(f"{field.name} holds no strings")

    def exprs(self, field):
        return [quoted(field.name).alias(field.name, metadata=field.metadata | {"categorical": True})]


class DurationToFloat(ColumnTransformer):
    def check(self, field):
        if classify(field) != "duration":
            raise Reject(f"{field.name} holds no durations")

    def exprs(self, field):
        return [total_seconds(field).cast("float").alias(field.name)]


LEVELS = ("year", "month", "day", "hour", "minute", "second", "microsecond", "nanosecond")
#: Periods of the parts of a time, and splines over each.
PERIODS = {"month": 12, "day": 30, "hour": 24, "weekday": 7}
SPLINES = {"month": 12, "day": 4, "hour": 12, "weekday": 7}


def spline_table(period: int, n_splines: int, degree: int = 3) -> list[list[float]]:
    """Values of periodic B-splines at 0 to ``period``, one row for each point."""
    width = period / n_splines

    def basis(x: float, d: int) -> float:
        """The cardinal B-spline of degree d on [0, d + 1]."""
        if d == 0:
            return 1.0 if 0 <= x < 1 else 0.0
        return (x * basis(x, d - 1) + (d + 1 - x) * basis(x - 1, d - 1)) / d

    rows = []
    for point in range(period + 1):
        t = (point % period) / width
        rows.append([sum(basis(t - j + lap * n_splines + degree, degree) for lap in (-2, -1, 0, 1, 2)) for j in range(n_splines)])
    return rows


class DatetimeEncoder(ColumnTransformer):
    """Parts of a time as floats: ``{column}_{feature}``.

    Years down to ``resolution`` (days if all times are midnight), seconds since
    1970, ISO weekday, day of the year; ``periodic_encoding`` "circular" or
    "spline" replaces month, day, hour and weekday by periodic features.
    """

    def __init__(
        self, resolution: str | None = "hour", add_weekday: bool = False, add_total_seconds: bool = True, add_day_of_year: bool = False, periodic_encoding: str | None = None
    ):
        if resolution is not None and resolution not in LEVELS:
            raise ValueError(f"resolution must be one of {LEVELS} or None")
        if periodic_encoding not in (None, "circular", "spline"):
            raise ValueError("periodic_encoding must be None, 'circular' or 'spline'")
        self.resolution, self.add_weekday, self.add_total_seconds = resolution, add_weekday, add_total_seconds
        self.add_day_of_year, self.periodic_encoding = add_day_of_year, periodic_encoding

    def check(self, field):
        if classify(field) != "date":
            raise Reject(f"{field.name} holds no times")

    def requests(self, df, field):
        c = quoted(field.name)
        return {"dates": F.bool_and(F.date_trunc("day", c.cast("timestamp_ntz")) == c.cast("timestamp_ntz"))}

    def fitted(self, df, field, stats):
        only_dates = stats["dates"] is not False or isinstance(field.dataType, T.DateType)
        if only_dates and self.resolution in LEVELS[3:]:
            return _copy(self, resolution="day")
        return self

    def _part(self, field, name) -> Column:
        c = quoted(field.name)
        if name == "weekday":
            return F.extract(F.lit("dayofweek_iso"), c)
        if name == "day_of_year":
            return F.dayofyear(c)
        if name == "total_seconds":
            return total_seconds(field)
        second = F.extract(F.lit("second"), c.cast("timestamp_ntz"))
        if name == "second":
            return F.floor(second)
        if name == "microsecond":
            return F.rint((second - F.floor(second)) * 1_000_000)
        if name == "nanosecond":
            return F.when(c.isNotNull(), F.lit(0))
        return F.extract(F.lit(name), c.cast("timestamp_ntz"))

    def exprs(self, field):
        names = list(LEVELS[: LEVELS.index(self.resolution) + 1]) if self.resolution else []
        if self.add_total_seconds:
            names.append("total_seconds")
        if self.add_weekday:
            names.append("weekday")
        if self.add_day_of_year:
            names.append("day_of_year")
        out = []
        for name in names:
            part = self._part(field, name)
            full = f"{field.name}_{name}"
            if self.periodic_encoding and name in PERIODS:
                period = PERIODS[name]
                if self.periodic_encoding == "circular":
                    angle = part * (2 * math.pi / period)
                    out += [F.sin(angle).cast("float").alias(f"{full}_circular_0"), F.cos(angle).cast("float").alias(f"{full}_circular_1")]
                else:
                    table = spline_table(period, SPLINES[name])
                    for j in range(SPLINES[name]):
                        values = F.array(*[F.lit(row[j]) for row in table])
                        out.append(F.get(values, (part.cast("int") % period)).cast("float").alias(f"{full}_spline_{str(j).zfill(len(str(SPLINES[name] - 1)))}"))
            else:
                out.append(part.cast("float").alias(full))
        return out


class SquashingScaler(ColumnTransformer):
    """Centre by the median, scale by a quantile range, squash outliers smoothly.

    z / sqrt(1 + (z / B)^2) stays within ``max_absolute_value`` B.  A constant
    column gives 0; a zero quantile range falls back to the whole range; infinite
    values become plus or minus B; missing values stay missing.
    """

    def __init__(self, max_absolute_value: float = 3.0, quantile_range: tuple[float, float] = (25.0, 75.0)):
        low, high = quantile_range
        if not 0 <= low < high <= 100:
            raise ValueError("quantile_range must be two rising percentages")
        if not max_absolute_value > 0 or math.isinf(max_absolute_value):
            raise ValueError("max_absolute_value must be positive and finite")
        self.bound, self.quantiles = max_absolute_value, quantile_range
        self.center, self.scale = 0.0, 0.0

    def check(self, field):
        if not is_numeric(field):
            raise Reject(f"{field.name} holds no numbers")

    def requests(self, df, field):
        c = no_nan(field).cast("double")
        finite = F.when(F.abs(c) < float("inf"), c)
        low, high = (q / 100 for q in self.quantiles)
        return {"q": Quantiles(finite, (low, 0.5, high)), "min": F.min(finite), "max": F.max(finite)}

    def fitted(self, df, field, stats):
        if stats["min"] is None or stats["min"] == stats["max"]:
            return _copy(self, center=stats["min"] or 0.0, scale=0.0)
        low, median, high = stats["q"]
        if high > low:
            return _copy(self, center=median, scale=1.0 / (high - low))
        return _copy(self, center=median, scale=2.0 / (stats["max"] - stats["min"] + 2.2250738585072014e-308))

    def exprs(self, field):
        c = no_nan(field).cast("double")
        z = (c - self.center) * self.scale
        finite = z / F.sqrt(1 + (z / self.bound) * (z / self.bound))
        return [F.when(F.abs(c) == float("inf"), F.signum(c) * self.bound).otherwise(finite).alias(field.name)]


#: Categories that become columns or ranks; a column with more is no category.
MOST_CATEGORIES = 10_000


class OneHot(ColumnTransformer):
    """``{column}_{category}`` per category in order; null is a category.

    A binary column gives one output.  Unknown categories give zeros.  More than
    ``MOST_CATEGORIES`` are refused at fit.
    """

    def __init__(self, drop_binary: bool = True):
        self.drop_binary, self.categories = drop_binary, []

    def requests(self, df, field):
        return {"nulls": F.count(F.when(missing(field), 1))}

    def fitted(self, df, field, stats):
        found = distinct_values(df, no_nan(field).cast("string"), MOST_CATEGORIES) + ([None] if stats["nulls"] else [])
        return _copy(self, categories=found[1:] if self.drop_binary and len(found) == 2 else found)

    def exprs(self, field):
        c = quoted(field.name).cast("string")
        return [F.when(c.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0).cast("float").alias(f"{field.name}_{v}") for v in self.categories]


class Ordinal(ColumnTransformer):
    """The rank of a category among the sorted ones, -1 if unknown, null if null."""

    def __init__(self):
        self.categories = []

    def fitted(self, df, field, stats):
        return _copy(self, categories=distinct_values(df, no_nan(field).cast("string"), MOST_CATEGORIES))

    def exprs(self, field):
        c = quoted(field.name).cast("string")
        place = F.array_position(F.array(*[F.lit(v) for v in self.categories]).cast("array<string>"), c)
        return [F.when(c.isNull(), None).when(place > 0, place - 1).otherwise(-1).cast("int").alias(field.name)]


def scaling_factor(df: DataFrame, columns: list[str]) -> float:
    """Root of the summed population variances, 1 where that is almost 0."""
    stats = profile(df, {c: F.var_pop(no_nan(df.schema[c]).cast("double")) for c in columns})
    total = math.sqrt(sum(v or 0.0 for v in stats.values()))
    return total if total > 2.2e-15 else 1.0
