"""Primitives that the operators are made of, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.stats import Quantiles, exact_quantiles
from tablewright.types import DATES, fresh_names, no_nan, quoted

#: Strings that Spark's casts accept as numbers but strict parsing should not.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(frames: list[DataFrame], on: str) -> DataFrame:
    """Columns of frames side by side, aligned on the row id ``on``.

    Spark's rows have no positions, so an id must name them.  Repeated column
    names get a ``__dup_<n>`` suffix.
    """
    out = frames[0]
    for frame in frames[1:]:
        names = [c for c in frame.columns if c != on]
        renamed = frame.withColumnsRenamed(dict(zip(names, fresh_names(names, out.columns), strict=True)))
        out = out.join(renamed, on, "full")
    return out


def to_float32(column: Column, strict: bool = False) -> Column:
    """A float, null where the text is not a number; with ``strict`` that is an error."""
    text = column.cast("string")
    value = F.when(text.rlike(NUMBER), text.try_cast("float"))
    if strict:
        value = F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("float")).otherwise(value)
    return value.cast("float")


def fill_nulls(df: DataFrame, column: str, value) -> DataFrame:
    """``df`` with nulls and NaN of a column replaced."""
    field = df.schema[column]
    return df.withColumn(column, F.coalesce(no_nan(field), F.lit(value).cast(field.dataType)))


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    """The rows in which a column is neither null nor NaN."""
    return df.where(no_nan(df.schema[column]).isNotNull())


def head(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The first ``n`` rows in the order of ``by``."""
    return df.orderBy(*[quoted(b) for b in by]).limit(n)


def tail(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The last ``n`` rows in the order of ``by``."""
    return df.orderBy(*[F.desc(quoted(b)) for b in by]).limit(n)


def total_seconds(field: T.StructField) -> Column:
    """Seconds since 1970 of a date or timestamp, or of a duration, as a double."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.DayTimeIntervalType):
        return (F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)).cast("double")
    if not isinstance(field.dataType, DATES):
        raise TypeError(f"{field.name} holds neither times nor durations")
    name = c if isinstance(field.dataType, T.TimestampNTZType) else c.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), name).cast("double") / 1e6


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(value, count)`` of non-null values, frequent first, ties by value."""
    field = df.schema[column]
    counts = df.select(no_nan(field).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("value")).limit(top) if top else counts


def quantiles_nearest(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """``(column, q, value)``: exact quantiles, the value of the nearest rank.

    See :func:`tablewright.stats.exact_quantiles`: no task sees a whole column.
    """
    asked = {c: Quantiles(no_nan(df.schema[c]), tuple(float(q) for q in probabilities), nearest=True) for c in columns}
    found = exact_quantiles(df, asked)
    rows = [(c, q, v) for c in columns if found[c] is not None for q, v in zip(asked[c].probabilities, found[c], strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), those of the least hash of key and seed."""
    return df.orderBy(F.xxhash64(quoted(key), F.lit(seed)), quoted(key)).limit(n)


def pearson(df: DataFrame, left: str, right: str) -> Column:
    """An aggregate: correlation over rows where both are present, null without variance."""
    x, y = no_nan(df.schema[left]).cast("double"), no_nan(df.schema[right]).cast("double")
    x, y = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def is_sorted(df: DataFrame, column: str, by: list[str], descending: bool = False) -> bool:
    """Whether non-null values never fall (rise) in the order of ``by``.

    Rows are dealt by range of ``by``; each part reports whether it is sorted,
    and its first and last value, and only these few meet.
    """
    c = F.col("value")
    frame = df.select(no_nan(df.schema[column]).alias("value"), *[quoted(b).alias(f"b{j}") for j, b in enumerate(by)]).where("value is not null")
    keys = [f"b{j}" for j in range(len(by))]
    dealt = frame.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*keys)
    before = dealt.withColumn("before", F.lag("value").over(inside))
    place = F.struct(*keys)
    parts = before.groupBy("part").agg(
        F.max(F.when(c > F.col("before") if descending else c < F.col("before"), 1)).alias("wrong"), F.min_by("value", place).alias("first"), F.max_by("value", place).alias("last")
    )
    rows = parts.orderBy("part").collect()  # a row a part
    steps = zip(rows, rows[1:], strict=False)
    return not any(r["wrong"] for r in rows) and all((b["first"] <= a["last"]) if descending else (b["first"] >= a["last"]) for a, b in steps)
