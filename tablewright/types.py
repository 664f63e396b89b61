"""Logical classes of columns, and the nulls they may hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_categorical(field: T.StructField) -> bool:
    return bool(field.metadata.get("categorical"))


def classify(field: T.StructField) -> str:
    """bool, int, float, decimal, category, string, date, duration, null or nested."""
    kind = field.dataType
    for name, types in (
        ("bool", T.BooleanType), ("int", INTEGERS), ("float", FLOATS), ("decimal", T.DecimalType),
        ("date", DATES), ("duration", T.DayTimeIntervalType), ("null", T.NullType),
    ):
        if isinstance(kind, types):
            return name
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "category" if is_categorical(field) else "string"
    return "nested"


def is_numeric(field: T.StructField) -> bool:
    """Integers, floats and decimals; booleans are not numbers here."""
    return classify(field) in ("int", "float", "decimal")


def no_nan(field: T.StructField) -> Column:
    """The column with NaN read as null, the rule all operators follow."""
    c = quoted(field.name)
    return F.when(~F.isnan(c), c).alias(field.name) if isinstance(field.dataType, FLOATS) else c


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with NaN read as null in all float columns."""
    if not any(isinstance(f.dataType, FLOATS) for f in df.schema):
        return df
    return df.select(*[no_nan(f) for f in df.schema])


def missing(field: T.StructField) -> Column:
    c = quoted(field.name)
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, FLOATS) else c.isNull()


def fresh_names(wanted: list[str], taken: list[str]) -> list[str]:
    """``wanted`` with ``__dup_<n>`` appended where a name is taken already."""
    used, out = set(taken), []
    for name in wanted:
        n, free = 1, name
        while free in used:
            free, n = f"{name}__dup_{n}", n + 1
        used.add(free)
        out.append(free)
    return out


def padded(n: int) -> list[str]:
    """0 to n - 1, all as wide as the last."""
    return [str(j).zfill(len(str(n - 1))) for j in range(n)]
