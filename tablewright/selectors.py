"""Column selectors: predicates over a schema, combined by set algebra.

A selector expands to column names in the order of the frame (``cols`` keeps the
order asked for).  Selectors that look at data gather all their statistics in
one aggregate job per expansion.
"""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.types import classify, is_numeric, missing, no_nan, quoted


class Selector:
    """Base: ``matches(df)`` gives the set of selected names."""

    def matches(self, df: DataFrame) -> set[str]:
        raise NotImplementedError

    def expand(self, df: DataFrame) -> list[str]:
        chosen = self.matches(df)
        return [c for c in df.columns if c in chosen]

    def expand_index(self, df: DataFrame) -> list[int]:
        chosen = self.matches(df)
        return [j for j, c in enumerate(df.columns) if c in chosen]

    def __invert__(self):
        return Combined(lambda a, _, every: every - a, self, self)

    def __or__(self, other):
        return Combined(lambda a, b, _: a | b, self, make_selector(other))

    def __and__(self, other):
        return Combined(lambda a, b, _: a & b, self, make_selector(other))

    def __sub__(self, other):
        return Combined(lambda a, b, _: a - b, self, make_selector(other))

    def __xor__(self, other):
        return Combined(lambda a, b, _: a ^ b, self, make_selector(other))

    def __ror__(self, other):
        return make_selector(other) | self

    def __rand__(self, other):
        return make_selector(other) & self

    def __rsub__(self, other):
        return make_selector(other) - self

    def __rxor__(self, other):
        return make_selector(other) ^ self


class Combined(Selector):
    def __init__(self, rule: Callable, left: Selector, right: Selector):
        self.rule, self.left, self.right = rule, left, right

    def matches(self, df):
        return self.rule(self.left.matches(df), self.right.matches(df), set(df.columns))


class Cols(Selector):
    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def matches(self, df):
        absent = [c for c in self.names if c not in df.columns]
        if absent:
            raise ValueError(f"columns not found: {absent}")
        return set(self.names)

    def expand(self, df):
        self.matches(df)
        return list(dict.fromkeys(self.names))


class Fields(Selector):
    """Selects by a predicate over the schema's fields."""

    def __init__(self, predicate: Callable[[T.StructField], bool]):
        self.predicate = predicate

    def matches(self, df):
        return {f.name for f in df.schema if self.predicate(f)}


class Data(Selector):
    """Selects by a predicate over ``(frame, field)``."""

    def __init__(self, predicate: Callable[[DataFrame, T.StructField], bool]):
        self.predicate = predicate

    def matches(self, df):
        return {f.name for f in df.schema if self.predicate(df, f)}


class Statistic(Selector):
    """Selects by one aggregate per column; all are computed in one job."""

    def __init__(self, expression: Callable, test: Callable[[object, int], bool], eligible: Callable = lambda f: True):
        self.expression, self.test, self.eligible = expression, test, eligible

    def matches(self, df):
        fields = [f for f in df.schema if self.eligible(f)]
        if not fields:
            return set()
        row = df.agg(F.count(F.lit(1)).alias("n"), *[self.expression(f).alias(f"c{j}") for j, f in enumerate(fields)]).first()
        return {f.name for j, f in enumerate(fields) if self.test(row[f"c{j}"], row["n"])}


class Distinct(Selector):
    """Selects by the number of distinct values, nulls aside; all columns in one stacked count."""

    def __init__(self, test: Callable[[int], bool]):
        self.test = test

    def matches(self, df):
        from tablewright.stats import distinct_counts

        values = {f.name: F.to_json(quoted(f.name)) if classify(f) == "nested" else no_nan(f) for f in df.schema if not isinstance(f.dataType, T.MapType)}
        return {name for name, n in distinct_counts(df, values).items() if self.test(n)}


def make_selector(obj) -> Selector:
    """A selector from a selector, a name or names."""
    if isinstance(obj, Selector):
        return obj
    if isinstance(obj, str):
        return Cols((obj,))
    if isinstance(obj, (list, tuple)) and builtins.all(isinstance(c, str) for c in obj):
        return Cols(tuple(obj))
    raise ValueError(f"cannot select columns by {obj!r}")


def all() -> Selector:  # noqa: A001
    return Fields(lambda f: True)


def cols(*names: str) -> Selector:
    return Cols(names)


def inv(obj) -> Selector:
    return ~make_selector(obj)


def filter(predicate: Callable[[DataFrame, T.StructField], bool]) -> Selector:  # noqa: A001
    return Data(predicate)


def filter_names(predicate: Callable[[str], bool]) -> Selector:
    return Fields(lambda f: predicate(f.name))


def glob(pattern: str) -> Selector:
    return Fields(lambda f: fnmatchcase(f.name, pattern))


def regex(pattern: str, flags: int = 0) -> Selector:
    """Names that ``pattern`` matches from their start."""
    return Fields(lambda f: re.match(pattern, f.name, flags) is not None)


def numeric() -> Selector:
    return Fields(is_numeric)


def _of(*classes: str) -> Selector:
    return Fields(lambda f: classify(f) in classes)


def integer() -> Selector:
    return _of("int")


def float() -> Selector:  # noqa: A001
    return _of("float")


def any_date() -> Selector:
    return _of("date")


def categorical() -> Selector:
    return _of("category")


def string() -> Selector:
    return _of("string")


def object() -> Selector:  # noqa: A001
    return _of("nested")


def boolean() -> Selector:
    return _of("bool")


def has_dtype(*types: T.DataType) -> Selector:
    return Fields(lambda f: any_of(f.dataType == t for t in types))


def any_of(values) -> bool:
    return next((True for v in values if v), False)


def cardinality_below(threshold: int) -> Selector:
    """Fewer than ``threshold`` distinct values, nulls aside."""
    return Distinct(lambda n: n < threshold)


def has_nulls(proportion: float | int = 0) -> Selector:
    """Any null (0), all null (1), or a share of nulls above ``proportion``."""
    if not 0 <= proportion <= 1:
        raise ValueError("proportion must lie between 0 and 1")

    def test(nulls, n):
        nulls = nulls or 0
        if proportion == 1:
            return nulls == n
        return nulls > 0 if proportion == 0 else n > 0 and nulls / n > proportion

    return Statistic(lambda f: F.sum(missing(f).cast("long")), test)


def select(df: DataFrame, selector) -> DataFrame:
    return df.select(*[quoted(c) for c in make_selector(selector).expand(df)])


def drop(df: DataFrame, selector) -> DataFrame:
    return select(df, inv(selector))
