"""Joins and aggregate-then-join operators."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.storage import durable
from tablewright.types import fresh_names, is_numeric, no_nan, quoted

OPERATIONS = ("count", "min", "max", "sum", "mean", "std", "median", "mode")
NUMERIC_ONLY = ("sum", "mean", "std", "median")


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def check_keys(main: DataFrame, aux: DataFrame, key=None, main_key=None, aux_key=None) -> tuple[list[str], list[str]]:
    """Key columns of both sides from ``key``, or ``main_key`` with ``aux_key``."""
    if key is not None:
        if main_key is not None or aux_key is not None:
            raise ValueError("give either key, or main_key and aux_key")
        main_key = aux_key = key
    if main_key is None or aux_key is None:
        raise ValueError("give key, or both main_key and aux_key")
    left, right = _listed(main_key), _listed(aux_key)
    if len(left) != len(right):
        raise ValueError("the keys of both tables must be equally many")
    for frame, names in ((main, left), (aux, right)):
        absent = [c for c in names if c not in frame.columns]
        if absent:
            raise ValueError(f"columns not found: {absent}")
    return left, right


def left_join(left: DataFrame, right: DataFrame, left_on, right_on, rename_right: str = "{}") -> DataFrame:
    """All left rows with the columns of matching right rows.

    Right keys are dropped, other right columns renamed by ``rename_right`` and,
    where a name is taken, tagged ``__dup_<n>``.  Null keys match nothing.
    Repeated right keys repeat the left row.
    """
    left_on, right_on = check_keys(left, right, None, left_on, right_on)
    kept = [c for c in right.columns if c not in right_on]
    names = fresh_names([rename_right.format(c) for c in kept], left.columns)
    keys = [f"__key_{j}" for j in range(len(right_on))]
    slim = right.select(*[quoted(c).alias(k) for c, k in zip(right_on, keys, strict=True)], *[quoted(c).alias(n) for c, n in zip(kept, names, strict=True)])
    condition = [left[f"`{a}`"] == slim[k] for a, k in zip(left_on, keys, strict=True)]
    return left.join(slim, condition, "left").drop(*keys)


def _aggregate_column(operation: str, column: Column) -> Column:
    return {
        "count": lambda c: F.count(c),
        "min": F.min,
        "max": F.max,
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "mean": F.avg,
        "std": F.stddev_samp,
        "median": F.median,
        "mode": lambda c: F.mode(c, True),
    }[operation](column)


def check_operations(operations) -> list[str]:
    operations = _listed(operations)
    wrong = [o for o in operations if o not in OPERATIONS]
    if wrong or not operations:
        raise ValueError(f"operations must be among {OPERATIONS}, got {operations}")
    return operations


def aggregate(table: DataFrame, key, cols=None, operations=("mean",), suffix: str = "") -> DataFrame:
    """One row per key: ``{col}_{operation}{suffix}`` for all columns and operations.

    Nulls and NaN are skipped; the sum of nothing is 0; the least of equally
    frequent values is the mode.  Columns not needed are pruned before the
    shuffle and groups are partly aggregated before it.
    """
    key = _listed(key)
    operations = check_operations(operations)
    cols = [c for c in table.columns if c not in key] if cols is None else _listed(cols)
    absent = [c for c in key + cols if c not in table.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    fields = {f.name: f for f in table.schema}
    for c in cols:
        bad = [o for o in operations if o in NUMERIC_ONLY and not is_numeric(fields[c])]
        if bad:
            raise ValueError(f"operations {bad} need numbers; column {c!r} holds {fields[c].dataType.simpleString()}")
    exprs = [_aggregate_column(o, no_nan(fields[c])).alias(f"{c}_{o}{suffix}") for c in cols for o in operations]
    return table.groupBy(*[quoted(k) for k in key]).agg(*exprs)


class AggJoiner:
    """Aggregate an auxiliary table by key and left-join it to the main table.

    ``aux_table="X"`` aggregates the main table itself.  ``fit`` only plans; the
    aggregate runs with the action on the joined result.
    """

    def __init__(self, aux_table, operations, *, key=None, main_key=None, aux_key=None, cols=None, suffix: str = ""):
        self.aux_table, self.operations, self.cols, self.suffix = aux_table, operations, cols, suffix
        self.key, self.main_key, self.aux_key = key, main_key, aux_key

    def fit(self, X: DataFrame) -> AggJoiner:
        aux = X if isinstance(self.aux_table, str) and self.aux_table == "X" else self.aux_table
        if not isinstance(aux, DataFrame):
            raise TypeError('aux_table must be a DataFrame or "X"')
        self.main_keys_, self.aux_keys_ = check_keys(X, aux, self.key, self.main_key, self.aux_key)
        cols = [c for c in aux.columns if c not in self.aux_keys_] if self.cols is None else _listed(self.cols)
        self.aggregated_ = aggregate(aux, self.aux_keys_, cols, self.operations, self.suffix)
        self.columns_ = list(X.columns)
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        check_columns(X, self.columns_)
        return left_join(X, self.aggregated_, self.main_keys_, self.aux_keys_)

    def fit_transform(self, X: DataFrame) -> DataFrame:
        return self.fit(X).transform(X)


class MultiAggJoiner:
    """Several :class:`AggJoiner` one after the other; suffixes default to ``_0``, ``_1``..."""

    def __init__(self, aux_tables, operations, *, keys=None, main_keys=None, aux_keys=None, cols=None, suffixes=None):
        n = len(aux_tables)
        suffixes = [f"_{j}" for j in range(n)] if suffixes is None else suffixes
        per_table = {"operations": operations, "keys": keys, "main_keys": main_keys, "aux_keys": aux_keys, "cols": cols, "suffixes": suffixes}
        for name, value in per_table.items():
            if value is not None and (isinstance(value, str) or len(value) != n):
                raise ValueError(f"{name} must be a list with an entry for each of the {n} tables")
        pick = lambda value, j: None if value is None else value[j]
        self.joiners = [
            AggJoiner(t, operations[j], key=pick(keys, j), main_key=pick(main_keys, j), aux_key=pick(aux_keys, j), cols=pick(cols, j), suffix=suffixes[j]) for j, t in enumerate(aux_tables)
        ]

    def fit(self, X: DataFrame) -> MultiAggJoiner:
        self.fit_transform(X)
        return self

    def fit_transform(self, X: DataFrame) -> DataFrame:
        for joiner in self.joiners:
            X = joiner.fit_transform(X)
        return X

    def transform(self, X: DataFrame) -> DataFrame:
        for joiner in self.joiners:
            X = joiner.transform(X)
        return X


class AggTarget:
    """Aggregate a target column of the training table by key and join it back."""

    def __init__(self, main_key, operations, target: str, suffix: str = "_target"):
        self.main_key, self.operations, self.target, self.suffix = _listed(main_key), operations, target, suffix

    def fit(self, X: DataFrame) -> AggTarget:
        self.aggregated_ = aggregate(X, self.main_key, [self.target], self.operations, self.suffix)
        return self

    def transform(self, X: DataFrame) -> DataFrame:
        return left_join(X, self.aggregated_, self.main_key, self.main_key)

    def fit_transform(self, X: DataFrame) -> DataFrame:
        return self.fit(X).transform(X)


def check_input(df: DataFrame, fitted: T.StructType | None = None) -> DataFrame:
    """``df`` if it is a frame with distinct names and, after a fit, the fit's columns and types.

    Other names, another order and repeated names raise; another type warns,
    since a cast may be what the caller wants.
    """
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"repeated column names: {repeated}")
    if fitted is not None:
        check_columns(df, fitted.names)
        other = [f"{f.name}: {f.dataType.simpleString()}, at fit {fitted[f.name].dataType.simpleString()}" for f in df.schema if f.dataType != fitted[f.name].dataType]
        if other:
            warnings.warn(f"column types differ from those of the fit: {'; '.join(other)}", stacklevel=2)
    return df


def check_columns(df: DataFrame, expected: list[str]) -> None:
    """Raise unless ``df`` has the columns of the fit, in the same order."""
    if df.columns != expected:
        new, gone = [c for c in df.columns if c not in expected], [c for c in expected if c not in df.columns]
        raise ValueError(f"columns differ from those of the fit: new {new}, missing {gone}" if new or gone else "columns are in another order than at fit")


class SessionEncoder:
    """Number sessions of events: a new one after a gap of more than ``session_gap`` seconds.

    Ids count from 0 over all groups of ``split_by`` in key order; rows with a
    null time or key get -1.  Sessions are opened by a window over each group
    and numbered by prefix sums over counts per group.  Without ``split_by`` the
    time line is cut into ``bins`` ranges, each of which finds its own openings
    (the last time before a range comes from the ranges' maxima), so no task
    sees all events.  Events at the same time share a session.
    """

    def __init__(self, timestamp_col: str, split_by=None, session_gap: float = 1800, suffix: str = "session_id", bins: int = 256):
        if session_gap <= 0:
            raise ValueError("session_gap must be positive")
        self.timestamp_col, self.session_gap, self.suffix, self.bins = timestamp_col, session_gap, suffix, bins
        self.split_by = [] if split_by is None else _listed(split_by)

    def fit_transform(self, X: DataFrame) -> DataFrame:
        return self.transform(X)

    def transform(self, X: DataFrame) -> DataFrame:
        absent = [c for c in [self.timestamp_col, *self.split_by] if c not in X.columns]
        if absent:
            raise ValueError(f"columns not found: {absent}")
        name = fresh_names([f"{self.timestamp_col}_{self.suffix}"], X.columns)[0]
        time = F.unix_micros(quoted(self.timestamp_col).cast("timestamp"))
        known = quoted(self.timestamp_col).isNotNull()
        for c in self.split_by:
            known &= quoted(c).isNotNull()
        rows = X.withColumns({"__time": F.when(known, time)})
        groups = [f"__group_{j}" for j in range(len(self.split_by))]
        rows = rows.withColumns({g: F.when(known, quoted(c)) for g, c in zip(groups, self.split_by, strict=True)})
        gap = int(self.session_gap * 1_000_000)
        good, bad = rows.where("__time is not null"), rows.where("__time is null")
        if groups:
            numbered = self._by_group(good, groups, gap)
        else:
            numbered = self._by_range(good, gap)
        out = numbered.withColumn(name, F.col("__id").cast("long")).select(*[quoted(c) for c in X.columns], quoted(name))
        return out.union(bad.withColumn(name, F.lit(-1).cast("long")).select(*[quoted(c) for c in X.columns], quoted(name)))

    def _by_group(self, good: DataFrame, groups: list[str], gap: int) -> DataFrame:
        order = Window.partitionBy(*groups).orderBy("__time")
        opened = good.withColumn("__before", F.lag("__time").over(order)).withColumn(
            "__opens", (F.col("__before").isNull() | (F.col("__time") - F.col("__before") > gap)).cast("long")
        )
        inside = opened.withColumn("__within", F.sum("__opens").over(order) - 1)
        counts = inside.groupBy(*groups).agg(F.sum("__opens").alias("__sessions"))
        offsets = ranked_prefix(counts, groups, "__sessions", "__offset", self.bins)
        return inside.join(offsets, groups).withColumn("__id", F.col("__within") + F.col("__offset"))

    def _by_range(self, good: DataFrame, gap: int) -> DataFrame:
        cuts = good.agg(F.percentile_approx("__time", F.array(*[F.lit(j / self.bins) for j in range(1, self.bins)]), 10_000)).first()[0] or []
        cuts = sorted(set(cuts))
        place = F.lit(0)
        if cuts:  # a binary search in the sorted cuts, unrolled
            place = _bisect("__time", cuts)
        binned = good.withColumn("__bin", place)
        ends = binned.groupBy("__bin").agg(F.max("__time").alias("__end"))
        before = ends.select("__bin", F.lag("__end").over(Window.orderBy("__bin")).alias("__carry"))
        order = Window.partitionBy("__bin").orderBy("__time")
        opened = (
            binned.join(F.broadcast(before), "__bin")  # at most ``bins`` rows
            .withColumn("__before", F.coalesce(F.lag("__time").over(order), "__carry"))
            .withColumn("__opens", (F.col("__before").isNull() | (F.col("__time") - F.col("__before") > gap)).cast("long"))
        )
        inside = opened.withColumn("__within", F.sum("__opens").over(order) - 1)
        sums = inside.groupBy("__bin").agg(F.sum("__opens").alias("__n"))
        offsets = sums.select("__bin", F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
        return inside.join(F.broadcast(offsets), "__bin").withColumn("__id", F.col("__within") + F.col("__offset"))


def _bisect(column: str, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie at or below the column, by nested comparisons."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"if({column} < {cuts[mid]}L, {tree(low, mid)}, {tree(mid + 1, high)})"

    return F.expr(tree(0, len(cuts)))


def ranked_prefix(counts: DataFrame, keys: list[str], value: str, name: str, bins: int) -> DataFrame:
    """``keys`` with the sum of ``value`` over all smaller keys, in two levels.

    Keys are dealt by range; the parts' sums are few, and each part sums its own
    keys.  The dealt table is written once, both levels read it.
    """
    dealt = durable(counts.repartitionByRange(bins, *keys).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "__part").select(*keys, (F.col("__own") + F.col("__start")).alias(name))  # a row per part


