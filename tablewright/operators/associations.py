"""How strongly columns go together: Cramer's V and Pearson's r of all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.primitives import pearson, total_seconds
from tablewright.stats import distinct_counts, profile
from tablewright.types import classify, is_numeric, no_nan, quoted

N_BINS = 10
CATEGORIES = 30


def _levels(df: DataFrame) -> DataFrame:
    """Every column as a small integer level, in one projection.

    Numbers and times with at least 30 values: nine equal ranges and one level
    for missing or infinite values, whose place in the range is taken as 0; all
    else: the nine commonest values (null is one) and one level for the others,
    or a level each if there are at most ten.
    """
    fields = list(df.schema)
    numbers = {f.name: _as_number(f) for f in fields if is_numeric(f) or classify(f) in ("date", "duration")}
    finite = {c: F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0)) for c, x in numbers.items()}
    asked: dict[str, Column] = {}
    for c, x in numbers.items():
        asked |= {f"{c}\0min": F.min(finite[c]), f"{c}\0max": F.max(finite[c])}
    stats = profile(df, asked)
    distinct = distinct_counts(df, numbers)
    binned = {c for c in numbers if distinct[c] >= CATEGORIES}
    texts = [f for f in fields if f.name not in binned]
    top: dict[str, list] = {}
    if texts:
        pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _as_text(f).alias("value"), numbers.get(f.name, F.lit(None)).cast("double").alias("number")) for j, f in enumerate(texts)]))
        counts = df.select(pairs.alias("p")).select("p.*").groupBy("j", "value", "number").agg(F.count(F.lit(1)).alias("n"))
        order = (F.desc("n"), F.desc("number"), F.desc("value"))  # of equals, the larger
        # The leaders of 64 parts of a column's values first, then those of the column.
        part = counts.withColumn("part", F.pmod(F.xxhash64("value", "number"), F.lit(64)))
        leaders = part.withColumn("rank", F.row_number().over(Window.partitionBy("j", "part").orderBy(*order))).where(F.col("rank") <= N_BINS + 1)
        for r in leaders.withColumn("rank", F.row_number().over(Window.partitionBy("j").orderBy(*order))).where(F.col("rank") <= N_BINS + 1).collect():
            top.setdefault(texts[r["j"]].name, []).append((r["rank"], r["value"]))
    out = []
    for f in fields:
        if f.name in binned:
            low, high = stats[f"{f.name}\0min"], stats[f"{f.name}\0max"]
            x = numbers[f.name]
            place = F.least(F.floor((x - low) / ((high - low) / (N_BINS - 1))), F.lit(N_BINS - 2))
            level = F.when(F.abs(x) < float("inf"), place).otherwise(N_BINS - 1) if high > low else F.lit(0)
        else:
            values = [v for _, v in sorted(top.get(f.name, []), key=lambda p: p[0])]
            kept = values if len(values) <= N_BINS else values[: N_BINS - 1]
            level = F.lit(N_BINS - 1)
            for j, v in reversed(list(enumerate(kept))):
                level = F.when(_as_text(f).eqNullSafe(F.lit(v)), j).otherwise(level)
        out.append(level.cast("int").alias(f"c{len(out)}"))
    return df.select(*out)


def _as_number(field) -> Column:
    return total_seconds(field) if classify(field) in ("date", "duration") else no_nan(field).cast("double")


def _as_text(field) -> Column:
    c = no_nan(field)
    return F.to_json(c) if classify(field) == "nested" else c.cast("string")


def contingency(df: DataFrame) -> DataFrame:
    """``(i, j, a, b, n)`` over all pairs of columns i < j of small levels.

    A row's levels as a 0/1 vector, the products of these vectors summed by
    matrix multiplication: each task reports one table of counts, whatever its
    rows, and the tables are added by cell.
    """
    names = df.columns
    width = N_BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) * width, len(names) * width), np.int64)
        shift = np.arange(len(names)) * width
        for batch in batches:
            levels = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(len(names))], axis=1)
            for low in range(0, len(levels), 4096):
                some = levels[low : low + 4096] + shift
                one = np.zeros((len(some), len(total)), np.float32)
                np.put_along_axis(one, some, 1.0, axis=1)
                total += np.rint(one.T @ one).astype(np.int64)
        x, y = np.nonzero(total)
        x, y = x[x // width < y // width], y[x // width < y // width]
        yield pa.RecordBatch.from_pydict({"i": (x // width).astype(np.int32), "j": (y // width).astype(np.int32), "a": (x % width).astype(np.int32), "b": (y % width).astype(np.int32), "n": total[x, y]})

    return df.mapInArrow(run, "i int, j int, a int, b int, n long").groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))


def column_associations(df: DataFrame, compute_pearson: bool = True) -> DataFrame:
    """One row per pair of columns: names, indices, cramer_v[, pearson_corr]; strongest first.

    Chi-square over n is the sum of n_ab^2 / (n_a n_b), minus 1.
    """
    spark, names = df.sparkSession, df.columns
    schema = "left_column_name string, left_column_idx int, right_column_name string, right_column_idx int, cramer_v double"
    if len(names) < 2:
        return spark.createDataFrame([], schema + (", pearson_corr double" if compute_pearson else ""))
    cells = contingency(_levels(df))
    pair = Window.partitionBy("i", "j")
    sums = cells.withColumns({"na": F.sum("n").over(Window.partitionBy("i", "j", "a")), "nb": F.sum("n").over(Window.partitionBy("i", "j", "b")), "all": F.sum("n").over(pair)})
    v = sums.groupBy("i", "j").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")
    )
    least = F.least("ka", "kb") - 1
    strength = F.when(least > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / F.greatest(least, F.lit(1)))).otherwise(0.0)
    label = F.array(*[F.lit(c) for c in names])
    out = v.select(
        F.get(label, F.col("i")).alias("left_column_name"), F.col("i").alias("left_column_idx"), F.get(label, F.col("j")).alias("right_column_name"),
        F.col("j").alias("right_column_idx"), strength.alias("cramer_v"),
    )
    if compute_pearson:
        number = [j for j, f in enumerate(df.schema) if is_numeric(f)]
        pairs = [(i, j) for i in number for j in number if i < j]
        values = profile(df, {f"{i},{j}": pearson(df, names[i], names[j]) for i, j in pairs})
        table = spark.createDataFrame([(i, j, values[f"{i},{j}"]) for i, j in pairs], "left_column_idx int, right_column_idx int, pearson_corr double")
        out = out.join(F.broadcast(table), ["left_column_idx", "right_column_idx"], "left").select(  # a row per pair of columns
            "left_column_name", "left_column_idx", "right_column_name", "right_column_idx", "cramer_v", "pearson_corr"
        )
    return out.orderBy(F.desc("cramer_v"), "left_column_idx", "right_column_idx")


class DropSimilar:
    """Drop the right column of every pair whose Cramer's V reaches ``threshold``."""

    def __init__(self, threshold: float = 1.0):
        if not 0 <= threshold <= 1 or math.isnan(threshold):
            raise ValueError("threshold must lie between 0 and 1")
        self.threshold = threshold

    def fit(self, df: DataFrame) -> DropSimilar:
        rows = column_associations(df, compute_pearson=False).where(F.col("cramer_v") >= self.threshold - 1e-12).collect()
        self.to_drop_ = sorted({r["right_column_name"] for r in rows}, key=df.columns.index)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[quoted(c) for c in df.columns if c not in self.to_drop_])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
