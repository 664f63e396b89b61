"""Fit-time statistics: many requests, few aggregate jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of a rank sketch, and distinct values that a bracket may bring to the driver.
ACCURACY, BRACKET_VALUES = 10_000, 100_000


@dataclass(frozen=True)
class Quantiles:
    """A request for exact quantiles of a column of numbers, nulls left out.

    ``nearest`` takes the value of the nearest rank (half to even); else two
    ranks are interpolated.
    """

    column: Column
    probabilities: tuple[float, ...]
    nearest: bool = False


def profile(df: DataFrame, exprs: dict[str, Column | Quantiles]) -> dict[str, object]:
    """Named statistics: plain aggregates in one job, quantiles in two or three more."""
    plain = {k: e for k, e in exprs.items() if not isinstance(e, Quantiles)}
    ranked = {k: e for k, e in exprs.items() if isinstance(e, Quantiles)}
    out: dict[str, object] = {}
    if plain:
        row = df.agg(*[e.alias(f"s{j}") for j, e in enumerate(plain.values())]).first()
        out = {k: row[f"s{j}"] for j, k in enumerate(plain)}
    return out | exact_quantiles(df, ranked) if ranked else out


def exact_quantiles(df: DataFrame, requests: dict[str, Quantiles]) -> dict[str, list[float] | None]:
    """Exact order statistics without sorting a column or holding it in one task.

    A mergeable rank sketch puts each wanted rank between two values; the next
    job counts what lies below and inside each such bracket.  A bracket that
    still holds many distinct values is narrowed by a sketch of its own, about
    ``ACCURACY``-fold a round; then its few distinct values are counted and
    walked on the driver.
    """
    names = list(requests)
    frame = df.select(*[requests[k].column.cast("double").alias(f"x{j}") for j, k in enumerate(names)])
    step = 2.0 / ACCURACY
    first = []
    for j, k in enumerate(names):
        at = sorted({min(1.0, max(0.0, p + e)) for p in requests[k].probabilities for e in (-step, step)})
        first += [F.count(f"x{j}").alias(f"n{j}"), F.percentile_approx(f"x{j}", F.array(*[F.lit(p) for p in at]), ACCURACY).alias(f"q{j}"), F.min(f"x{j}").alias(f"a{j}"), F.max(f"x{j}").alias(f"b{j}")]
    row = frame.agg(*first).first()
    wanted: dict[tuple[int, int], list[float]] = {}  # (column, rank) -> bracket
    for j, k in enumerate(names):
        n = row[f"n{j}"]
        if not n:
            continue
        at = sorted({min(1.0, max(0.0, p + e)) for p in requests[k].probabilities for e in (-step, step)})
        sketch = dict(zip(at, row[f"q{j}"], strict=True))
        for p in requests[k].probabilities:
            # With few rows the whole column is the bracket; with many, the margin is many ranks wide.
            low = row[f"a{j}"] if p - step <= 0 or n <= BRACKET_VALUES else sketch[max(0.0, p - step)]
            high = row[f"b{j}"] if p + step >= 1 or n <= BRACKET_VALUES else sketch[min(1.0, p + step)]
            for rank in _ranks(p, n, requests[k].nearest)[0]:
                known = wanted.setdefault((j, rank), [low, high])
                wanted[j, rank] = [min(known[0], low), max(known[1], high)]
    values = _walked(frame, wanted)
    out: dict[str, list[float] | None] = {}
    for j, k in enumerate(names):
        if not row[f"n{j}"]:
            out[k] = None
            continue
        out[k] = []
        for p in requests[k].probabilities:
            ranks, share = _ranks(p, row[f"n{j}"], requests[k].nearest)
            low, high = values[j, ranks[0]], values[j, ranks[-1]]
            out[k].append(low if low == high else low + share * (high - low))
    return out


def _ranks(p: float, n: int, nearest: bool) -> tuple[tuple[int, ...], float]:
    at = p * (n - 1)
    if nearest:
        return (round(at),), 0.0
    low = math.floor(at)
    return ((low,), 0.0) if low == at else ((low, low + 1), at - low)


def _walked(frame: DataFrame, wanted: dict[tuple[int, int], list[float]]) -> dict[tuple[int, int], float]:
    """The value of every wanted rank, which lies in its bracket."""
    found: dict[tuple[int, int], float] = {}
    while wanted:
        open_ = sorted({(j, *bracket) for (j, _), bracket in wanted.items()})
        asked = []
        for b, (j, low, high) in enumerate(open_):
            x = F.col(f"x{j}")
            inside = F.when((x >= low) & (x <= high), x)
            asked += [F.count(F.when(x < low, 1)).alias(f"below{b}"), F.approx_count_distinct(inside, 0.05).alias(f"distinct{b}")]
            asked.append(F.percentile_approx(inside, F.array(*[F.lit(i / 64) for i in range(1, 64)]), ACCURACY).alias(f"cuts{b}"))
        row = frame.agg(*asked).first()
        narrow = [b for b in range(len(open_)) if row[f"distinct{b}"] <= BRACKET_VALUES]
        if narrow:
            cells = [F.when((F.col(f"x{j}") >= low) & (F.col(f"x{j}") <= high), F.struct(F.lit(b).alias("b"), F.col(f"x{j}").alias("x"))) for b, (j, low, high) in enumerate(open_) if b in narrow]
            counted = frame.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.b", "c.x").agg(F.count(F.lit(1)).alias("n")).collect()  # at most BRACKET_VALUES a bracket
            by: dict[int, list] = {}
            for r in counted:
                by.setdefault(r["b"], []).append((r["x"], r["n"]))
            for b in narrow:
                j, low, high = open_[b]
                ranks = sorted(rank for (c, rank), bracket in wanted.items() if c == j and bracket == [low, high])
                upto, left = row[f"below{b}"], iter(ranks)
                rank = next(left, None)
                for x, n in sorted(by.get(b, [])):
                    upto += n
                    while rank is not None and rank < upto:
                        found[j, rank] = x
                        rank = next(left, None)
                for rank in ranks:
                    del wanted[j, rank]
        for b in set(range(len(open_))) - set(narrow):
            j, low, high = open_[b]
            edges = sorted({low, *row[f"cuts{b}"], high})
            counts = frame.agg(*[F.count(F.when(F.col(f"x{j}") <= e, 1)).alias(f"c{i}") for i, e in enumerate(edges)]).first()
            for (c, rank), bracket in list(wanted.items()):
                if c == j and bracket == [low, high]:
                    i = next(i for i in range(len(edges)) if counts[f"c{i}"] > rank)
                    wanted[c, rank] = [edges[max(0, i - 1)], edges[i]]
    return found


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """Distinct non-null values of each column, by text: one job, partly counted before its shuffle.

    Values are stacked and grouped by column and value, which costs a row for a
    value and task where many ``count(distinct)`` at once copy every row.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(j).alias("j"), c.cast("string").alias("v")) for j, c in enumerate(columns.values())])
    stacked = df.select(F.explode(cells).alias("c")).select("c.j", "c.v").where("v is not null")
    rows = stacked.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("j").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a column
    found = {r["j"]: r["n"] for r in rows}
    return {name: found.get(j, 0) for j, name in enumerate(columns)}


def distinct_values(df: DataFrame, column: Column, most: int) -> list:
    """The sorted distinct non-null values, refused above ``most`` before they travel."""
    rows = df.select(column.alias("v")).where("v is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values")
    return sorted(r["v"] for r in rows)
