"""Nearest-neighbour joins on strings, numbers and times, and merging of typos."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.primitives import total_seconds
from tablewright.functions.strings import grams_of
from tablewright.operators.relational import check_keys
from tablewright.stats import profile
from tablewright.storage import durable
from tablewright.types import classify, fresh_names, is_numeric, no_nan, quoted

#: Auxiliary rows up to which an index of all of them goes to every task.
BROADCAST_ROWS = 20_000
#: Main rows of a unit of work against a block of ``BROADCAST_ROWS`` auxiliary rows.
MAIN_ROWS = 50_000
#: Auxiliary rows above which a gram is too common to be joined on first.
COMMON = 2_000


@dataclass(frozen=True)
class RandomPairs:
    """Reference: a percentile of the distances of random pairs of auxiliary rows."""

    percentile: float = 25.0
    n_sampled_pairs: int = 500
    seed: int = 0


@dataclass(frozen=True)
class SelfJoinNeighbor:
    """Reference: the matched row's distance to its own n-th neighbour in the auxiliary table."""

    reference_neighbor: int = 1


@dataclass(frozen=True)
class OtherNeighbor:
    """Reference: the main row's distance to the n-th auxiliary row after its match."""

    reference_neighbor: int = 1


@dataclass(frozen=True)
class NoRescaling:
    """Distances count as they are; numbers keep their scale, too."""


REFERENCES = {"random_pairs": RandomPairs(), "second_neighbor": OtherNeighbor(), "self_join_neighbor": SelfJoinNeighbor(), "no_rescaling": NoRescaling()}


@dataclass(frozen=True)
class StringVectors:
    """How string keys become vectors: TF-IDF of the n-grams of an analyzer."""

    ngram_range: tuple[int, int] = (2, 4)
    analyzer: str = "char_wb"


class _Index:
    """Vectors of some auxiliary rows: numbers, and postings of weighted grams.

    The squared distance of two rows is that of their numbers, plus the string
    keys that are not empty on either side, minus twice the grams' product.
    """

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, grams: list[np.ndarray], weights: list[np.ndarray], filled: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.numbers, self.filled = ids[order], numbers[order], filled[order]
        self.vectors = [(grams[i], weights[i]) for i in order.tolist()]
        sizes = [len(g) for g, _ in self.vectors]
        flat = np.concatenate([g for g, _ in self.vectors]) if sum(sizes) else np.zeros(0, np.int64)
        by = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[by]
        self.weight = (np.concatenate([w for _, w in self.vectors]) if sum(sizes) else np.zeros(0))[by]
        self.grams, self.first = np.unique(flat[by], return_index=True)
        self.last = np.append(self.first[1:], len(flat))

    def distances(self, numbers: np.ndarray, grams: np.ndarray, weights: np.ndarray, filled: float) -> np.ndarray:
        d2 = ((self.numbers - numbers) ** 2).sum(axis=1) + self.filled + filled
        if len(grams) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            for i in np.flatnonzero(self.grams[at] == grams).tolist():
                low, high = self.first[at[i]], self.last[at[i]]
                d2[self.owner[low:high]] -= 2 * weights[i] * self.weight[low:high]
        return np.sqrt(np.maximum(np.round(d2, 9), 0.0))  # sums in another order still tie

    def nearest(self, k: int, *vector) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the ``k`` nearest rows, ties by id."""
        d = self.distances(*vector)
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k < len(d) else np.arange(len(d))
        best = some[np.lexsort((some, d[some]))[:k]]
        return best, d[best]

    def vector(self, at: int) -> tuple:
        return (self.numbers[at], *self.vectors[at], self.filled[at])


class _Line:
    """Auxiliary rows by their one number, and the first ``keep`` rows of each number.

    Distances are differences of the numbers as they stand, so equal ones tie and
    others do not; the nearest rows stand beside a number in sorted order.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, keep: int):
        order = np.lexsort((ids, values))
        ids, values = ids[order], values[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
        kept = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values)))) < keep
        self.ids, self.values, self.keep = ids[kept], values[kept], keep

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers and distances of the ``k`` (at most ``keep``) nearest rows of each number, ties by id; the distance is NaN where there is none."""
        parts = [self._nearest(x[low : low + 10_000], k) for low in range(0, max(1, len(x)), 10_000)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.ids)
        if not n:
            return np.full((len(x), k), -1), np.full((len(x), k), np.nan), np.full((len(x), k), np.nan)
        # Below, whole numbers until k rows are together: at most k - 1 rows and those of one number more.
        below = k - 1 + self.keep
        pos = np.searchsorted(self.values, x)
        at = pos[:, None] + np.arange(-below, k)
        held = (at >= 0) & (at < n)
        at = np.clip(at, 0, n - 1)
        d = np.where(held, _apart(self.values[at], x[:, None]), np.inf)
        ids = np.where(held, self.ids[at], np.iinfo(np.int64).max)
        best = np.lexsort((ids, d))[:, :k]
        at, d, held = (np.take_along_axis(a, best, 1) for a in (at, d, held))
        # Far numbers whose distances a double does not tell from the k-th.
        low, high = pos - below - 1, np.searchsorted(self.values, self.values[np.minimum(pos + k, n) - 1], "right")
        tied = (low >= 0) & (_apart(self.values[np.maximum(low, 0)], x) <= d[:, -1])
        tied |= (high < n) & (_apart(self.values[np.minimum(high, n - 1)], x) <= d[:, -1])
        for i in np.flatnonzero(tied).tolist():
            every = _apart(self.values, x[i])
            at[i] = np.lexsort((self.ids, every))[:k]
            d[i] = every[at[i]]
        return self.ids[at], self.values[at], np.where(held, d, np.nan)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(a == b, 0.0, np.abs(a - b))


class _Weights:
    """TF-IDF weights, of norm 1 within each key, of hashed grams that the auxiliary table knows."""

    def __init__(self, keys: np.ndarray, idf: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.idf = keys[order], idf[order]

    def of(self, lists) -> tuple[np.ndarray, np.ndarray, float]:
        """Grams and weights of one row's lists of hashes, a list a string key; keys not empty."""
        grams, weights, filled = [], [], 0.0
        for x in lists:
            g, tf = np.unique(np.asarray(x if x is not None else (), np.int64), return_counts=True)
            if not len(g) or not len(self.keys):
                continue
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            known = self.keys[at] == g
            if known.any():
                w = tf[known] * self.idf[at[known]]
                grams.append(g[known])
                weights.append(w / np.sqrt((w * w).sum()))
                filled += 1.0
        none = np.zeros(0, np.int64)
        return (np.concatenate(grams) if grams else none), (np.concatenate(weights) if weights else none.astype(float)), filled


class Joiner:
    """Left join of each row to its nearest auxiliary row.

    Keys become one Euclidean space: strings as L2-normed TF-IDF of n-grams
    (``string_encoder``), numbers and times scaled by the auxiliary table's mean
    and population deviation.  Grams that the auxiliary table does not hold
    count for nothing; a missing number counts as the mean.

    Up to ``BROADCAST_ROWS`` auxiliary rows are one index that every task holds:
    a transform is a projection and a join of the matched rows.  Beyond, a single
    number or time is looked up in its stretch of the sorted auxiliary rows (see
    :meth:`_stretched`), string keys meet through a join on their grams, rare
    ones first (see :meth:`_joined`), and other keys compare blocks of main rows
    with blocks of auxiliary rows; all are exact, at any size.

    A match counts when its distance over a reference distance (``ref_dist``, a
    name in ``REFERENCES`` or one of the reference classes) is at most
    ``max_dist``; else the auxiliary columns are null.  Ties go to the lowest
    auxiliary row in key order.
    """

    def __init__(
        self, aux_table: DataFrame, *, key=None, main_key=None, aux_key=None, suffix: str = "", max_dist: float | None = float("inf"), ref_dist="random_pairs",
        string_encoder: StringVectors | None = None, add_match_info: bool = True,
    ):
        if isinstance(ref_dist, str) and ref_dist not in REFERENCES or not isinstance(ref_dist, (str, *map(type, REFERENCES.values()))):
            raise ValueError(f"ref_dist must be one of {tuple(REFERENCES)} or a reference object")
        self.reference = REFERENCES[ref_dist] if isinstance(ref_dist, str) else ref_dist
        if getattr(self.reference, "reference_neighbor", 1) < 1 or getattr(self.reference, "n_sampled_pairs", 1) < 1:
            raise ValueError("numbers of neighbours and pairs must be positive")
        self.max_dist = float("inf") if max_dist is None else max_dist
        self.aux, self.suffix, self.info, self.strings = aux_table, suffix, add_match_info, string_encoder or StringVectors()
        self.keys = (key, main_key, aux_key)

    # --- key space ---

    def fit(self, X: DataFrame) -> Joiner:
        self.main_keys_, self.aux_keys_ = check_keys(X, self.aux, *self.keys)
        fields = [self.aux.schema[c] for c in self.aux_keys_]
        self.kinds_ = ["number" if is_numeric(f) else "time" if classify(f) == "date" else "string" for f in fields]
        ordered = self.aux.orderBy(*[quoted(c) for c in self.aux_keys_], *[quoted(f.name) for f in self.aux.schema if classify(f) != "nested" and f.name not in self.aux_keys_])
        self.aux_ = durable(ordered.withColumn("__aux", F.monotonically_increasing_id()))  # in key order
        numbers = [(c, k) for c, k in zip(self.aux_keys_, self.kinds_, strict=True) if k != "string"]
        asked = {c: F.struct(F.avg(self._number(self.aux_, c, k)), F.stddev_pop(self._number(self.aux_, c, k))) for c, k in numbers}
        stats = profile(self.aux_, asked | {None: F.count(F.lit(1))})
        self.n_ = stats.pop(None)
        rescaled = not isinstance(self.reference, NoRescaling)
        self.scales_ = {c: ((v[0] or 0.0), (v[1] or 1.0)) if rescaled else (0.0, 1.0) for c, v in stats.items()}
        self.small_ = self.n_ <= BROADCAST_ROWS
        self.line_ = len(self.kinds_) == 1 and self.kinds_[0] != "string"
        if self.line_:
            self._fit_line()
            return self
        vectors = self._vectors(self.aux_, self.aux_keys_, "__aux")
        if self.small_:
            rows = vectors.orderBy("__aux").collect()  # at most BROADCAST_ROWS
            lists = [[x for x in r["grams"]] for r in rows]
            held, df = np.unique(np.concatenate([np.unique(np.asarray(x, np.int64)) for r in lists for x in r] or [np.zeros(0, np.int64)]), return_counts=True)
            self.weights_ = _Weights(held, np.log((1.0 + self.n_) / (1.0 + df)) + 1.0)
            self.index_ = self._indexed([r["__aux"] for r in rows], [r["numbers"] for r in rows], [self.weights_.of(x) for x in lists])
        else:
            grams = vectors.select("__aux", F.explode(F.flatten("grams")).alias("gram")).distinct()
            self.df_ = durable(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
            self.vectors_ = durable(self._weighted(vectors, "__aux"))
        self.reference_ = self._random_reference() if isinstance(self.reference, RandomPairs) else None
        return self

    def _fit_line(self) -> None:
        reference = self.reference
        self.k_ = reference.reference_neighbor + 1 if isinstance(reference, OtherNeighbor) else 1
        self.keep_ = reference.reference_neighbor + 1 if isinstance(reference, (OtherNeighbor, SelfJoinNeighbor)) else 1
        rows = self.aux_.select("__aux", self._place(self.aux_, self.aux_keys_[0]).alias("place"))
        if self.small_:
            held = rows.toPandas()  # at most BROADCAST_ROWS
            self.index_ = _Line(held["__aux"].to_numpy(np.int64), held["place"].to_numpy(float), self.keep_)
        else:
            first = Window.partitionBy("place").orderBy("__aux")
            self.places_ = durable(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= self.keep_).select("__aux", "place"))
        self.reference_ = None
        if isinstance(reference, RandomPairs):
            some = held.sort_values("__aux") if self.small_ else rows.orderBy(F.xxhash64("__aux"), "__aux").limit(4 * reference.n_sampled_pairs).toPandas().sort_values("__aux")
            left, right = self._random_pairs(len(some))
            x = some["place"].to_numpy(float) / self.scales_[self.aux_keys_[0]][1]
            self.reference_ = float(np.percentile(_apart(x[left], x[right]), reference.percentile))

    def _place(self, df: DataFrame, column: str) -> Column:
        """The only key as a number, the mean where it is missing."""
        return F.coalesce(self._number(df, column, self.kinds_[0]), F.lit(float(self.scales_[self.aux_keys_[0]][0])))

    def _indexed(self, ids, numbers, weighted) -> _Index:
        width = sum(k != "string" for k in self.kinds_)
        matrix = np.array(numbers, float).reshape(len(ids), width)
        return _Index(np.array(ids, np.int64), matrix, [g for g, _, _ in weighted], [w for _, w, _ in weighted], np.array([f for _, _, f in weighted], float))

    @staticmethod
    def _number(df: DataFrame, column: str, kind: str) -> Column:
        field = df.schema[column]
        return total_seconds(field) if kind == "time" else no_nan(field).cast("double")

    def _key_vectors(self, df: DataFrame, keys: list[str]) -> tuple[Column, Column]:
        """Hashed grams, a list for each string key (the key's place hashed along), and scaled numbers."""
        grams, parts = [], []
        for j, (c, aux, kind) in enumerate(zip(keys, self.aux_keys_, self.kinds_, strict=True)):
            if kind == "string":
                grams.append(F.transform(grams_of(quoted(c).cast("string"), self.strings.analyzer, *self.strings.ngram_range), _tagged(j)))
            else:
                mean, scale = self.scales_[aux]
                parts.append(F.coalesce((self._number(df, c, kind) - mean) / scale, F.lit(0.0)))
        return (F.array(*grams) if grams else F.array().cast("array<array<long>>")), F.array(*parts).cast("array<double>")

    def _vectors(self, df: DataFrame, keys: list[str], row: str) -> DataFrame:
        grams, numbers = self._key_vectors(df, keys)
        return df.select(row, grams.alias("grams"), numbers.alias("numbers"))

    def _weighted(self, vectors: DataFrame, row: str) -> DataFrame:
        """``(row, numbers, filled, grams: list of (gram, w))`` with weights of norm 1 within each key."""
        each = vectors.select(row, F.posexplode("grams").alias("key", "own")).select(row, "key", F.explode("own").alias("gram"))
        raw = each.groupBy(row, "key", "gram").agg(F.count(F.lit(1)).alias("tf")).join(self.df_, "gram")
        raw = raw.withColumn("w", F.col("tf") * (F.log((1.0 + self.n_) / (1.0 + F.col("df"))) + 1.0))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row, "key")))
        lists = raw.withColumn("w", F.col("w") / norm).groupBy(row).agg(F.count_distinct("key").alias("filled"), F.collect_list(F.struct("gram", "w", "df")).alias("weights"))
        return vectors.select(row, "numbers").join(lists, row, "left").withColumn("filled", F.coalesce("filled", F.lit(0)).cast("double"))

    def _random_pairs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n < 2:
            raise ValueError("random pairs need at least two auxiliary rows")
        rng = np.random.default_rng(self.reference.seed)
        left = rng.integers(0, n, self.reference.n_sampled_pairs)
        return left, (left + rng.integers(1, n, self.reference.n_sampled_pairs)) % n

    def _random_reference(self) -> float:
        index = self.index_ if self.small_ else self._sampled(4 * self.reference.n_sampled_pairs)
        left, right = self._random_pairs(len(index.ids))
        out = []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            (x, g, u, f), (y, h, v, e) = index.vector(a), index.vector(b)
            _, i, j = np.intersect1d(g, h, return_indices=True)
            out.append(np.sqrt(max(0.0, ((x - y) ** 2).sum() + f + e - 2 * (u[i] * v[j]).sum())))
        return float(np.percentile(out, self.reference.percentile))

    def _sampled(self, rows: int) -> _Index:
        """A few rows of least hash as an index of their own."""
        return _index_of(self.vectors_.orderBy(F.xxhash64("__aux"), "__aux").limit(rows).toPandas(), "__aux")

    # --- neighbours ---

    def _matched(self, X: DataFrame) -> DataFrame:
        """``X`` with ``__near``: the auxiliary row, its distance, the reference distance."""
        spark, reference = X.sparkSession, self.reference
        held = spark.sparkContext.broadcast((self.index_, self.weights_))
        k = reference.reference_neighbor + 1 if isinstance(reference, OtherNeighbor) else 1
        fixed = self.reference_ if isinstance(reference, RandomPairs) else 1.0 if isinstance(reference, NoRescaling) else None

        @F.pandas_udf("aux long, d double, ref double")
        def near(grams: pd.Series, numbers: pd.Series) -> pd.DataFrame:
            index, weights = held.value
            out, own = [], {}
            for lists, x in zip(grams, numbers, strict=True):
                if not len(index.ids):
                    out.append((None, None, None))
                    continue
                at, d = index.nearest(k, np.asarray(x, float), *weights.of(lists))
                ref = fixed
                if isinstance(reference, OtherNeighbor):
                    ref = d[-1] if len(d) == k else None
                elif isinstance(reference, SelfJoinNeighbor):
                    if at[0] not in own:
                        _, e = index.nearest(reference.reference_neighbor + 1, *index.vector(at[0]))
                        own[at[0]] = e[-1] if len(e) == reference.reference_neighbor + 1 else None
                    ref = own[at[0]]
                out.append((index.ids[at[0]], d[0], ref))
            return pd.DataFrame(out, columns=["aux", "d", "ref"])

        # Vectors are named twice, hence a projection of their own; the function is called once a row.
        grams, numbers = self._key_vectors(X, self.main_keys_)
        ready = X.withColumns({"__grams": grams, "__numbers": numbers})
        twice = lambda c: F.when(F.col(c).isNotNull(), F.col(c))
        return ready.withColumn("__near", near.asNondeterministic()(twice("__grams"), twice("__numbers")))

    def _line_near(self):
        """``(index, numbers) -> aux, d, ref`` of each number, for a join on one number or time."""
        k, reference, scale = self.k_, self.reference, self.scales_[self.aux_keys_[0]][1]
        fixed = 1.0 if self.reference_ is None else self.reference_

        def near(index: _Line, x: np.ndarray) -> pd.DataFrame:
            ids, values, d = index.nearest(x, k)
            ref = np.full(len(x), fixed)
            if isinstance(reference, OtherNeighbor):
                ref = d[:, -1] / scale
            elif isinstance(reference, SelfJoinNeighbor):
                own, place = np.unique(values[:, 0], return_inverse=True)
                ref = (index.nearest(own, reference.reference_neighbor + 1)[2][:, -1] / scale)[place]
            met = ~np.isnan(d[:, 0])
            columns = {"aux": pd.array(ids[:, 0], "Int64"), "d": pd.array(d[:, 0] / scale, "Float64"), "ref": pd.array(ref, "Float64")}
            out = pd.DataFrame(columns)
            out.loc[~met, ["aux", "d", "ref"]] = pd.NA
            out.loc[np.isnan(ref), "ref"] = pd.NA
            return out

        return near

    def _on_line(self, X: DataFrame) -> DataFrame:
        """``X`` with ``__near``, of an index that every task holds."""
        held, near = X.sparkSession.sparkContext.broadcast(self.index_), self._line_near()

        @F.pandas_udf("aux long, d double, ref double")
        def found(place: pd.Series) -> pd.DataFrame:
            return near(held.value, place.to_numpy(float))

        ready = X.withColumn("__place", self._place(X, self.main_keys_[0]))
        return ready.withColumn("__near", found.asNondeterministic()(F.when(F.col("__place").isNotNull(), F.col("__place"))))

    def _stretched(self, numbered: DataFrame) -> DataFrame:
        """``(__main, __near)``: each main row looks into its stretch of the sorted auxiliary rows.

        Stretches hold about ``BROADCAST_ROWS`` auxiliary rows, of each number the
        first few only, and some rows of those beside them; main rows of a stretch
        are dealt out by ``MAIN_ROWS``.
        """
        near, keep = self._line_near(), self.keep_
        n = -(-self.places_.count() // BROADCAST_ROWS)
        asked = F.percentile_approx("place", F.array(*[F.lit(i / n) for i in range(1, n)]), max(10_000, 20 * n)) if n > 1 else F.array().cast("array<double>")
        cuts = np.unique(self.places_.agg(asked).first()[0] or [])
        stretch = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("place"))).cast("int")
        points = self.places_.withColumn("stretch", stretch)
        main = numbered.select("__main", self._place(numbered, self.main_keys_[0]).alias("place")).withColumn("stretch", stretch)

        # Rows that lie next to a stretch: a match is at most 2 * keep rows away, and its own neighbours as many more.
        width = 4 * keep

        def ends(frame: pd.DataFrame) -> pd.DataFrame:
            ordered = frame.sort_values(["place", "__aux"])
            return ordered if len(ordered) <= 2 * width else pd.concat([ordered.iloc[:width], ordered.iloc[-width:]])

        edge = points.groupBy("stretch").applyInPandas(ends, points.schema).toPandas().sort_values(["place", "__aux"])  # a few rows a stretch
        lowest = self.places_.orderBy("__aux").limit(keep).toPandas()  # ties without end, as of an infinite number
        at = edge["stretch"].to_numpy()
        beside = {}
        for j in range(len(cuts) + 1):
            rows = pd.concat([edge[at < j].iloc[-width:], edge[at > j].iloc[:width], lowest])[["__aux", "place"]]
            beside[j] = rows["__aux"].to_numpy(np.int64), rows["place"].to_numpy(float)
        margins = numbered.sparkSession.sparkContext.broadcast(beside)

        sizes = {r["stretch"]: r["count"] for r in main.groupBy("stretch").count().collect()}  # a row a stretch
        parts = F.get(F.array(*[F.lit(max(1, -(-sizes.get(j, 0) // MAIN_ROWS))) for j in range(len(cuts) + 1)]), F.col("stretch"))
        left = main.withColumn("part", F.pmod(F.xxhash64("__main"), parts).cast("int"))
        right = points.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

        def best(key: tuple, rows: pd.DataFrame, aux: pd.DataFrame) -> pd.DataFrame:
            ids, values = margins.value[int(key[0])]
            ids, once = np.unique(np.concatenate([aux["__aux"].to_numpy(np.int64), ids]), return_index=True)
            index = _Line(ids, np.concatenate([aux["place"].to_numpy(float), values])[once], keep)
            out = near(index, rows["place"].to_numpy(float))
            return out.assign(__main=rows["__main"].to_numpy())[["__main", "aux", "d", "ref"]]

        both = left.groupBy("stretch", "part").cogroup(right.groupBy("stretch", "part"))
        found = both.applyInPandas(best, "__main long, aux long, d double, ref double")
        return found.select("__main", F.struct("aux", "d", "ref").alias("__near"))

    def _neighbors(self, vectors: DataFrame, row: str, k: int) -> DataFrame:
        """``(row, __aux, d, rank)`` of the k nearest auxiliary rows, beyond what one task can hold."""
        if all(kind == "string" for kind in self.kinds_):
            scored = self._joined(vectors, row, k)
        else:
            scored = self._blocked(vectors, row, k)
        order = Window.partitionBy(row).orderBy("d", "__aux")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _joined(self, vectors: DataFrame, row: str, k: int) -> DataFrame:
        """Distances over string keys, from the grams that two rows share.

        Rows meet on grams that at most ``COMMON`` auxiliary rows hold.  What a
        row could still share with others, through its common grams alone, is
        bounded by the norm of these; only rows whose k-th best match is below
        that bound meet on common grams as well.  Auxiliary rows without a gram
        in common are as far as their number of filled keys says, so the first
        few of each number stand for all.
        """
        aux = self.vectors_.select("__aux", F.col("filled").alias("aux_filled"), "weights")
        postings = aux.select("__aux", F.explode("weights").alias("g")).select("__aux", "g.gram", F.col("g.w").alias("v"), "g.df")
        own = vectors.select(row, "filled", F.explode("weights").alias("g")).select(row, "g.gram", "g.w", "g.df")
        rare = own.where(F.col("df") <= COMMON).join(postings.where(F.col("df") <= COMMON).drop("df"), "gram").select(row, "__aux").distinct()
        exact = self._dots(rare, vectors, row)
        bound = own.where(F.col("df") > COMMON).groupBy(row).agg(F.sqrt(F.sum(F.col("w") * F.col("w")) * len(self.kinds_)).alias("bound"))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("dot"), "__aux"))).where(F.col("rank") == k).select(row, "dot")
        slack = (len(self.kinds_) - 1) / 2 + 1e-9  # a row of fewer filled keys may be nearer at a smaller product
        open_ = bound.join(ranked, row, "left").where(F.col("dot").isNull() | (F.col("dot") <= F.col("bound") + slack)).select(row)
        wide = own.where(F.col("df") > COMMON).join(open_, row).join(postings.where(F.col("df") > COMMON).drop("df"), "gram").select(row, "__aux").distinct()
        met = durable(exact.union(self._dots(wide.join(rare, [row, "__aux"], "left_anti"), vectors, row)))
        few = Window.partitionBy("aux_filled").orderBy("__aux")
        fillers = aux.select("__aux", "aux_filled").withColumn("place", F.row_number().over(few)).where(F.col("place") <= k).select("__aux").collect()  # k for each number of keys
        others = vectors.select(row, F.explode(F.array(*[F.lit(r["__aux"]) for r in fillers])).alias("__aux")).join(met.select(row, "__aux"), [row, "__aux"], "left_anti")
        pairs = met.select(row, "__aux", "dot").union(others.select(row, "__aux", F.lit(0.0)))
        full = pairs.join(vectors.select(row, "filled"), row).join(aux.select("__aux", "aux_filled"), "__aux")
        d2 = F.col("filled") + F.col("aux_filled") - 2 * F.col("dot")
        return full.select(row, "__aux", F.sqrt(F.greatest(F.round(d2, 9), F.lit(0.0))).alias("d"))

    def _dots(self, pairs: DataFrame, vectors: DataFrame, row: str) -> DataFrame:
        """Whole products of the pairs' vectors."""
        both = pairs.join(vectors.select(row, F.col("weights").alias("a")), row).join(self.vectors_.select("__aux", F.col("weights").alias("b")), "__aux")

        @F.pandas_udf("double")
        def dot(a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(a, b, strict=True):
                left = {g["gram"]: g["w"] for g in x}
                out.append(sum(left.get(g["gram"], 0.0) * g["w"] for g in y))
            return pd.Series(out, dtype=float)

        return both.select(row, "__aux", dot("a", "b").alias("dot"))

    def _blocked(self, vectors: DataFrame, row: str, k: int) -> DataFrame:
        """Every block of main rows against every block of auxiliary rows, k best of each."""
        n_blocks = -(-self.n_ // BROADCAST_ROWS)
        n_parts = max(1, -(-vectors.count() // MAIN_ROWS))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        blocks, parts = F.sequence(F.lit(0), F.lit(n_blocks - 1)), F.sequence(F.lit(0), F.lit(n_parts - 1))
        left = vectors.withColumn("part", deal(row, n_parts)).withColumn("block", F.explode(blocks))
        right = self.vectors_.withColumn("block", deal("__aux", n_blocks)).withColumn("part", F.explode(parts))

        def best(main: pd.DataFrame, aux: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(aux):
                index = _index_of(aux, "__aux")
                other = _index_of(main, row)
                for i in range(len(main)):
                    at, d = index.nearest(k, *other.vector(i))
                    out += [(other.ids[i], index.ids[a], e) for a, e in zip(at.tolist(), d.tolist(), strict=True)]
            return pd.DataFrame(out, columns=[row, "__aux", "d"])

        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, f"{row} long, __aux long, d double")

    def transform(self, X: DataFrame) -> DataFrame:
        if self.small_:
            rows = self._on_line(X) if self.line_ else self._matched(X)
        elif self.line_:
            numbered = durable(X.withColumn("__main", F.monotonically_increasing_id()))
            rows = numbered.join(self._stretched(numbered), "__main", "left")
        else:
            numbered = durable(X.withColumn("__main", F.monotonically_increasing_id()))
            vectors = durable(self._weighted(self._vectors(numbered, self.main_keys_, "__main"), "__main"))
            k = self.reference.reference_neighbor + 1 if isinstance(self.reference, OtherNeighbor) else 1
            near = durable(self._neighbors(vectors, "__main", k))
            best = near.where("rank = 1").select("__main", "__aux", "d")
            if isinstance(self.reference, OtherNeighbor):
                best = best.join(near.where(F.col("rank") == k).select("__main", F.col("d").alias("ref")), "__main", "left")
            elif isinstance(self.reference, SelfJoinNeighbor):
                matched = best.select("__aux").distinct()
                selves = durable(self.vectors_.join(matched, "__aux", "left_semi").withColumnRenamed("__aux", "__self"))
                last = self._neighbors(selves, "__self", self.reference.reference_neighbor + 1).where(F.col("rank") == self.reference.reference_neighbor + 1)
                best = best.join(last.select(F.col("__self").alias("__aux"), F.col("d").alias("ref")), "__aux", "left")
            else:
                best = best.withColumn("ref", F.lit(1.0 if self.reference_ is None else self.reference_))
            rows = numbered.join(best.select("__main", F.struct(F.col("__aux").alias("aux"), "d", "ref").alias("__near")), "__main", "left")
        d, ref = F.col("__near.d"), F.coalesce("__near.ref", F.lit(0.0))
        scaled = F.when(d == 0, 0.0).when(ref > 0, d / ref).when(d.isNotNull(), float("inf"))
        rows = rows.withColumns({"__scaled": scaled, "__ok": F.coalesce(scaled <= self.max_dist, F.lit(False))})
        names = fresh_names([f"{c}{self.suffix}" for c in self.aux.columns], X.columns)
        aux = self.aux_.select("__aux", *[quoted(c).alias(n) for c, n in zip(self.aux.columns, names, strict=True)])
        aux = F.broadcast(aux) if self.small_ else aux  # at most BROADCAST_ROWS rows
        found = F.when(F.col("__ok"), F.col("__near.aux"))
        found = found if self.small_ else F.coalesce(found, -1 - F.col("__main"))  # rows without a match spread over all tasks
        joined = rows.withColumn("__aux", found).join(aux, "__aux", "left")
        info = [d.cast("float").alias("match_distance"), F.col("__scaled").cast("float").alias("match_rescaled_distance"), F.col("__ok").alias("match_accepted")]
        return joined.select(*[quoted(c) for c in X.columns], *[quoted(n) for n in names], *(info if self.info else []))

    def fit_transform(self, X: DataFrame) -> DataFrame:
        return self.fit(X).transform(X)


def _index_of(table: pd.DataFrame, row: str) -> _Index:
    """An index of rows that carry their weights, in the rows' order of ``row``."""
    lists = [x if x is not None else () for x in table["weights"]]
    grams = [np.array([g["gram"] for g in x], np.int64) for x in lists]
    weights = [np.array([g["w"] for g in x], float) for x in lists]
    numbers = np.array([np.asarray(x, float) for x in table["numbers"]], float).reshape(len(table), -1)
    return _Index(table[row].to_numpy(np.int64), numbers, grams, weights, table["filled"].to_numpy(float))


def fuzzy_join(
    left: DataFrame, right: DataFrame, left_on=None, right_on=None, on=None, suffix: str = "", max_dist: float | None = float("inf"), ref_dist="random_pairs",
    string_encoder: StringVectors | None = None, add_match_info: bool = False, drop_unmatched: bool = False,
) -> DataFrame:
    """:class:`Joiner` as a function; ``drop_unmatched`` leaves unmatched rows out."""
    joiner = Joiner(right, key=on, main_key=left_on, aux_key=right_on, suffix=suffix, max_dist=max_dist, ref_dist=ref_dist, string_encoder=string_encoder)
    out = joiner.fit_transform(left)
    if drop_unmatched:
        out = out.where("match_accepted")
    return out if add_match_info else out.drop("match_distance", "match_rescaled_distance", "match_accepted")


def _tagged(j: int):
    return lambda gram: F.xxhash64(F.lit(j), gram)


#: Distinct spellings that are clustered on the driver.
MOST_SPELLINGS = 5000


def deduplicate(df: DataFrame, column: str, n_clusters: int | None = None, ngram_range: tuple[int, int] = (2, 4)) -> DataFrame:
    """``df`` with ``{column}_deduplicated``: the commonest spelling of its cluster.

    The distinct spellings (at most ``MOST_SPELLINGS``, else an error) and their
    counts come to the driver; average linkage over TF-IDF distances, cut where
    the mean silhouette is largest.  The mapping is joined back.
    """
    from tablewright.operators.encoders import _Features

    spark = df.sparkSession
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(MOST_SPELLINGS + 1)
    features = _Features("char_wb", ngram_range, (), 4096)
    counts = counts.withColumn("grams", features.hashes(F.col("value").cast("string"))).collect()
    if len(counts) > MOST_SPELLINGS:
        raise ValueError(f"{column} has more than {MOST_SPELLINGS} distinct values")
    values, n = [r["value"] for r in counts], np.array([r["n"] for r in counts])
    x = features.counts([r["grams"] for r in counts])
    x = x * (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ x.T))
    np.fill_diagonal(d, 0.0)
    label = _clusters(d, n_clusters)
    best = {}
    for j in np.lexsort((np.array(values), -n)):
        best.setdefault(label[j], values[j])
    mapping = spark.createDataFrame([(v, best[c]) for v, c in zip(values, label, strict=True)], "__value string, __best string")
    name = fresh_names([f"{column}_deduplicated"], df.columns)[0]
    joined = df.join(F.broadcast(mapping), quoted(column) == F.col("__value"), "left")  # at most MOST_SPELLINGS rows
    return joined.select(*[quoted(c) for c in df.columns], F.col("__best").alias(name))


def _clusters(d: np.ndarray, n_clusters: int | None) -> np.ndarray:
    """Average-linkage labels with ``n_clusters``, or the best mean silhouette."""
    n = len(d)
    if n < 3:
        return np.arange(n)
    size, active, work = np.ones(n), list(range(n)), d.copy()
    np.fill_diagonal(work, np.inf)
    label = np.arange(n)
    best, best_label = -2.0, label.copy()
    while len(active) > 1:
        if n_clusters is not None and len(active) == n_clusters:
            return label
        if n_clusters is None and 2 <= len(active) < n:
            score = _silhouette(d, label)
            if score > best:
                best, best_label = score, label.copy()
        sub = np.array(active)
        at = work[np.ix_(sub, sub)].argmin()
        i, j = sub[at // len(sub)], sub[at % len(sub)]
        i, j = min(i, j), max(i, j)
        merged = (work[i] * size[i] + work[j] * size[j]) / (size[i] + size[j])
        work[i], work[:, i] = merged, merged
        work[i, i] = np.inf
        size[i] += size[j]
        active.remove(j)
        label[label == j] = i
    return best_label


def _silhouette(d: np.ndarray, label: np.ndarray) -> float:
    names, place = np.unique(label, return_inverse=True)
    onehot = np.eye(len(names))[place]
    count = onehot.sum(axis=0)
    sums = d @ onehot
    own = sums[np.arange(len(d)), place] / np.maximum(count[place] - 1, 1)
    sums = sums / count
    sums[np.arange(len(d)), place] = np.inf
    other = sums.min(axis=1)
    score = (other - own) / np.maximum(np.maximum(own, other), 1e-12)
    return float(np.where(count[place] == 1, 0.0, score).mean())
