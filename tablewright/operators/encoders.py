"""Encoders of strings: min-hash, latent semantics, similarity, topics, embeddings.

n-grams are made and hashed to 64 bits inside the JVM; what travels to Python is
an array of longs for each row, from which numpy counts features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.strings import char_ngrams, grams_of, numbered_grams, similarity_of
from tablewright.operators.columns import MOST_CATEGORIES, ColumnTransformer, Reject, _copy
from tablewright.stats import distinct_values
from tablewright.storage import durable
from tablewright.types import classify, padded, quoted

#: Rows of the first topics' seeding, and words that may name a topic.
SEED_ROWS, NAME_WORDS = 1000, 5000
#: Repeated texts, and characters of each, whose vectors a model keeps.
KNOWN_TEXTS, KNOWN_CHARS = 2000, 200


def _strings_only(field) -> None:
    if classify(field) not in ("string", "category"):
        raise Reject(f"{field.name} holds no strings")


class MinHashEncoder(ColumnTransformer):
    """``{column}_{j}``: for each hash function the least hash of the n-grams, in [0, 1).

    Stateless and inside the JVM: the n-grams are made once for a row, then one
    pass for each hash function.  ``hashing`` is "fast" (64-bit xxHash) or
    "murmur" (32-bit MurmurHash3).  A null or empty string gives zeros.  If one
    string's grams include another's, its values are nowhere larger.
    ``minmax_hash`` uses half the functions and adds the largest hashes.
    """

    def __init__(self, n_components: int = 30, ngram_range: tuple[int, int] = (2, 4), hashing: str = "fast", minmax_hash: bool = False):
        if minmax_hash and n_components % 2:
            raise ValueError("minmax_hash needs an even number of components")
        if hashing not in ("fast", "murmur"):
            raise ValueError("hashing must be 'fast' or 'murmur'")
        self.n, self.range, self.minmax, self.hashing = n_components, ngram_range, minmax_hash, hashing

    check = staticmethod(_strings_only)

    def shared(self, field):
        text, grams = quoted(field.name), quoted(f"__grams_{field.name}")
        kind = F.xxhash64 if self.hashing == "fast" else F.hash
        seeds = F.sequence(F.lit(0), F.lit((self.n // 2 if self.minmax else self.n) - 1))
        hashes = lambda end: F.transform(seeds, lambda seed: end(F.transform(grams, lambda gram: kind(seed, gram))))
        empty = F.coalesce(F.trim(text), F.lit("")) == ""
        found = F.concat(hashes(F.array_min), hashes(F.array_max)) if self.minmax else hashes(F.array_min)
        # The grams are named twice, hence kept in a projection of their own and made once.
        return [{f"__grams_{field.name}": F.when(~empty, F.array_distinct(char_ngrams(text, *self.range)))}, {f"__hashes_{field.name}": F.when(grams.isNotNull(), found)}]

    def exprs(self, field):
        hashes, bits = quoted(f"__hashes_{field.name}"), 64 if self.hashing == "fast" else 32
        value = lambda j: F.coalesce(F.get(hashes, j).cast("double") / 2.0**bits + 0.5, F.lit(0.0)).cast("float")
        return [value(j).alias(f"{field.name}_{name}") for j, name in enumerate(padded(self.n))]


# --- feature counts ---------------------------------------------------------


class _Features:
    """Counts of n-grams by feature: a vocabulary's entries, or hash values modulo ``n``."""

    def __init__(self, analyzer: str, ngram_range: tuple[int, int], stop_words: tuple[str, ...], n: int, vocabulary: list[int] | None = None):
        self.analyzer, self.range, self.stop_words, self.n = analyzer, ngram_range, tuple(stop_words or ()), n
        self.order = self.keys = None
        if vocabulary is not None:
            keys = np.array(vocabulary, np.int64)
            self.n, self.order = len(keys), np.argsort(keys)
            self.keys = keys[self.order]

    def grams(self, text: Column) -> Column:
        return grams_of(text, self.analyzer, *self.range, self.stop_words)

    def hashes(self, text: Column) -> Column:
        return F.transform(self.grams(text), lambda gram: F.xxhash64(gram))

    def counts(self, lists) -> np.ndarray:
        """A row of counts for each list of hashes."""
        sizes = np.fromiter((0 if x is None else len(x) for x in lists), np.int64, len(lists))
        flat = np.concatenate([x for x in lists if x is not None and len(x)]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(lists)), sizes)
        if self.keys is None:
            at = np.mod(flat, self.n)
        elif len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
            known = self.keys[place] == flat
            row, at = row[known], self.order[place[known]]
        else:
            row = at = flat[:0]
        return np.bincount(row * self.n + at, minlength=len(lists) * self.n).reshape(len(lists), self.n).astype(np.float64)


def _texts(df: DataFrame, name: str) -> DataFrame:
    """``(text, n)``: the distinct texts of a column and their rows, dealt over all tasks.

    A column of few texts takes little of a file, so one task may read millions of
    its rows; what passes over a column costs is paid once a text.
    """
    return durable(df.groupBy(quoted(name).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("n")))


def _summed(rows: DataFrame, part: Callable[..., np.ndarray], shape: tuple, read: Callable) -> np.ndarray:
    """Sum of ``part(matrix)`` over the rows of a column ``x``; a sum leaves each task.

    With a column ``n`` of counts it is ``part(matrix, n)``, n a column, too.  Sums of tasks meet 16 at a time before the driver adds the rest.
    """
    counted = "n" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, some = np.zeros(shape), False
        for batch in batches:
            for low in range(0, len(batch), 2048):
                some_n = [batch["n"].iloc[low : low + 2048].to_numpy(np.float64)[:, None]] if counted else []
                total += part(read(batch["x"].iloc[low : low + 2048].tolist()), *some_n)
                some = True
        if some:
            context = TaskContext.get()
            yield pd.DataFrame({"group": [(context.partitionId() if context else 0) // 16], "sum": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape)
        for b in frame["sum"]:
            total += np.frombuffer(b).reshape(shape)
        return pd.DataFrame({"sum": [total.tobytes()]})

    found = rows.mapInPandas(run, "group int, sum binary").groupBy("group").applyInPandas(add, "sum binary").toLocalIterator()
    total = np.zeros(shape)
    for r in found:
        total += np.frombuffer(r["sum"]).reshape(shape)
    return total


class _VectorModel(ColumnTransformer):
    """A fitted encoder whose outputs are the entries of one array of floats.

    The commonest repeated ``texts`` of the fit are encoded once, not in each row.
    """

    def __init__(self, n: int, prepare: Callable[[Column], Column], encode: Callable[[list], np.ndarray], names: list[str] | None = None, texts: DataFrame | None = None):
        self.n, self.prepare, self.encode, self.names = n, prepare, encode, names
        self.known, self.table = [], np.zeros((0, n), np.float32)
        if texts is not None:
            often = texts.where((F.col("n") > 1) & (F.length("text") <= KNOWN_CHARS)).orderBy(F.desc("n"), "text").limit(KNOWN_TEXTS)
            rows = often.select("text", prepare(F.col("text")).alias("x")).collect()  # at most KNOWN_TEXTS
            self.known = [r["text"] for r in rows]
            self.table = np.asarray(encode([r["x"] for r in rows]), np.float32) if rows else self.table

    def shared(self, field):
        encode, table, place = self.encode, self.table, {t: j for j, t in enumerate(self.known)}

        @F.pandas_udf("array<float>")
        def vectors(x: pd.Series, text: pd.Series) -> pd.Series:
            at = np.fromiter((place.get(t, -1) for t in text), np.int64, len(text))
            out = np.zeros((len(x), table.shape[1]), np.float32)
            out[at >= 0] = table[at[at >= 0]]
            new = np.flatnonzero(at < 0)
            for low in range(0, len(new), 2048):
                some = new[low : low + 2048]
                out[some] = encode(x.iloc[some].tolist())
            return pd.Series(list(out))

        c, ready = quoted(field.name).cast("string"), quoted(f"__ready_{field.name}")  # named twice, hence a projection of its own below the function
        prepared = F.when(~F.coalesce(c.isin(self.known), F.lit(False)), self.prepare(c)) if self.known else self.prepare(c)
        return [{f"__ready_{field.name}": prepared}, {f"__vector_{field.name}": vectors(F.when(ready.isNotNull(), ready), c)}]

    def exprs(self, field):
        names = self.names or [f"{field.name}_{p}" for p in padded(self.n)]
        return [F.get(quoted(f"__vector_{field.name}"), j).alias(name) for j, name in enumerate(names)]

    def get_feature_names_out(self) -> list[str] | None:
        return self.names


def _top_grams(texts: DataFrame, grams: Column, n: int) -> list[tuple[str, int, int]]:
    """The ``n`` grams that most rows hold, ties by gram, with their hash and document frequency."""
    each = texts.select("n", F.explode(F.array_distinct(grams)).alias("gram"))
    counts = each.groupBy("gram").agg(F.sum("n").alias("n"), F.first(F.xxhash64("gram")).alias("hash"))
    return [(r["gram"], r["hash"], r["n"]) for r in counts.orderBy(F.desc("n"), "gram").limit(n).collect()]


class StringEncoder(ColumnTransformer):
    """Latent semantics of n-grams: TF-IDF, truncated SVD, one scale.

    ``vectorizer`` "tfidf" learns a vocabulary, the ``n_features`` grams that
    most rows hold (all, if there are fewer), or takes the given ``vocabulary``;
    "hashing" needs none.  ``analyzer`` is "char_wb", "char" or "word", the last
    with ``stop_words``.  Fitting counts document frequencies, then sums the
    features' Gram matrix over the distinct texts in one pass; the driver solves a matrix
    of ``n_features`` squared.  With no more features than components they are
    the output as they are.  Components' signs make the largest loading positive.
    """

    def __init__(
        self, n_components: int = 30, vectorizer: str = "tfidf", ngram_range: tuple[int, int] = (3, 4), analyzer: str = "char_wb", stop_words=None, vocabulary=None, n_features: int = 1024
    ):
        if vectorizer not in ("tfidf", "hashing"):
            raise ValueError(f"vectorizer must be 'tfidf' or 'hashing', not {vectorizer!r}")
        if vocabulary is not None and vectorizer == "hashing":
            raise ValueError("hashing takes no vocabulary")
        self.n, self.vectorizer, self.range, self.analyzer = n_components, vectorizer, ngram_range, analyzer
        self.stop_words, self.vocabulary, self.features = tuple(stop_words or ()), vocabulary, n_features

    check = staticmethod(_strings_only)

    def fitted_for(self, df: DataFrame, name: str) -> _VectorModel:
        text, texts = F.col("text"), _texts(df, name)
        features = _Features(self.analyzer, self.range, self.stop_words, self.features)
        terms = top = None
        if self.vectorizer == "tfidf":
            if self.vocabulary is None:
                top = _top_grams(texts, features.grams(text), self.features)
                terms, hashes = [g for g, _, _ in top], [h for _, h, _ in top]
            else:
                terms = sorted(self.vocabulary, key=self.vocabulary.get) if isinstance(self.vocabulary, dict) else list(self.vocabulary)
                hashes = [r["h"] for r in df.sparkSession.createDataFrame(list(enumerate(terms)), "j int, g string").select("j", F.xxhash64("g").alias("h")).orderBy("j").collect()]
            if not terms:
                raise Reject(f"{name} holds no n-grams")
            features = _Features(self.analyzer, self.range, self.stop_words, self.features, hashes)
        m = features.n
        rows = texts.select(features.hashes(text).alias("x"), "n")
        if top:
            seen = np.array([n for _, _, n in top] + [texts.agg(F.sum("n")).first()[0]], float)
        else:
            seen = _summed(rows, lambda x, n: np.concatenate([((x > 0) * n).sum(axis=0), [n.sum()]]), (m + 1,), features.counts)
        idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

        def weighted(x: np.ndarray) -> np.ndarray:
            x = x * idf
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

        moments = _summed(rows, lambda x, n: np.concatenate([((w := weighted(x)) * n).T @ w, (w * n).sum(axis=0)[None]]), (m + 1, m), features.counts)
        gram = moments[:-1]
        if m > self.n and seen[-1] > self.n:
            values, vectors = np.linalg.eigh(gram)
            basis = vectors[:, ::-1][:, : self.n]
            basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
        else:
            basis = np.eye(m)[:, : self.n]
        count = max(seen[-1], 1)
        mean = moments[-1] @ basis / count
        spread = np.einsum("ij,ik,kj->j", basis, gram, basis) / count - mean**2
        total = np.sqrt(max(spread.sum(), 0.0))
        scale = total if total > 2.2e-15 else 1.0
        model = _VectorModel(basis.shape[1], features.hashes, lambda lists: weighted(features.counts(lists)) @ basis / scale, texts=texts)
        model.vocabulary_, model.idf_, model.scaling_factor_ = terms, idf, scale
        return model

    def fit(self, df, column):
        self.check(df.schema[column])
        return self.fitted_for(df, column)


class TextEncoder(ColumnTransformer):
    """A given sentence embedding, reduced by principal components.

    ``embed`` maps a list of strings to rows of ``width`` numbers; it runs on the
    executors, once for each distinct string of a batch.
    """

    def __init__(self, embed: Callable[[list], np.ndarray], width: int, n_components: int | None = 30):
        self.embed, self.width, self.n = embed, width, n_components

    check = staticmethod(_strings_only)

    def fitted_for(self, df: DataFrame, name: str) -> _VectorModel:
        embed, m = self.embed, self.width

        def rows(texts: list) -> np.ndarray:
            distinct, place = np.unique(np.array([t or "" for t in texts], dtype=str), return_inverse=True)
            return np.asarray(embed(distinct.tolist()), np.float64)[place]

        filled = lambda text: F.coalesce(text, F.lit(""))
        if self.n is None:
            return _VectorModel(m, filled, rows)
        texts = _texts(df, name).select(filled(F.col("text")).alias("x"), "n")
        sums = _summed(texts, lambda x, n: np.concatenate([(x * n).T @ x, (x * n).sum(axis=0)[None], np.full((1, m), n.sum())]), (m + 2, m), rows)
        count = max(sums[-1, 0], 1)
        mean = sums[-2] / count
        values, vectors = np.linalg.eigh(sums[:-2] / count - np.outer(mean, mean))
        basis = vectors[:, ::-1][:, : min(self.n, m)]
        basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
        scale = np.sqrt(max(values[::-1][: basis.shape[1]].sum(), 0.0)) or 1.0
        return _VectorModel(basis.shape[1], filled, lambda x: (rows(x) - mean) @ basis / scale)

    def fit(self, df, column):
        self.check(df.schema[column])
        return self.fitted_for(df, column)


class SimilarityEncoder(ColumnTransformer):
    """``{column}_{category}``: n-gram similarity to every category of the fit.

    ``categories`` are a list, lists by column, or None for the column's own (at
    most ``MOST_CATEGORIES``, more are refused).  ``handle_missing`` "" reads a
    null as an empty string, "error" raises.  ``handle_unknown`` "ignore" gives
    a string that is no category its similarities, "error" raises.
    """

    def __init__(self, ngram_range: tuple[int, int] = (2, 4), categories=None, handle_missing: str = "", handle_unknown: str = "ignore"):
        if handle_missing not in ("", "error") or handle_unknown not in ("ignore", "error"):
            raise ValueError("handle_missing must be '' or 'error', handle_unknown 'ignore' or 'error'")
        self.range, self.categories, self.missing, self.unknown = ngram_range, categories, handle_missing, handle_unknown

    check = staticmethod(_strings_only)

    def requests(self, df, field):
        return {"nulls": F.count(F.when(quoted(field.name).isNull(), 1))}

    def fitted(self, df, field, stats):
        if self.missing == "error" and stats["nulls"]:
            raise ValueError(f"{field.name} holds nulls")
        given = self.categories.get(field.name) if isinstance(self.categories, dict) else self.categories
        if given is None:
            given = sorted({*distinct_values(df, quoted(field.name), MOST_CATEGORIES), *([""] if stats["nulls"] else [])})
        return _copy(self, categories=list(given))

    def shared(self, field):
        c = quoted(field.name)
        if self.missing == "error":
            c = F.coalesce(c, F.raise_error(f"{field.name} holds nulls").cast("string"))
        c = F.coalesce(c, F.lit(""))
        if self.unknown == "error":
            c = F.when(c.isin(*self.categories), c).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), c)).cast("string"))
        return [{f"__text_{field.name}": F.when(c.isNotNull(), c)}, {f"__grams_{field.name}": numbered_grams(char_ngrams(quoted(f"__text_{field.name}"), *self.range))}]

    def exprs(self, field):
        grams = quoted(f"__grams_{field.name}")
        return [similarity_of(grams, numbered_grams(char_ngrams(F.lit(v), *self.range))).cast("float").alias(f"{field.name}_{v}") for v in self.categories]


class GapEncoder(ColumnTransformer):
    """Topics of n-gram counts by Gamma-Poisson factorisation.

    Each of ``max_iter`` passes updates the activations of every row under the
    current topics and sums the topics' statistics over all rows (a full-batch
    form of the online algorithm); passes end early once topics move by less
    than ``tol``.  ``partial_fit`` goes on from the topics so far, older
    statistics decaying by ``rho``.  Features are hashed n-grams.  ``init`` is
    "k-means++" over at most ``SEED_ROWS`` rows of least hash, or "random".
    Outputs are activations named by the topics' leading words, see
    :meth:`topic_names`; with ``names=False`` by the topics' numbers.
    """

    def __init__(
        self, n_components: int = 10, ngram_range: tuple[int, int] = (2, 4), analyzer: str = "char", n_features: int = 512, init: str = "k-means++", max_iter: int = 5,
        rho: float = 0.95, tol: float = 1e-4, rescale_h: bool = False, shape: float = 1.1, scale: float = 1.0, names: bool = True, seed: int = 0,
    ):
        if init not in ("k-means++", "random"):
            raise ValueError("init must be 'k-means++' or 'random'")
        if not 0 < rho <= 1:
            raise ValueError("rho must lie between 0 and 1")
        self.n, self.max_iter, self.rho, self.tol, self.init = n_components, max_iter, rho, tol, init
        self.features = _Features(analyzer, ngram_range, (), n_features)
        self.shape, self.prior_scale, self.rescale_h, self.names, self.seed = shape, scale, rescale_h, names, seed
        self.topics = self.numerator = self.denominator = None

    check = staticmethod(_strings_only)

    def _activations(self, x: np.ndarray, topics: np.ndarray, steps: int = 20) -> np.ndarray:
        total = np.maximum(x.sum(axis=1, keepdims=True), 1e-10)
        h = np.ones((len(x), len(topics))) * total / len(topics) + 1e-3
        for _ in range(steps):
            ratio = x / np.maximum(h @ topics, 1e-10)
            h = np.maximum((h * (ratio @ topics.T) + self.shape - 1) / (topics.sum(axis=1) + 1 / self.prior_scale), 1e-10)
        return h / h.sum(axis=1, keepdims=True) * total if self.rescale_h else h

    def _first_topics(self, df: DataFrame, name: str) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        if self.init == "random":
            topics = rng.gamma(self.shape, self.prior_scale, (self.n, self.features.n))
        else:
            c = quoted(name).cast("string")
            some = df.select(c.alias("v"), self.features.hashes(c).alias("x")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(SEED_ROWS)
            x = self.features.counts([r["x"] for r in some.collect()])
            if not len(x):
                x = np.zeros((1, self.features.n))
            chosen = [int(rng.integers(len(x)))]
            near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
            while len(chosen) < self.n:
                share = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
                chosen.append(int(rng.choice(len(x), p=share)))
                near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            topics = x[chosen] + 0.1
        return topics / topics.sum(axis=1, keepdims=True)

    def partial_fit(self, df: DataFrame, name: str, texts: DataFrame | None = None) -> GapEncoder:
        """``texts``: the column's distinct texts, where they are known."""
        texts = _texts(df, name) if texts is None else texts
        topics = self._first_topics(df, name) if self.topics is None else self.topics
        k, m = topics.shape

        def part(x: np.ndarray, n: np.ndarray) -> np.ndarray:
            h = self._activations(x, topics)
            return np.concatenate([topics * ((h * n).T @ (x / np.maximum(h @ topics, 1e-10))), np.repeat((h * n).sum(axis=0)[:, None], m, axis=1)])

        sums = _summed(texts.select(self.features.hashes(F.col("text")).alias("x"), "n"), part, (2 * k, m), self.features.counts)
        numerator = sums[:k] + (0.0 if self.numerator is None else self.rho * self.numerator)
        denominator = sums[k:] + (0.0 if self.denominator is None else self.rho * self.denominator)
        after = (numerator + 1e-10) / (denominator + 1e-10)
        return _copy(self, topics=after / after.sum(axis=1, keepdims=True), numerator=numerator, denominator=denominator)

    def fitted_for(self, df: DataFrame, name: str) -> _VectorModel:
        model, texts = self, _texts(df, name)
        for _ in range(self.max_iter):
            before, model = model.topics, model.partial_fit(df, name, texts)
            if before is not None and np.linalg.norm(model.topics - before) < self.tol * np.linalg.norm(before):
                break
        names = model.topic_names(df, name, texts=texts) if self.names else None
        out = _VectorModel(self.n, self.features.hashes, lambda lists: model._activations(model.features.counts(lists), model.topics), names, texts)
        out.topics_, out.model_ = model.topics, model
        return out

    def topic_names(self, df: DataFrame, name: str, n_labels: int = 3, texts: DataFrame | None = None) -> list[str]:
        """``{column}: word, word, word``: the words of the column that a topic owns most of.

        Words are the ``NAME_WORDS`` that most rows hold, of two letters or more.
        """
        words = grams_of(F.col("text"), "word", 1, 1)
        top = [g for g, _, _ in _top_grams(_texts(df, name) if texts is None else texts, words, NAME_WORDS)]
        if not top:
            return [f"{name}_{p}" for p in padded(self.n)]
        spark = df.sparkSession
        rows = spark.createDataFrame(list(enumerate(sorted(top))), "j int, w string").select("j", "w", self.features.hashes(F.col("w")).alias("x")).orderBy("j").collect()
        share = self._activations(self.features.counts([r["x"] for r in rows]), self.topics)
        share = share / share.sum(axis=1, keepdims=True)
        labels, out = [r["w"] for r in rows], []
        for t in range(self.n):
            best = np.argsort(-share[:, t], kind="stable")[:n_labels]
            label = f"{name}: " + ", ".join(labels[b] for b in best)
            out.append(label if label not in out else f"{label} ({t})")
        return out

    def fit(self, df, column):
        self.check(df.schema[column])
        return self.fitted_for(df, column)

    def score(self, df: DataFrame, name: str) -> float:
        """Mean Kullback-Leibler divergence of the counts from the fit."""

        def part(x: np.ndarray) -> np.ndarray:
            fit = np.maximum(self._activations(x, self.topics) @ self.topics, 1e-10)
            terms = np.where(x > 0, x * np.log(np.maximum(x, 1e-10) / fit), 0.0) - x + fit
            return np.array([terms.sum(), len(x)])

        total, n = _summed(df.select(self.features.hashes(quoted(name).cast("string")).alias("x")), part, (2,), self.features.counts)
        return float(total / max(n, 1))
