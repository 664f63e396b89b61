"""Learners: a graph with its parameters fixed, fitted and applied by environment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import mean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.graph import Node, State, evaluate
from tablewright.types import quoted


def fold_of(key: str, n: int, seed: int = 0):
    """A row's fold, by a hash of its key: stable under any partitioning."""
    return F.pmod(F.xxhash64(quoted(key), F.lit(seed)), F.lit(n))


def _split(env: dict, key: str, test) -> tuple[dict, dict]:
    """Frames that hold the key are split, everything else goes to both sides."""
    train, held = {}, {}
    for name, value in env.items():
        if isinstance(value, DataFrame) and key in value.columns:
            train[name], held[name] = value.where(~test), value.where(test)
        else:
            train[name] = held[name] = value
    return train, held


def train_test_split(env: dict, key: str, test_size: float = 0.25, seed: int = 0) -> tuple[dict, dict]:
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    return _split(env, key, fold_of(key, 10_000, seed) < int(test_size * 10_000))


def iter_cv_splits(env: dict, key: str, cv: int = 5, seed: int = 0) -> Iterator[tuple[dict, dict]]:
    for j in range(cv):
        yield _split(env, key, fold_of(key, cv, seed) == j)


class Learner:
    """A graph and the state its fits leave behind."""

    def __init__(self, node: Node, params: dict):
        self.node, self.params, self.state = node, params, State()

    def fit(self, env: dict) -> Learner:
        self.fit_transform(env)
        return self

    def fit_transform(self, env: dict):
        self.state = State()
        return evaluate(self.node, env, "fit_transform", self.state, self.params)

    def transform(self, env: dict):
        return evaluate(self.node, env, "transform", self.state, self.params)

    def predict(self, env: dict):
        return evaluate(self.node, env, "predict", self.state, self.params)

    def truncated_after(self, name: str) -> Learner:
        out = Learner(self.node.tw.find(name), self.params)
        out.state = self.state
        return out

    def find_fitted_estimator(self, name: str):
        return self.state.fitted[self.node.tw.find(name)._n["id"]]

    def score(self, env: dict, scoring: Callable[[DataFrame], float] | None = None) -> float:
        """The score of the predictions, by ``scoring`` or the first that the plan carries."""
        return _scoring(self.node, scoring)(self.predict(env))

    def cross_validate(self, env: dict, key: str, scoring: Callable[[DataFrame], float] | None = None, cv: int = 5, seed: int = 0) -> list[float]:
        score = _scoring(self.node, scoring)
        return [score(Learner(self.node, self.params).fit(train).predict(held)) for train, held in iter_cv_splits(env, key, cv, seed)]


def _scoring(node: Node, scoring: Callable | None) -> Callable[[DataFrame], float]:
    if scoring is not None:
        return scoring
    carried = node.tw.scorers()
    if not carried:
        raise ValueError("give a scoring, or a plan that carries one (with_scoring)")
    return carried[0][1]


class SearchResult:
    """Scores of all candidates, best first, and the best one fitted on everything."""

    def __init__(self, rows: list[dict], best: Learner):
        self.results_, self.best_learner_, self.best_params_, self.best_score_ = rows, best, rows[0]["params"], rows[0]["score"]

    def results_table(self) -> list[dict]:
        """A row a candidate: its parameters, mean and deviation of its scores, its rank."""
        out = []
        for r in self.results_:
            rank = 1 + sum(other["score"] > r["score"] for other in self.results_)
            out.append({**r["params"], "mean_test_score": r["score"], "std_test_score": pstdev(r["scores"]), "rank_test_score": rank})
        return out


def search(node: Node, candidates: list[dict], env: dict, key: str, scoring: Callable | None, cv: int, seed: int) -> SearchResult:
    rows = []
    for params in candidates:
        scores = Learner(node, params).cross_validate(env, key, scoring, cv, seed)
        rows.append({"params": params, "score": mean(scores), "scores": scores})
    rows.sort(key=lambda r: -r["score"])
    return SearchResult(rows, Learner(node, rows[0]["params"]).fit(env))
