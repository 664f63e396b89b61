"""Hyper-parameter choices inside a graph."""

from __future__ import annotations

import math


class Choice:
    """One of several outcomes; the first is the default."""

    def __init__(self, name: str, outcomes: list, labels: list | None = None):
        if not outcomes:
            raise ValueError("a choice needs an outcome")
        self.name, self.outcomes, self.labels = name, list(outcomes), labels

    def default(self):
        return self.outcomes[0]

    def grid(self) -> list:
        return self.outcomes

    def draw(self, rng):
        return rng.choice(self.outcomes)

    def describe(self) -> str:
        return str(self.labels or self.outcomes)

    def match(self, targets: dict):
        return Matched(self, targets)


class Matched:
    """A value that follows a choice."""

    def __init__(self, choice: Choice, targets: dict):
        self.choice, self.targets = choice, targets


class BoolChoice(Choice):
    """True or false, the default first."""

    def if_else(self, yes, no) -> Matched:
        """A value that follows the choice."""
        return Matched(self, {True: yes, False: no})


class NumericChoice(Choice):
    """Numbers from ``low`` to ``high``, maybe on a log scale or in ``n_steps``."""

    def __init__(self, name: str, low, high, log: bool = False, n_steps: int | None = None, default=None, integer: bool = False):
        if low >= high or log and low <= 0:
            raise ValueError("low must be below high, and positive on a log scale")
        self.name, self.low, self.high, self.log, self.n_steps, self._default, self.integer = name, low, high, log, n_steps, default, integer

    def _at(self, share: float):
        x = math.exp(math.log(self.low) + share * (math.log(self.high) - math.log(self.low))) if self.log else self.low + share * (self.high - self.low)
        return round(x) if self.integer else x

    def grid(self) -> list:
        n = self.n_steps or 5
        return [self._at(j / (n - 1)) if n > 1 else self._at(0.5) for j in range(n)]

    def default(self):
        if self._default is not None:
            return self._default
        return self.grid()[self.n_steps // 2] if self.n_steps else self._at(0.5)

    def draw(self, rng):
        return rng.choice(self.grid()) if self.n_steps else self._at(rng.random())

    def describe(self) -> str:
        return f"{self.low} to {self.high}" + " on a log scale" * self.log


def choose_from(outcomes, name: str) -> Choice:
    return Choice(name, list(outcomes.values()), list(outcomes)) if isinstance(outcomes, dict) else Choice(name, list(outcomes))


def optional(value, name: str, default=None) -> Choice:
    return Choice(name, [value, None] if default is None else [None, value])


def choose_bool(name: str, default: bool = True) -> BoolChoice:
    return BoolChoice(name, [default, not default])


def choose_float(low: float, high: float, name: str, log: bool = False, n_steps: int | None = None, default=None) -> NumericChoice:
    return NumericChoice(name, low, high, log, n_steps, default)


def choose_int(low: int, high: int, name: str, log: bool = False, n_steps: int | None = None, default=None) -> NumericChoice:
    return NumericChoice(name, low, high, log, n_steps, default, integer=True)


def is_choice(x) -> bool:
    return isinstance(x, (Choice, Matched))


def resolved(x, params: dict):
    """The outcome that ``params`` names, else the default."""
    if isinstance(x, Matched):
        return x.targets[resolved(x.choice, params)]
    return params.get(x.name, x.default()) if x.name in params else x.default()


def choices_in(value) -> list[Choice]:
    if isinstance(value, Matched):
        return [value.choice, *choices_in(list(value.targets.values()))]
    if isinstance(value, Choice):
        nested = [] if isinstance(value, NumericChoice) else choices_in(value.outcomes)
        return [value, *nested]
    if isinstance(value, (list, tuple)):
        return [c for v in value for c in choices_in(v)]
    return [c for v in value.values() for c in choices_in(v)] if isinstance(value, dict) else []
