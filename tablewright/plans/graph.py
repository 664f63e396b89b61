"""A lazy graph of named inputs, frame functions, fits and choices.

Spark's DataFrames are lazy themselves, so a node here only remembers what a
frame cannot: inputs by name, operators to fit, hyper-parameter choices and
which node is X or y.  ``node.evaluate(env, mode)`` builds the frame; nothing
runs before an action.
"""

from __future__ import annotations

import html
import inspect
import itertools
import operator
import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import selectors as s
from tablewright.config import get_config
from tablewright.functions.primitives import concat_columns, concat_rows
from tablewright.operators.columns import PassThrough
from tablewright.plans.choices import Choice, is_choice, resolved
from tablewright.types import quoted

_counter = itertools.count()


class Node:
    """One step.  Attribute access, items, calls and operators make new nodes."""

    def __init__(self, kind: str, inputs: tuple = (), compute: Callable | None = None, name: str | None = None, value=None, estimator=None):
        self._n = {"id": next(_counter), "kind": kind, "inputs": inputs, "compute": compute, "name": name, "value": value, "estimator": estimator, "role": None, "description": None, "frozen": False, "preview": None}

    # --- building ---

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return Node("attribute", (self,), lambda x: getattr(x, name), name=name)

    def __getitem__(self, key):
        return Node("item", (self, key), lambda x, k: x[k])

    def __call__(self, *args, **kwargs):
        names = tuple(kwargs)
        return Node("call", (self, *args, *kwargs.values()), lambda f, *v: f(*v[: len(args)], **dict(zip(names, v[len(args) :], strict=True))))

    def __bool__(self):
        raise TypeError("a node has no truth value before it is evaluated; use tw.if_else")

    def __iter__(self):
        raise TypeError("a node cannot be iterated over before it is evaluated")

    def __contains__(self, _):
        raise TypeError("a node cannot be searched before it is evaluated")

    def __setitem__(self, *_):
        raise TypeError("a node cannot be changed in place")

    __hash__ = object.__hash__

    @property
    def tw(self) -> Namespace:
        return Namespace(self)

    # --- evaluating ---

    def _all(self) -> list[Node]:
        """The nodes this one needs, inputs first."""
        out, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                out.append(node)
            elif node._n["id"] not in seen:
                seen.add(node._n["id"])
                stack.append((node, True))
                stack += [(i, False) for i in _nodes_in(node._n["inputs"])]
        return out


def _nodes_in(value) -> list[Node]:
    if isinstance(value, Node):
        return [value]
    if isinstance(value, (list, tuple)):
        return [n for v in value for n in _nodes_in(v)]
    return [n for v in value.values() for n in _nodes_in(v)] if isinstance(value, dict) else []


def _binary(name: str, op: Callable):
    setattr(Node, f"__{name}__", lambda self, other: Node("binary", (self, other), op, name=name))
    setattr(Node, f"__r{name}__", lambda self, other: Node("binary", (other, self), op, name=name))


for _name in ("add", "sub", "mul", "matmul", "truediv", "mod", "pow", "floordiv", "lshift", "rshift", "and", "or", "xor"):
    _binary(_name, getattr(operator, f"{_name}_" if _name in ("and", "or") else _name))
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Node, f"__{_name}__", lambda self, other, op=getattr(operator, _name), n=_name: Node("binary", (self, other), op, name=n))
for _name in ("neg", "pos", "abs", "invert"):
    setattr(Node, f"__{_name}__", lambda self, op=getattr(operator, _name), n=_name: Node("unary", (self,), op, name=n))


class State:
    """What fits have learned: fitted operators and frozen values, by node."""

    def __init__(self):
        self.fitted: dict[int, object] = {}
        self.frozen: dict[int, object] = {}


def evaluate(node: Node, env: dict | None = None, mode: str = "fit_transform", state: State | None = None, params: dict | None = None):
    """The node's value: inputs from ``env``, operators fitted or, else, applied.

    Only the chosen branch of ``if_else`` and ``match`` is evaluated.  A node
    used several times is built once.  ``mode`` is "preview", "fit_transform",
    "fit", "transform" or "predict".
    """
    env, state, params = env or {}, state or State(), params or {}
    memo: dict[int, object] = {}

    def value(x):
        if isinstance(x, Node):
            if x._n["id"] not in memo:
                memo[x._n["id"]] = step(x)
            return memo[x._n["id"]]
        if is_choice(x):
            return value(resolved(x, params))
        if isinstance(x, list):
            return [value(v) for v in x]
        if isinstance(x, tuple):
            return tuple(value(v) for v in x)
        return {k: value(v) for k, v in x.items()} if isinstance(x, dict) else x

    def step(node: Node):
        n = node._n
        key, kind = n["id"], n["kind"]
        if n["frozen"] and mode in ("transform", "predict"):
            return state.frozen[key]
        if kind == "var":
            if n["name"] in env:
                out = env[n["name"]]
            elif n["value"] is not None:
                out = n["value"]
            else:
                raise KeyError(f"no value for the variable {n['name']!r}")
        elif kind == "mode":
            out = mode
        elif kind == "estimator":
            value(n["inputs"][0])
            out = state.fitted[n["value"]]
        elif kind == "if_else":
            test, yes, no = n["inputs"]
            out = value(yes if value(test) else no)
        elif kind == "match":
            query, targets, default = n["inputs"]
            found = value(query)
            if found not in targets and default is _REQUIRED:
                raise KeyError(found)
            out = value(targets.get(found, default))
        elif kind == "subsample":
            frame, size, how = value(n["inputs"][0]), *n["inputs"][1:]
            setting = get_config()["subsampling"]
            on = setting == "force" or setting == "default" and mode == "preview"
            out = _subsampled(frame, size, how) if on else frame
        elif kind == "apply":
            frame, y, options = value(n["inputs"][0]), value(n["inputs"][1]), n["inputs"][2]
            estimator = value(n["estimator"])
            if mode in ("transform", "predict", "score"):
                model = state.fitted[key]
            else:
                model = _fit(estimator, frame, y, options)
                state.fitted[key] = model
            out = model.transform(frame)
        else:
            out = n["compute"](*[value(i) for i in n["inputs"]])
        if n["frozen"]:
            state.frozen[key] = out
        return out

    return value(node)


_REQUIRED = object()


def _fit(estimator, frame: DataFrame, y, options: dict):
    """The fitted operator.

    ``how`` "cols" wraps column by column, "sub_frame" the selected columns at
    once, "no_wrap" nothing, "auto" what suits the operator.  A target ``y`` goes
    to operators whose ``fit`` takes one, unless ``unsupervised``; a column name
    of the frame is also set as the label column of ``pyspark.ml`` estimators.
    """
    from tablewright.operators.apply import ApplyToCols, ApplyToSubFrame
    from tablewright.operators.columns import ColumnTransformer

    how = options.get("how", "auto")
    if estimator is None or estimator == "passthrough":
        estimator = ApplyToCols(PassThrough())
    elif how == "cols" or how == "auto" and isinstance(estimator, ColumnTransformer):
        estimator = ApplyToCols(estimator, options.get("cols"), options.get("exclude_cols"), options.get("allow_reject", False))
    elif how == "sub_frame" or how == "auto" and (options.get("cols") is not None or options.get("exclude_cols") is not None):
        kept = (s.all() if options.get("cols") is None else s.make_selector(options["cols"])) - (s.cols() if options.get("exclude_cols") is None else s.make_selector(options["exclude_cols"]))
        estimator = ApplyToSubFrame(estimator, kept)
    if y is not None and not options.get("unsupervised", False):
        if isinstance(y, str) and hasattr(estimator, "labelCol"):
            estimator = estimator.copy({estimator.labelCol: y})
        elif hasattr(estimator, "fit") and "y" in inspect.signature(estimator.fit).parameters:
            return estimator.fit(frame, y=y) or estimator
        else:
            raise TypeError(f"{type(estimator).__name__} takes no target; pass unsupervised=True")
    if hasattr(estimator, "fit"):
        model = estimator.fit(frame)
        return model if model is not None else estimator
    estimator.fit_transform(frame)
    return estimator


def _subsampled(frame: DataFrame, n: int, how: str) -> DataFrame:
    if how == "head":
        return frame.limit(n)
    if how == "random":
        row = F.xxhash64(*[quoted(c) for c in frame.columns], F.lit(get_config()["subsampling_seed"]))
        return frame.orderBy(row).limit(n)
    raise ValueError(f"how must be 'head' or 'random', not {how!r}")


class Namespace:
    """What can be done with a node: ``node.tw.<method>``."""

    def __init__(self, node: Node):
        self.node = node

    def apply(self, estimator, y=None, cols=None, exclude_cols=None, how: str = "auto", allow_reject: bool = False, unsupervised: bool = False) -> Node:
        """Fit an operator here and apply it, see :func:`_fit` for ``how`` and ``y``."""
        if how not in ("auto", "cols", "sub_frame", "no_wrap"):
            raise ValueError("how must be 'auto', 'cols', 'sub_frame' or 'no_wrap'")
        options = {"cols": cols, "exclude_cols": exclude_cols, "how": how, "allow_reject": allow_reject, "unsupervised": unsupervised}
        return Node("apply", (self.node, y, options), estimator=estimator)

    def with_scoring(self, scoring: Callable[[DataFrame], float], name: str | None = None) -> Node:
        """The same value, which learners score by ``scoring``; several may be added."""
        node = self._marked()
        node._n["scorers"] = [*self.node._n.get("scorers", []), (name or getattr(scoring, "__name__", "score"), scoring)]
        return node

    def scorers(self) -> list[tuple[str, Callable]]:
        """Name and function of every score that the plan carries, the last node's first."""
        return next((n._n["scorers"] for n in reversed(self.node._all()) if n._n.get("scorers")), [])

    def applied_estimator(self) -> Node:
        """A node whose value is the fitted operator of this ``apply`` node."""
        if self.node._n["kind"] != "apply":
            raise TypeError("only apply nodes have an operator")
        return Node("estimator", (self.node,), value=self.node._n["id"])

    def apply_func(self, function: Callable, *args, **kwargs) -> Node:
        return deferred(function)(self.node, *args, **kwargs)

    def if_else(self, yes, no) -> Node:
        return Node("if_else", (self.node, yes, no))

    def match(self, targets: dict, default=_REQUIRED) -> Node:
        return Node("match", (self.node, targets, default))

    def select(self, cols) -> Node:
        return Node("select", (self.node, cols), lambda df, c: s.select(df, c))

    def drop(self, cols) -> Node:
        return Node("drop", (self.node, cols), lambda df, c: s.drop(df, c))

    def concat(self, others: list, axis: int = 0, on: str | None = None) -> Node:
        if axis not in (0, 1) or axis == 1 and on is None:
            raise ValueError("axis must be 0, or 1 with the row id to align on")
        return Node("concat", (self.node, others), lambda df, o: concat_rows(df, *o) if axis == 0 else concat_columns([df, *o], on))

    def subsample(self, n: int = 1000, how: str = "head") -> Node:
        if how not in ("head", "random"):
            raise ValueError(f"how must be 'head' or 'random', not {how!r}")
        return Node("subsample", (self.node, n, how))

    def freeze_after_fit(self) -> Node:
        node = self.clone()
        node._n["frozen"] = True
        return node

    def clone(self) -> Node:
        node = Node("pass")
        node._n |= self.node._n | {"id": next(_counter)}
        return node

    def _marked(self, **values) -> Node:
        node = self.clone()
        node._n |= values
        return node

    def set_name(self, name: str) -> Node:
        return self._marked(name=name)

    def set_description(self, text: str) -> Node:
        return self._marked(description=text)

    def mark_as_X(self) -> Node:
        return self._marked(role="X")

    def mark_as_y(self) -> Node:
        return self._marked(role="y")

    name = property(lambda self: self.node._n["name"])
    description = property(lambda self: self.node._n["description"])
    id = property(lambda self: self.node._n["id"])
    is_X = property(lambda self: self.node._n["role"] == "X")
    is_y = property(lambda self: self.node._n["role"] == "y")

    def eval(self, env: dict | None = None):
        return evaluate(self.node, env)

    def preview(self, env: dict | None = None):
        return evaluate(self.node, env, "preview")

    def get_vars(self) -> dict[str, Node]:
        return {n._n["name"]: n for n in self.node._all() if n._n["kind"] == "var"}

    def get_data(self) -> dict:
        return {k: n._n["value"] for k, n in self.get_vars().items() if n._n["value"] is not None}

    def set_data(self, data: dict) -> Node:
        """The graph with other example values of its variables."""
        unknown = sorted(set(data) - set(self.get_vars()))
        if unknown:
            raise KeyError(f"no variables named {unknown}")
        copies: dict[int, Node] = {}

        def copied(x):
            if isinstance(x, Node):
                return copies[x._n["id"]]
            if isinstance(x, (list, tuple)):
                return type(x)(copied(v) for v in x)
            return {k: copied(v) for k, v in x.items()} if isinstance(x, dict) else x

        for node in self.node._all():
            copy = node.tw.clone()
            copy._n |= {"inputs": copied(node._n["inputs"])} | ({"value": data[node._n["name"]]} if node._n["kind"] == "var" and node._n["name"] in data else {})
            copies[node._n["id"]] = copy
        return copies[self.node._n["id"]]

    def draw_graph(self) -> str:
        """The graph in the DOT language."""
        label = lambda n: (f"{n._n['kind']} {n._n['name'] or ''}".strip() + (f" ({n._n['role']})" if n._n["role"] else "")).replace('"', "'")
        nodes = self.node._all()
        lines = [f'  n{n._n["id"]} [label="{label(n)}"];' for n in nodes]
        lines += [f"  n{i._n['id']} -> n{n._n['id']};" for n in nodes for i in _nodes_in(n._n["inputs"])]
        return "digraph plan {\n" + "\n".join(lines) + "\n}\n"

    def full_report(self, env: dict | None = None, n_rows: int = 5) -> str:
        """Every step with its value, frames as table reports or, by setting, their first rows; as HTML."""
        from tablewright.operators.report import TableReport

        parts = [f"<pre>{html.escape(self.draw_graph())}</pre>"]
        for j, node in enumerate(self.node._all()):
            out = evaluate(node, env if env is not None else self.get_data(), "preview")
            shown = f"<pre>{html.escape(repr(out))}</pre>"
            if isinstance(out, DataFrame) and get_config()["use_table_report_data_ops"]:
                shown = TableReport(out, n_rows, compute_associations=False).html_snippet()
            parts.append(f"<h2>{j}: {html.escape(str(node._n['kind']))} {html.escape(str(node._n['name'] or ''))}</h2><p>{html.escape(node._n['description'] or '')}</p>{shown}")
        return f"<!doctype html><html><body>{''.join(parts)}</body></html>"

    def find(self, name: str) -> Node:
        found = [n for n in self.node._all() if n._n["name"] == name]
        if not found:
            raise KeyError(name)
        return found[0]

    def find_X_y(self) -> dict[str, Node]:
        """The nodes marked as X and y; each may be marked once."""
        marked = [n for n in self.node._all() if n._n["role"]]
        for role in ("X", "y"):
            if len({n._n["id"] for n in marked if n._n["role"] == role}) > 1:
                raise ValueError(f"several nodes are marked as {role}")
        return {n._n["role"]: n for n in marked}

    def describe_steps(self) -> str:
        return "\n".join(f"{j}: {n._n['kind']}{' ' + repr(n._n['name']) if n._n['name'] else ''}" for j, n in enumerate(self.node._all()))

    def choices(self) -> dict[str, Choice]:
        from tablewright.plans.choices import choices_in

        out: dict[str, Choice] = {}
        for n in self.node._all():
            for c in choices_in((n._n["inputs"], n._n["estimator"])):
                out[c.name] = c
        return out

    def describe_param_grid(self) -> str:
        return "\n".join(f"{c.name}: {c.describe()}" for c in self.choices().values())

    def describe_defaults(self) -> dict:
        return {k: c.default() for k, c in self.choices().items()}

    def make_learner(self, params: dict | None = None):
        from tablewright.plans.learners import Learner

        return Learner(self.node, params or {})

    def train_test_split(self, env: dict, key: str, test_size: float = 0.25, seed: int = 0):
        from tablewright.plans.learners import train_test_split

        return train_test_split(env, key, test_size, seed)

    def cross_validate(self, env: dict, key: str, scoring: Callable | None = None, cv: int = 5, seed: int = 0):
        return self.make_learner().cross_validate(env, key, scoring, cv, seed)

    def make_grid_search(self, env: dict, key: str, scoring: Callable | None = None, cv: int = 3, seed: int = 0):
        from tablewright.plans.learners import search

        return search(self.node, list(self._grid()), env, key, scoring, cv, seed)

    def make_randomized_search(self, env: dict, key: str, scoring: Callable | None = None, n_iter: int = 10, cv: int = 3, seed: int = 0):
        from tablewright.plans.learners import search

        return search(self.node, list(self._drawn(n_iter, seed)), env, key, scoring, cv, seed)

    def _drawn(self, n_iter: int, seed: int):
        rng = random.Random(seed)
        for _ in range(n_iter):
            yield {k: c.draw(rng) for k, c in self.choices().items()}

    def iter_learners_randomized(self, n_iter: int, seed: int = 0):
        for params in self._drawn(n_iter, seed):
            yield self.make_learner(params)

    def _grid(self):
        choices = self.choices()
        for values in itertools.product(*[range(len(c.grid())) for c in choices.values()]):
            yield {k: c.grid()[v] for (k, c), v in zip(choices.items(), values, strict=True)}

    def iter_learners_grid(self):
        for params in self._grid():
            yield self.make_learner(params)


def var(name: str, value=None) -> Node:
    """A named input, with an optional example value."""
    return Node("var", name=name, value=value)


def X(value=None) -> Node:
    return var("X", value).tw.mark_as_X()


def y(value=None) -> Node:
    return var("y", value).tw.mark_as_y()


def as_node(value) -> Node:
    return value if isinstance(value, Node) else Node("value", (value,), lambda v: v)


def deferred(function: Callable) -> Callable:
    """Calls of the function become nodes; arguments may hold nodes and choices."""

    def call(*args, **kwargs) -> Node:
        names = tuple(kwargs)
        return Node("function", (*args, *kwargs.values()), lambda *v: function(*v[: len(args)], **dict(zip(names, v[len(args) :], strict=True))), name=getattr(function, "__name__", None))

    return call


def eval_mode() -> Node:
    return Node("mode")
