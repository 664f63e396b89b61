"""Lazy plans over frames, and the queries registered with the driver."""

from tablewright.plans.choices import choose_bool, choose_float, choose_from, choose_int, optional  # noqa: F401
from tablewright.plans.graph import Node, X, as_node, deferred, eval_mode, evaluate, var, y  # noqa: F401
from tablewright.plans import operator_queries  # noqa: F401
from tablewright.plans.queries import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
