"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Documents are rows with an integer
id and a text; every operator takes the column names as arguments, ignores
columns it does not name, and states in its docstring what it does with nulls,
ties, repeated rows and empty tables.
"""
