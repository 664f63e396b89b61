"""Settings of the library, by thread, with a context manager."""

from __future__ import annotations

import os
import threading
from contextlib import contextmanager

_DEFAULTS = {
    "cardinality_threshold": 40,
    "subsampling": "default",
    "subsampling_seed": 0,
    "enable_subsampling": True,
    "table_report_verbosity": 1,
    "max_plot_columns": 30,
    "max_association_columns": 30,
    "eager_preview": False,
    "float_precision": 3,
    "use_table_report": False,
    "use_table_report_data_ops": True,
    "data_dir": os.environ.get("TABLEWRIGHT_DATA", os.path.expanduser("~/tablewright_data")),
}
_local = threading.local()


def get_config() -> dict:
    """A copy of the current settings."""
    return dict(getattr(_local, "settings", _DEFAULTS))


def set_config(**settings) -> None:
    wrong = [k for k in settings if k not in _DEFAULTS]
    if wrong:
        raise ValueError(f"unknown settings: {wrong}")
    if settings.get("subsampling", "default") not in ("default", "force", "disable"):
        raise ValueError("subsampling must be 'default', 'force' or 'disable'")
    if settings.get("cardinality_threshold", 1) < 1:
        raise ValueError("cardinality_threshold must be positive")
    _local.settings = get_config() | settings


@contextmanager
def config_context(**settings):
    before = get_config()
    set_config(**settings)
    try:
        yield
    finally:
        _local.settings = before
