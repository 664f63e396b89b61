"""Structured Streaming forms of the operators.

A fitted column operator is a projection and :class:`AggJoiner` a stream-static
left join, so ``transform`` takes a streaming frame as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, timestamp_col: str, split_by: list[str], session_gap: int = 1800, lateness: str = "1 hour", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Sessions as they close: keys, begin, end, event count and ``aggregates``.

    A gap of exactly ``session_gap`` seconds stays in the session, as in the
    batch encoder.  State is kept until ``lateness`` has passed.
    """
    extra = [e.alias(n) for n, e in (aggregates or {}).items()]
    window = F.session_window(timestamp_col, f"{session_gap} seconds").alias("session")
    out = events.withWatermark(timestamp_col, lateness).groupBy(*split_by, window).agg(F.count(F.lit(1)).alias("n_events"), *extra)
    return out.select(*split_by, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_events", *(aggregates or {}))


def partial_fit_stream(stream: DataFrame, model, column: str, keep: Callable[[object], None], checkpoint: str):
    """Update an encoder with ``partial_fit`` on each micro-batch; ``keep`` gets the new one."""
    state = {"model": model}

    def update(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            state["model"] = state["model"].partial_fit(batch, column)
            keep(state["model"])

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).start()
