"""Connected components of a link table, without leaving the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._spark import durable

#: Links that one task may hold: beyond, labels travel by joins.
TASK_LINKS = 500_000


def _united(table: pa.Table) -> pa.Table:
    """Components of a bounded number of links, by union and find."""
    names, place = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
    half = len(place) // 2
    parent = list(range(len(names)))
    for a, b in zip(place[:half].tolist(), place[half:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    for i in range(len(parent)):  # a parent is never larger than its child
        parent[i] = parent[parent[i]]
    return pa.table({"node": names.astype(np.int64), "component": names[np.array(parent, np.int64)].astype(np.int64)})


def connected_components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the least node names it.

    Up to ``task_links`` links are united in one task on an executor.  Beyond,
    every round takes the least label among a node's own and its neighbours' and
    then the label's label, so labels travel twice as far each time; each round
    is written to the checkpoint folder.  Only counts and a changed-or-not reach
    the driver.  Equal or repeated links are harmless; no links, no rows.
    """
    distinct = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if distinct.count() <= task_links:
        return durable(distinct.groupBy(F.lit(0).alias("all")).applyInArrow(_united, "node long, component long"))
    edges = durable(distinct.union(distinct.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = durable(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = durable(lower.join(onward, "label", "left").select("node", "old", F.least("label", "jump").alias("label")))
        labels = after.select("node", "label")
        if after.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")
