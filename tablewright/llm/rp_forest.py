"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._spark import durable
from tablewright.llm.components import connected_components

#: Trees, aimed leaf size, rows of the fit.
TREES, LEAF, SAMPLE = 10, 1024, 16_384
#: Overlap of a split in deviations of a random unit vector's projection, which
#: are one over the root of the dimension: about an eighth of a node's vectors
#: lie that near its split point and go both ways, whatever the dimension, so a
#: level leaves ``SHRINK`` of a node to each side.
SPILL, SHRINK = 0.16, 0.565
#: Rows that one task compares with as many others.
TILE = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe against overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Random directions by tree and level, and split points by tree node.

    Split points are medians over the sample as far as a node holds 16 sample
    rows; below, they are the direction's median over the whole sample.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        d = sample.shape[1] if sample.size else 1
        self.spill = spill / np.sqrt(d)
        directions = rng.standard_normal((trees, depth, d))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.nodes: list[list[np.ndarray]] = []
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            levels = []
            for level in range(depth):
                p = sample @ self.directions[t, level]
                points = np.full(1 << level if (1 << level) * 16 <= max(16, len(sample)) else 1, np.median(p))
                if len(points) > 1 or level == 0:
                    for j in range(len(points)):
                        inside = p[node == j]
                        points[j] = np.median(inside) if len(inside) >= 16 else points[j]
                levels.append(points)
                node = 2 * node + (p >= (points[node] if len(points) > 1 else points[0]))
            self.nodes.append(levels)

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they reach; a row near a split goes both ways."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            p = (x @ self.directions[tree, level])[row]
            points = self.nodes[tree][level]
            gap = p - (points[node] if len(points) > 1 else points[0])
            left, right = gap < self.spill, gap >= -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(least: float):
    """Links inside a tile pair of a leaf, each counted in one leaf only.

    Two vectors that meet in several leaves are counted in the first of them.
    Links are summed by vector, and a spanning forest of them is returned, so
    what leaves a task grows with its vectors, not with its pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        node = table.column("node").to_numpy()
        weight = table.column("copies").to_numpy()
        side = table.column("tile").to_numpy()
        x = unit(np.stack(table.column("embedding").to_numpy(zero_copy_only=False)))
        lists = [np.frombuffer(b, np.int64) for b in table.column("leaves").to_pylist()]
        width = max(map(len, lists))
        met = np.full((len(lists), width), -1, np.int64)
        for i, own in enumerate(lists):
            before = own[own < leaf]
            met[i, : len(before)] = before
        low, high = side.min(), side.max()
        links = np.zeros(len(x), np.int64)
        parent = list(range(len(x)))
        left = np.flatnonzero(side == low)
        right = np.flatnonzero(side == high)
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            near = x[rows] @ x[right].T >= least
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            step = max(256, (1 << 20) // max(1, width))
            for c in range(0, len(i), step):
                a, b = i[c : c + step], j[c : c + step]
                for w in range(width):  # drop the pairs that met in an earlier leaf
                    new = ~((met[a, w, None] == met[b]) & (met[a, w, None] >= 0)).any(axis=1)
                    a, b = a[new], b[new]
                    if not len(a):
                        break
                links += np.bincount(a, weights=weight[b], minlength=len(x)).astype(np.int64)
                links += np.bincount(b, weights=weight[a], minlength=len(x)).astype(np.int64)
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = _root(parent, p), _root(parent, q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        root = np.array([_root(parent, i) for i in range(len(x))], np.int64)
        some = (links > 0) | (root != np.arange(len(x)))
        return pa.table({"node": node[some].astype(np.int64), "links": links[some], "root": node[root[some]].astype(np.int64)})

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf_rows: int = LEAF
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one dimension are linked at a cosine of
    ``least`` or more, in double precision.  Equal vectors are one node that
    counts its copies.  The forest is fitted on at most ``SAMPLE`` nodes, those
    of the least hash; every node is routed through every tree, and goes to both
    sides of a split within ``SPILL`` of it.  Vectors are compared inside leaves
    and the links of all trees united; a link may be missed when all trees part
    its ends, none below the cosine is ever made.  A leaf of more than ``TILE``
    vectors is compared tile against tile in separate tasks.

    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing, as do those with a null label.  A repeated id counts row
    by row; a component's id is its least non-null id.  Rows of equal hash are
    drawn for the fit by their number.  An empty table gives an empty result.
    """
    name = lambda c: F.col(f"`{c}`")
    slim = vectors.select(name(id_col).alias("vec_id"), name(label_col).alias("label"), name(vector_col).cast("array<double>").alias("embedding"))
    sound = F.expr(
        "label is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    good = slim.where(F.coalesce(sound, F.lit(False)))
    nodes = durable(
        good.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log(max(1, largest) / leaf_rows) / -np.log(SHRINK))))
    drawn = nodes.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    sizes = [len(x) for x in drawn]
    dimension = max(set(sizes), key=sizes.count) if sizes else 1
    sample = unit(np.array([x for x in drawn if len(x) == dimension])) if drawn else np.zeros((0, 1))
    forest = Forest(sample, depth if drawn else 0, trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            reached: list[list[int]] = [[] for _ in rows]
            usual = np.array([j for j, x in enumerate(rows) if len(x) == dimension], np.int64)
            x = unit(np.array([rows[j] for j in usual])) if len(usual) else np.zeros((0, dimension))
            for t in range(forest.trees):
                row, leaf = forest.leaves(x, t)
                for r, at in zip(usual[row].tolist(), (leaf + (t << forest.depth)).tolist(), strict=True):
                    reached[r].append(at)
            for r, x_row in enumerate(rows):
                if len(x_row) != dimension:
                    reached[r] = [0]  # other dimensions are compared in one leaf of their own
            packed = [np.array(sorted(r), np.int64) for r in reached]
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column(0), "leaf": pa.array([p.tolist() for p in packed], pa.list_(pa.int64())), "leaves": [p.tobytes() for p in packed]}
            )

    routed = durable(nodes.select("node", "embedding").mapInArrow(route, "node long, leaf array<long>, leaves binary"))
    spread = routed.select("node", "leaves", F.explode("leaf").alias("leaf")).join(nodes.select("node", "label", "copies", "embedding"), "node")
    spread = spread.withColumn("dimension", F.size("embedding"))
    key = ["label", "dimension", "leaf"]
    tiles = spread.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 1")
    tiled = (
        spread.join(tiles, key, "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    )
    found = durable(tiled.groupBy(*key, "low", "high").applyInArrow(_compare(least), "node long, links long, root long"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    owned = nodes.join(degree, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = owned.groupBy("component").agg(F.min("first").alias("component_id"))
    named = owned.join(least_id, "component").select(F.col("label").alias("own"), "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    checked = slim.withColumn("own", F.when(F.coalesce(sound, F.lit(False)), F.col("label")))
    out = checked.join(named, ["own", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
