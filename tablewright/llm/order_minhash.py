"""Near-duplicate documents by order min-hash and banded alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import _exchange as X
from tablewright.llm import _text as T
from tablewright.llm._spark import durable, free_name, numbered
from tablewright.llm.components import connected_components

SHINGLE = 5
#: Sketches of a document, and labelled shingles sampled for each.  Two texts of
#: which a share J of the shingles is common, in one order, agree in one sketch
#: with probability about J**2; they meet in one of all with 1 - (1 - J**2)**32,
#: which is 0.98 at J = 0.34 and 0.999 at J = 0.45.
SKETCHES, SAMPLED = 32, 2
#: Texts of at most so many shingles also meet in every shingle they share.
FEW = 10
#: Buckets of a text's bag of words, each a byte.
BAG = 128
#: Rounds in which each text is compared with one likely partner.
ROUNDS = 2
#: Members of a sketch group that one task compares with as many others, and
#: rows that it holds in all.
TILE, TASK_ROWS = 512, 20_000
_ODD = np.random.default_rng(7).integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.random.default_rng(8).integers(1, 1 << 63, SAMPLED, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


# --- one document -----------------------------------------------------------


def labelled_shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """``size``-word shingles of one document, each with the number of its occurrence."""
    grams = T.window_hashes(hashes, size)
    if not len(grams):
        return grams
    order, begin = T.group_sorted(grams, stable=True)
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = np.arange(len(grams)) - np.repeat(begin, np.diff(np.append(begin, len(grams))))
    return T.mix(grams + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The order sketches: the ``SAMPLED`` least shingles under each order, in the order of the text."""
    ranked = shingles[None, :] * _ODD[:, None]
    least = np.empty((SKETCHES, min(SAMPLED, len(shingles))), np.int64)
    rows = np.arange(SKETCHES)
    for j in range(least.shape[1]):
        least[:, j] = ranked.argmin(axis=1)
        ranked[rows, least[:, j]] = np.iinfo(np.uint64).max
    least.sort(axis=1)
    return T.mix((shingles[least] * _ORDER[: least.shape[1]]).sum(axis=1, dtype=np.uint64) ^ _ODD)


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys that bring a text together with its candidates: its sketches first; none below five words."""
    shingles = labelled_shingles(hashes)
    if not len(shingles):
        return shingles
    return np.concatenate((sketch(shingles), T.mix(shingles[:FEW] ^ _ORDER[0]) if len(shingles) <= FEW else shingles[:0]))


def bag_of(hashes: np.ndarray) -> np.ndarray:
    """Words counted in ``BAG`` buckets, 255 at most.

    An edit moves the sum of absolute differences by 2 at most, and cutting the
    counts off only lowers it, so bags tell for sure which texts are too far.
    """
    return np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)


def _hashes(text: str | None) -> np.ndarray:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    begin, end, _ = T.words(buf, np.array([0, len(buf)]))
    return T.word_hashes(buf, begin, end)


def _print(text: str) -> bytes:
    return hashlib.blake2b(b" ".join(text.encode().split()), digest_size=16).digest()


# --- a pair -----------------------------------------------------------------


def most_edits(n: int, m: int, least: float) -> int:
    """Edits that leave two texts of ``n`` and ``m`` words similar."""
    return int((1 - least) * max(n, m) + 1e-9)


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance of ``a`` and ``b`` if it is at most ``most``.

    Banded alignment: of every column of the edit matrix only the ``2 most + 1``
    cells around the diagonal are kept, as the bits of two integers that say
    where the distance rises and falls from one cell to the next; a column costs
    a dozen operations on these integers.  What both begin or end with is cut
    off first, which leaves the distance as it is.
    """
    if abs(len(a) - len(b)) > most:
        return None
    for _ in range(2):  # the common begin, then, reversed, the common end
        k = min(len(a), len(b))
        other = np.flatnonzero(a[:k] != b[:k])
        cut = int(other[0]) if len(other) else k
        a, b = a[cut:][::-1], b[cut:][::-1]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    width = 2 * most + 1
    whole, bottom = (1 << width) - 1, 1 << (2 * most)
    places: dict[int, int] = {}
    needed = set(b.tolist())
    for r, word in enumerate(a.tolist()):
        if word in needed:
            places[word] = places.get(word, 0) | (1 << r)
    # Bit k of column j stands for row j - most + k; rows above the first do not rise.
    rises, falls = whole ^ ((1 << most) - 1), 0
    distance = most if n >= most else n
    for j, word in enumerate(b.tolist()):
        at = places.get(word, 0)
        shift = j - most
        match = (at >> shift if shift >= 0 else at << -shift) & whole
        same = ((((match & rises) + rises) ^ rises) | match | falls) & whole
        right_up = (falls | ~(same | rises)) & whole
        right_down = same & rises
        row_end = n - 1 - j + most  # the bit of the last row in this column
        if row_end >= 2 * most:
            distance += not same & bottom
        else:
            distance += ((right_up >> row_end) & 1) - ((right_down >> row_end) & 1)
        down = same >> 1
        rises = (right_down | ~(down | right_up)) & whole
        falls = down & right_up
    return distance if distance <= most else None


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two word sequences are near duplicates.

    They are when they share a five-word shingle and their alignment, one minus
    edits over the longer length, reaches ``least``.
    """
    most = most_edits(len(a), len(b), least)
    if abs(len(a) - len(b)) > most or not _shared(labelled_shingles(a), labelled_shingles(b)):
        return False
    return edit_distance_within(a, b, most) is not None


# --- tasks ------------------------------------------------------------------


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, prints, keys, bags = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = _hashes(text)
            n_words.append(len(hashes))
            prints.append(_print(text) if len(hashes) else None)
            keys.append(keys_of(hashes).view(np.int64))
            bags.append(bag_of(hashes).tobytes() if len(hashes) >= SHINGLE else None)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bags, pa.binary())],
            ["row", "n_words", "print", "keys", "bag"],
        )


def _may_be_similar(least: float):
    """Pairs of a batch whose lengths and bags allow similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(j).to_numpy() for j in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for j in (4, 5))
            most = ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)
            ok = (np.abs(n - m) <= most) & (np.abs(x - y).sum(axis=1) <= 2 * most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


class _Text:
    """A text's word hashes and its labelled word pairs.

    An edit breaks two pairs at most, so similar texts share at least
    ``needed_pairs``; the number decides most comparisons without alignment.
    """

    def __init__(self, text: str | None):
        self.hashes = _hashes(text)
        self.pairs = labelled_shingles(self.hashes, 2)


def needed_pairs(n, m, least: float):
    longer = np.maximum(n, m)
    return longer - 1 - 2 * ((1 - least) * longer + 1e-9).astype(np.int64)


def _aligned(a: _Text, b: _Text, least: float) -> bool:
    """:func:`similar` of two texts that are known to share a shingle."""
    n, m = len(a.hashes), len(b.hashes)
    most = most_edits(n, m, least)
    if abs(n - m) > most or _shared(a.pairs, b.pairs) < max(n, m) - 1 - 2 * most:
        return False
    return edit_distance_within(a.hashes, b.hashes, most) is not None


class _Index:
    """The word pairs of some texts, to count what each shares with another."""

    def __init__(self, texts: list[_Text]):
        flat = np.concatenate([t.pairs for t in texts])
        by = np.argsort(flat)
        self.owner = np.repeat(np.arange(len(texts)), [len(t.pairs) for t in texts])[by]
        self.keys, self.first = np.unique(flat[by], return_index=True)
        self.size = np.diff(np.append(self.first, len(flat)))
        self.n = len(texts)

    def shared(self, text: _Text) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, text.pairs), len(self.keys) - 1)
        at = at[self.keys[at] == text.pairs]
        length = self.size[at]
        ends = np.cumsum(length)
        if not len(at):
            return np.zeros(self.n, np.int64)
        return np.bincount(self.owner[np.repeat(self.first[at] - (ends - length), length) + np.arange(ends[-1])], minlength=self.n)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, None
        for batch in batches:
            ok = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, text = b, _Text(text_b)
                ok.append(_aligned(_Text(text_a), text, least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _first_meeting(left: np.ndarray, right: np.ndarray, sketches: np.ndarray, group: int) -> np.ndarray:
    """Which pairs share no sketch before that of this group (or none at all), told by the sketches' upper halves."""
    ok = np.ones(len(left), bool)
    for low in range(0, len(left), 1 << 15):
        a, b = left[low : low + (1 << 15)], right[low : low + (1 << 15)]
        same = sketches[a] == sketches[b]
        first = same.argmax(axis=1)
        ok[low : low + len(a)] = ~same.any(axis=1) | (sketches[a, first] == group >> 32)
    return ok


_MEMBER = ("sketch", "length_class", "first_tile", "second_tile", "asks", "own", "node", "component", "n_words")


def _units(table: pa.Table) -> Iterator[np.ndarray]:
    """Row positions of each unit of work among a task's rows."""
    columns = [table.column(c).to_numpy() for c in _MEMBER[:4]]
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new)[1:])


def _pairs(unit: np.ndarray, columns: dict[str, np.ndarray], bags: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a unit that must be compared.

    One side asks, the other is asked.  The two are in different components,
    near enough in length and bag, not both of the shorter length class, and
    share no earlier sketch.
    """
    asks = columns["asks"][unit]
    left, right = unit[asks], unit[~asks]
    n, component, own, node = (columns[c] for c in ("n_words", "component", "own", "node"))
    longer = np.maximum(n[left][:, None], n[right][None, :])
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    ok = (component[left][:, None] != component[right][None, :]) & (np.abs(n[left][:, None] - n[right][None, :]) <= most) & (own[left][:, None] | own[right][None, :])
    i, j = np.nonzero(ok)
    most, left, right = most[i, j], left[i], right[j]
    near = np.zeros(len(i), bool)
    for low in range(0, len(i), 1 << 15):
        at = slice(low, low + (1 << 15))
        near[at] = np.abs(bags[left[at]].astype(np.int16) - bags[right[at]]).sum(axis=1) <= 2 * most[at]
    left, right = left[near], right[near]
    new = _first_meeting(left, right, sketches, columns["sketch"][unit[0]])
    return left[new], right[new]


def _columns(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    bags = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
    sketches = table.column("sketches").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in _MEMBER}, bags, sketches


def _flagged(least: float):
    """The members of a task's units that have a partner to be compared with."""

    def run(table: pa.Table) -> pa.Table:
        columns, bags, sketches = _columns(table)
        some = np.zeros(table.num_rows, bool)
        for unit in _units(table):
            for side in _pairs(unit, columns, bags, sketches, least):
                some[side] = True
        return table.filter(pa.array(some)).select(["part", *_MEMBER, "bag", "sketches"])

    return run


def _crossing(least: float):
    """Links between components, verified here; one for each two that are joined."""

    def run(table: pa.Table) -> pa.Table:
        columns, bags, sketches = _columns(table)
        texts, node, component = table.column("text"), columns["node"], columns["component"]
        known: dict[int, _Text] = {}
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            parent.setdefault(g, g)
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        def text(i: int) -> _Text:
            key = int(node[i])
            if key not in known:
                known[key] = _Text(texts[i].as_py())
            return known[key]

        found: set[tuple[int, int]] = set()
        compared: set[tuple[int, int]] = set()
        n = columns["n_words"]
        for unit in _units(table):
            left, right = _pairs(unit, columns, bags, sketches, least)
            if not len(left):
                continue
            asked, place = np.unique(right, return_inverse=True)
            index = _Index([text(j) for j in asked.tolist()])
            askers, first = np.unique(left, return_index=True)  # pairs come asker by asker
            for i, at in zip(askers.tolist(), np.split(place, first[1:]), strict=True):
                shared = index.shared(text(i))[at]
                enough = shared >= needed_pairs(n[i], n[asked[at]], least)
                for j in asked[at[enough][np.argsort(-shared[enough], kind="stable")]].tolist():
                    pair = (min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j])))
                    g, h = root(int(component[i])), root(int(component[j]))
                    if g == h or pair in compared:
                        continue
                    compared.add(pair)
                    if edit_distance_within(text(i).hashes, text(j).hashes, most_edits(int(n[i]), int(n[j]), least)) is not None:
                        parent[max(g, h)] = min(g, h)
                        found.add(pair)
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def _upper_half(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


# --- the whole --------------------------------------------------------------


def _classes(keyed: DataFrame, row: str, least: float, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, n_words, copies, class_id, kept)`` of a numbered table."""
    spark = keyed.sparkSession
    slim = keyed.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = keyed.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    with X.small_batches(spark):
        sketched = durable(slim.mapInArrow(_sketch_rows, "row long, n_words long, print binary, keys array<long>, bag binary").join(ids, "row"))
    # The row that stands for a class: least id, null ids last, then the least number.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = durable(
        sketched.where("print is not null").groupBy("print").agg(first, F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("bag").alias("bag"), F.first("n_words").alias("n_words"))
    ).withColumn("node", F.col("first.row"))
    each = classes.select("node", F.explode("keys").alias("sketch"))
    groups = each.groupBy("sketch").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub"), F.max("node").alias("far")).where("members > 1")
    met = durable(each.join(groups, "sketch"))
    upper = F.transform(F.slice("keys", 1, SKETCHES), _upper_half)
    traits = classes.where("bag is not null").select("node", "n_words", "bag", upper.alias("sketches"))
    texts = slim.withColumnRenamed("row", "node")

    def both(pairs: DataFrame, frame: DataFrame, columns: list[str]) -> DataFrame:
        """``pairs`` with columns of both ends; b, the end with many pairs, first."""
        for end in ("b", "a"):
            pairs = pairs.join(frame.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        order = ["a", "b", "n_words_a", "n_words_b", "bag_a", "bag_b"]
        near = durable(both(pairs, traits, ["n_words", "bag"]).select(order).mapInArrow(_may_be_similar(least), "a long, b long"))
        with X.small_batches(spark):
            full = both(near, texts, ["text"]).select("a", "b", "text_a", "text_b")
            return durable(full.mapInArrow(_verify(least), "a long, b long"))

    links = None
    parts = None
    for _ in range(ROUNDS):
        tried = verified(_likeliest(met, parts))
        if tried.isEmpty():
            break
        links = tried if links is None else durable(links.union(tried))
        parts = connected_components(links)
    if parts is None:
        parts = classes.select("node", F.col("node").alias("component")).limit(0)
    more = _between_components(met, parts, traits, texts, least)
    if not more.isEmpty():
        parts = connected_components(more if links is None else links.union(more))
    owned = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winner = owned.groupBy("component").agg(F.min("first").alias("winner"))
    named = owned.join(winner, "component").select("print", "copies", "winner")
    own = sketched.select("row", "doc_id", "n_words", "print").join(named, "print", "left")
    return own.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.when(F.col("winner").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("class_id"),
        F.coalesce(F.col("row") == F.col("winner.row"), F.lit(True)).alias("kept"),
    )


def _likeliest(met: DataFrame, parts: DataFrame | None) -> DataFrame:
    """One pair ``(a, b)`` for each node: with the hub that it shares most keys with.

    A group's hubs are its least and its greatest node; those in the node's own
    component do not count.  Only rows and hubs meet, never the pairs of a group.
    """
    pairs = met.select(F.col("node").alias("a"), F.explode(F.array("hub", "far")).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    if parts is not None:
        for end in ("b", "a"):
            pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        pairs = pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    best = pairs.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("least"))).alias("best"))
    return best.select("a", (-F.col("best.least")).alias("b"))


def _between_components(met: DataFrame, parts: DataFrame, traits: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between members of a sketch group that are in two components so far.

    Groups that hold one component are done.  In the others a member goes to its
    length class and, as the shorter side, to the next: similar texts differ by a
    class at most.  Of two members in different components one at least is
    outside the class's largest component: these members ask, all are asked.
    Both sides are cut into tiles of about ``TILE`` members and each two tiles
    are a unit of work, many small units to a task, so that no task grows with a
    group.  Members without a near enough bag drop out before texts are fetched,
    and a pair that shares several sketches is compared in the first.
    """
    named = met.select("sketch", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("sketch").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sketch")
    step = float(-np.log(least)) + 1e-9
    classed = named.join(mixed, "sketch").join(traits, "node").withColumn("length_class", F.floor(F.log("n_words") / step).cast("int"))
    sides = durable(
        classed.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumn("length_class", F.when(F.col("own"), F.col("length_class")).otherwise(F.col("length_class") + 1))
        .select("sketch", "length_class", "own", "node", "component", F.col("n_words").cast("long").alias("n_words"), "bag", "sketches")
    )
    key = ["sketch", "length_class"]
    counts = sides.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = (
        counts.groupBy(*key)
        .agg(F.sum("n").alias("members"), F.max("any").alias("any"), F.max(F.struct("n", "component")).alias("largest"))
        .where("any and members > largest.n")
        .select(*key, "members", F.col("largest.n").alias("most"), F.col("largest.component").alias("main"), tiles(F.col("members") - F.col("largest.n")).alias("askers"), tiles(F.col("members")).alias("asked"))
    )
    placed = sides.join(sizes, key)
    tile = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = placed.where("component <> main").withColumns({"asks": F.lit(True), "first_tile": tile(F.col("askers"))}).withColumn("second_tile", every(F.col("asked")))
    asked = placed.withColumns({"asks": F.lit(False), "second_tile": tile(F.col("asked"))}).withColumn("first_tile", every(F.col("askers")))
    columns = [*_MEMBER, "bag", "sketches"]
    rows = sizes.agg(F.sum((F.col("members") - F.col("most")) * F.col("asked") + F.col("members") * F.col("askers"))).first()[0] or 0
    n_parts = max(1, -(-rows // TASK_ROWS)) * 4
    dealt = asking.select(columns).unionByName(asked.select(columns)).withColumn("part", F.pmod(F.xxhash64("sketch", "length_class", "first_tile", "second_tile"), F.lit(n_parts)).cast("long"))
    member = "part long, sketch long, length_class int, first_tile int, second_tile int, asks boolean, own boolean, node long, component long, n_words long, bag binary, sketches array<int>"
    # Counts given by hand: small rows, but much work in each part.
    flagged = durable(dealt.repartition(n_parts, "part").groupBy("part").applyInArrow(_flagged(least), member))
    whole = flagged.join(texts, "node").repartition(n_parts, "part")
    return durable(whole.groupBy("part").applyInArrow(_crossing(least), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, copies, class_id, kept.

    Documents with equal word sequences are one node.  Nodes that share a key
    (see :func:`keys_of`) are candidates; a pair is linked when :func:`similar`
    holds on the whole texts, that is when the banded alignment says so.
    ``class_id`` is the least id reachable by links and ``kept`` marks one row
    of each class, the first with that id.

    Every candidate pair that could join two classes is decided.  First each
    node is compared, a few times, with one likely partner (see
    :func:`_likeliest`), then what still lies in different components is compared
    tile against tile (see :func:`_between_components`); pairs inside one
    component are spared.

    Null and wordless texts never link and are all kept.  A text of fewer than
    five words has no shingle and links to equal ones only.  Of rows that repeat
    an id, each is a document of its own; a null id is larger than any other, so
    a class is null only where all ids are.  Very long texts are compared whole.
    An empty table gives an empty result.
    """
    row = free_name(docs, "row")
    return _classes(numbered(docs.select(id_col, text_col), row), row, least, id_col, text_col).drop("row")


def one_of_each(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`, columns unchanged.

    Rows are followed by a number of their own, so repeated and null ids lose or
    keep exactly the rows that ``kept`` says; wordless texts all stay.
    """
    row = free_name(docs, "row")
    keyed = numbered(docs, row)
    kept = _classes(keyed, row, least, id_col, text_col).where("kept").select(F.col("row").alias(row))
    return keyed.join(kept, row, "left_semi").select(docs.columns)
