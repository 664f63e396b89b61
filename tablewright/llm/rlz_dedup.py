"""Remove repeated word passages by a parse relative to all earlier texts.

Every text is parsed against the seeds (20-word windows) of all blocks, which
tell where their words stand first.  A factor opens at a seed that stands
earlier and copies its reference word by word as far as the reference leads;
the seeds that straddle its end were looked up like all others and open factors
of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import _exchange as X
from tablewright.llm import _text as T
from tablewright.llm._spark import free_name

ANCHOR = 10
#: Makes a second hash of a window's words: prints have 96 bits in all, so a
#: chance match among 10**12 windows has a probability below 0.00001.
CHECK = np.uint64(0xA0761D6478BD642F)


class _Seeds:
    """A block's words and the seeds of its factors.

    A seed is a window of ``size`` words of one text.  Its *anchor* is the
    smallest hash of the ten-word windows inside: equal seeds have equal
    anchors, so a seed whose anchor occurs once in the corpus is new.
    """

    def __init__(self, block: X.Block, size: int):
        self.begin, self.end, self.doc = T.words(block.buf, block.starts)
        hashes = T.word_hashes(block.buf, self.begin, self.end)
        whole = T.whole_windows(self.doc, size)
        self.at = np.flatnonzero(whole)
        anchor = min(ANCHOR, size)
        grams = T.window_hashes(hashes, anchor)
        # The place of the least hash, the leftmost of equals, in its lower bits.
        bits = np.uint64(max(1, len(grams).bit_length()))
        placed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        spot = (T.sliding(np.minimum, placed, size - anchor + 1)[self.at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64) if len(self.at) else self.at
        self.anchor = T.mix(grams[spot] + np.uint64(1))
        self.print = T.window_hashes(hashes, size)[self.at]
        self._hashes, self._size = hashes, size
        self.place = self.at - np.searchsorted(self.doc, np.arange(len(block)))[self.doc[self.at]]
        once = np.flatnonzero(np.diff(spot, prepend=-1))
        self.keys, counts = np.unique(self.anchor[once], return_counts=True)
        self.again = counts > 1

    def checks(self, some: np.ndarray) -> np.ndarray:
        """A second, shorter print of some seeds."""
        sums, at = T.prefix_hashes(T.mix(self._hashes ^ CHECK)), self.at[some]
        return (T.span_hashes(sums, at, at + self._size) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, replies: dict[int, bytes], n: int) -> np.ndarray:
        flags = X.read_flags(self.keys, replies, n) | self.again
        return np.flatnonzero(flags[np.searchsorted(self.keys, self.anchor)]) if len(self.keys) else np.zeros(0, np.int64)


def _groups(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by print, id and place; where each print begins in it; each one's print, numbered."""
    order = np.lexsort((places, ids, checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    index = np.empty(len(k), np.int64)
    index[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), index


class _First:
    """A block's distinct prints among some seeds, with the least id and place of each."""

    def __init__(self, block: X.Block, seeds: _Seeds, some: np.ndarray):
        ids = block.ids[seeds.doc[seeds.at[some]]]
        checks = seeds.checks(some)
        order, first, self.index = _groups(seeds.print[some], checks, ids, seeds.place[some])
        at = order[first]
        self.keys, self.checks = seeds.print[some][at], checks[at]
        self.ids, self.places = ids[at], seeds.place[some][at].astype(np.int32)


def _first_reply(questions: list[X.Question]) -> list[bytes]:
    """Id and place at which each print stands first, in any block."""
    keys, checks, ids, places = (
        [X.read_array(q[name], kind) for q in questions] for name, kind in (("keys", np.uint64), ("checks", np.uint32), ("ids", np.int64), ("places", np.int32))
    )
    i, p = np.concatenate(ids), np.concatenate(places)
    order, first, index = _groups(np.concatenate(keys), np.concatenate(checks), i, p)
    i, p = i[order[first]][index], p[order[first]][index]
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    return [X.pack_array(np.frombuffer(a.tobytes() + b.tobytes(), np.uint8)) for a, b in zip(np.split(i, cuts), np.split(p, cuts), strict=True)]


def _read_first(keys: np.ndarray, replies: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    ids, places = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for b, at in X.by_bucket(keys, n):
        data = X.read_array(replies[b], np.uint8)
        ids[at], places[at] = np.frombuffer(data[: 8 * len(at)].tobytes(), np.int64), np.frombuffer(data[8 * len(at) :].tobytes(), np.int32)
    return ids, places


def parse(block: X.Block, seeds: _Seeds, some: np.ndarray, first: _First, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The old seeds of a block, and the id and place of each one's reference.

    A seed is old when its words also start in a document of smaller id, in any
    block, or earlier in the same row; it refers to the first such start.
    """
    own = block.ids[seeds.doc[seeds.at[some]]]
    ref_id, ref_place = ids[first.index], places[first.index]
    old = ref_id < own
    # Within one row the later of two equal seeds refers to the first.
    row = seeds.doc[seeds.at[some]]
    order = np.lexsort((seeds.at[some], row, first.index))
    i, r = first.index[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1])
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = ~new
    inside = later & ~old
    lead = np.empty(len(order), np.int64)
    lead[order] = leader
    ref_id = np.where(inside, own, ref_id)
    ref_place = np.where(inside, seeds.place[some][lead], ref_place)
    old |= later
    return some[old], ref_id[old], ref_place[old]


def factors(block: X.Block, seeds: _Seeds, parsed: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Factors ``(document, first word, words, reference id, reference's first word)``.

    A factor of at least ``size`` words opens at an old seed that does not go on
    with the one before, and grows while the next seed refers to the next word of
    the same reference.  Seeds refer to the first start of their words, so a copy
    of a copy is told from the original, and a factor ends where its reference
    itself begins to repeat a still earlier text.  Factors may overlap: the seeds
    across the end of one are in the next.
    """
    old, ref_id, ref_place = parsed
    at = seeds.at[old]
    if not len(at):
        return np.zeros((0, 5), np.int64)
    doc = seeds.doc[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (ref_id[1:] != ref_id[:-1]) | (ref_place[1:] != ref_place[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([doc[first], at[first], at[last] - at[first] + size, ref_id[first], ref_place[first]], axis=1)


def _exchanges(docs: DataFrame, size: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    found = X.blocks(docs, id_col, text_col, carry=carry)
    n = X.buckets(docs)

    def ask_anchors(block: X.Block, _: dict, n: int) -> Iterator[tuple[int, X.Question]]:
        yield from X.repeated_keys_question(_Seeds(block, size).keys, n)

    def ask_prints(block: X.Block, answers: dict, n: int) -> Iterator[tuple[int, X.Question]]:
        seeds = _Seeds(block, size)
        first = _First(block, seeds, seeds.candidates(answers["anchors"], n))
        for b, at in X.by_bucket(first.keys, n):
            yield b, {"keys": X.pack_array(first.keys[at]), "checks": X.pack_array(first.checks[at]), "ids": X.pack_array(first.ids[at]), "places": X.pack_array(first.places[at])}

    anchors = X.answer(X.ask(found, ask_anchors, ("keys",), n), X.repeated_keys_reply, ("keys",))
    with_anchors = X.returned(found, anchors, "anchors")
    fields = ("keys", "checks", "ids", "places")
    prints = X.answer(X.ask(with_anchors, ask_prints, fields, n), _first_reply, fields)
    return X.returned(with_anchors, prints, "prints"), n


def _parsed(block: X.Block, answers: dict, size: int, n: int) -> tuple[_Seeds, tuple]:
    seeds = _Seeds(block, size)
    some = seeds.candidates(answers["anchors"], n)
    first = _First(block, seeds, some)
    return seeds, parse(block, seeds, some, first, *_read_first(first.keys, answers["prints"], n))


def duplicate_factors(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, first_word, n_words, ref_doc_id, ref_first_word)`` of every factor of ``size`` words or more.

    The words of a factor stand in the referred document from ``ref_first_word``
    on.  See :func:`remove_repeats` for what counts as a repeat.
    """
    found, n = _exchanges(docs, size, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in X.unpack(batch):
                seeds, parsed = _parsed(block, X.answers_of(batch, row), size, n)
                got = factors(block, seeds, parsed, size)
                first_word = np.searchsorted(seeds.doc, np.arange(len(block)))
                ids = block.ids[got[:, 0]]
                out = {"doc_id": pa.array(ids, pa.int64(), mask=ids == X.NULL_ID), "first_word": got[:, 1] - first_word[got[:, 0]], "n_words": got[:, 2]}
                yield pa.RecordBatch.from_pydict(out | {"ref_doc_id": pa.array(got[:, 3], pa.int64(), mask=got[:, 3] == X.NULL_ID), "ref_first_word": got[:, 4]})

    return found.mapInArrow(run, "doc_id long, first_word long, n_words long, ref_doc_id long, ref_first_word long")


def _cleaned(block: X.Block, seeds: _Seeds, parsed: tuple, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Words and removed words of each document; its kept words joined; its text."""
    change = np.zeros(len(seeds.begin) + 1, np.int64)
    got = factors(block, seeds, parsed, size)
    np.add.at(change, got[:, 1], 1)
    np.add.at(change, got[:, 1] + got[:, 2], -1)
    gone = np.cumsum(change[:-1]) > 0
    bounds = np.searchsorted(seeds.doc, np.arange(len(block) + 1))
    total = np.concatenate(([0], np.cumsum(gone)))
    n_removed = total[bounds[1:]] - total[bounds[:-1]]
    data, joined, texts = block.buf.tobytes(), [], []
    for j in range(len(block)):
        whole = data[block.starts[j] : block.starts[j + 1]]
        if n_removed[j]:
            some = np.flatnonzero(~gone[bounds[j] : bounds[j + 1]]) + bounds[j]
            joined.append(b" ".join([data[b:e] for b, e in zip(seeds.begin[some].tolist(), seeds.end[some].tolist(), strict=True)]))
            texts.append(joined[-1])
        else:
            joined.append(b" ".join(whole.split()))
            texts.append(whole)
    return np.diff(bounds), n_removed, joined, texts


def remove_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Each text's seeds are looked up among those of all blocks; the factors
    found (see :func:`factors`) are removed: every word of a window of ``size``
    words that also starts in a document of smaller id, or earlier in the same
    row.  ``kept_sha256`` digests the words left, joined by a space.

    Blocks first exchange the smallest ten-word hash of each window; only
    windows whose anchor is met again send their own print of 96 bits, with the
    least id and place in the block, and learn where it stands first of all.

    Null texts have no words.  Rows that repeat an id are separate documents of
    which neither is earlier; a null id is larger than any other.  A long text is
    a block of its own and parsed whole.  An empty table gives an empty result.
    """
    found, n = _exchanges(docs, size, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in X.unpack(batch):
                n_words, n_removed, joined, _ = _cleaned(block, *_parsed(block, X.answers_of(batch, row), size, n), size)
                digests = [hashlib.sha256(k).hexdigest() for k in joined]
                yield pa.RecordBatch.from_pydict({"doc_id": block.out_ids(), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digests})

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats removed from the texts, all columns kept.

    The same removal as :func:`remove_repeats`; a text from which words go
    becomes the words left, joined by a space, other texts stay as they are.  A
    document of which no word is left goes.  A null text stays null.
    """
    others = tuple(c for c in docs.columns if c != text_col)
    none = free_name(docs, "no_text")
    found, n = _exchanges(docs.withColumn(none, F.col(f"`{text_col}`").isNull()), size, id_col, text_col, (*others, none))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in X.unpack(batch):
                n_words, n_removed, _, texts = _cleaned(block, *_parsed(block, X.answers_of(batch, row), size, n), size)
                rest = block.rest()
                texts = pa.array(texts, pa.binary(), mask=rest.column(none).to_numpy(zero_copy_only=False).astype(bool)).cast(pa.string())
                table = pa.table({f: texts if f == text_col else rest.column(f) for f in schema.names})
                stays = (n_words == 0) | (n_removed < n_words)
                yield from table.filter(pa.array(stays)).combine_chunks().to_batches()

    return found.mapInArrow(run, schema)
