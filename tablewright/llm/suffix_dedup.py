"""Remove repeated byte strings by enhanced suffix arrays over buckets of repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import _exchange as X
from tablewright.llm import _text as T

ANCHOR = 24


# --- enhanced suffix arrays -------------------------------------------------


class SuffixArray:
    """Suffixes of several texts that are at least ``size`` bytes long.

    ``at`` are their positions in lexicographic order of the first ``size``
    bytes, ``rank`` the dense rank of those prefixes by position (-1 elsewhere).
    Ranks come from prefix doubling; a prefix never leaves its text.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, size: int):
        self.buf, self.size = buf, size
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(buf))
        self.left = left
        self.levels: list[tuple[int, np.ndarray]] = []
        width, rank = min(8, size), None
        at = np.flatnonzero(left >= width)
        key = np.zeros(len(at), np.uint64)
        for j in range(width):
            key = (key << np.uint64(8)) | buf[at + j]
        rank = self._dense(at, key, len(buf))
        self.levels.append((width, rank))
        while width < size:
            step = min(width, size - width)
            at = np.flatnonzero(left >= width + step)
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + step].astype(np.uint64)
            width += step
            rank = self._dense(at, key, len(buf))
            self.levels.append((width, rank))
        self.rank = rank
        order = np.argsort(rank[at])
        self.at = at[order]

    @staticmethod
    def _dense(at: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        rank = np.full(n, -1, np.int64)
        if len(at):
            order = np.argsort(key)
            k = key[order]
            up = np.empty(len(k), np.int64)
            up[0] = 0
            np.cumsum(k[1:] != k[:-1], out=up[1:])
            rank[at[order]] = up
        return rank

    def runs(self) -> np.ndarray:
        """Where each interval of equal prefixes begins in ``at``."""
        r = self.rank[self.at]
        return np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1)) if len(r) else np.zeros(0, np.int64)


def interval_tree(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """``(length, first, last)`` of every common-prefix interval, inner first.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i; ``lcp[0]`` is ignored.
    A stack holds the open intervals while the array is scanned once.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, begin = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            if length >= least:
                yield length, begin, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Every maximal repeat of ``least`` bytes or more with all its occurrences.

    A repeat is right-maximal as an interval of the tree, and left-maximal when
    the bytes before its occurrences differ (the begin of a text differs from
    everything).  Occurrences are ``(text, offset)``.
    """
    sizes = [len(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return []
    data = buf.tobytes()
    owner = np.searchsorted(starts, np.arange(len(buf)), "right") - 1
    array = SuffixArray(buf, starts, min(least, max(sizes)))
    tails = [data[p : starts[owner[p] + 1]] for p in array.at.tolist()]
    order = sorted(range(len(tails)), key=lambda i: tails[i])  # ties beyond the prefix

    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        low, high = 0, n
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
        return low

    lcp = [0] + [common(tails[a], tails[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    for length, first, last in interval_tree(lcp, least):
        places = [int(array.at[order[i]]) for i in range(first, last + 1)]
        before = {data[p - 1] if p > starts[owner[p]] else (-1, p) for p in places}
        if len(before) > 1:
            out.append((data[places[0] : places[0] + length], sorted((int(owner[p]), int(p - starts[owner[p]])) for p in places)))
    return out


# --- the distributed removal ------------------------------------------------


class _Runs:
    """A block's windows of ``size`` bytes, and the runs that share an anchor.

    The anchor of a window is the smallest hash of its 24-byte windows.  A run
    is a stretch of consecutive windows of one text with one anchor; its text is
    the bytes they cover.  Equal windows have equal anchors, so all occurrences
    of a window meet in one bucket of runs.
    """

    def __init__(self, block: X.Block, size: int):
        values = T.byte_values(block.buf)
        anchor = min(ANCHOR, size)
        doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(block.starts))
        self.doc = doc
        whole = T.whole_windows(doc, size)
        self.sums = T.prefix_hashes(values)
        self.size = size
        at = np.flatnonzero(whole)
        if len(at):
            grams = T.window_hashes(values, anchor)
            least = T.sliding(np.minimum, grams, size - anchor + 1)[at]
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (doc[at[1:]] != doc[at[:-1]])))
            first = np.flatnonzero(new)
            self.begin = at[first]
            self.windows = np.diff(np.append(first, len(at)))
            self.anchor = T.mix(least[first] + np.uint64(1))
        else:
            self.begin = self.windows = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
        self.keys, counts = np.unique(self.anchor, return_counts=True)
        self.again = counts > 1

    def distinct(self, block: X.Block, replies: dict[int, bytes], n: int):
        """Candidate runs; their distinct texts (an index each) and least ids."""
        flags = X.read_flags(self.keys, replies, n) | self.again
        some = np.flatnonzero(flags[np.searchsorted(self.keys, self.anchor)]) if len(self.keys) else np.zeros(0, np.int64)
        begin, end = self.begin[some], self.begin[some] + self.windows[some] + self.size - 1
        prints = T.span_hashes(self.sums, begin, end) ^ T.mix((end - begin).astype(np.uint64))
        _, sample, index = np.unique(prints, return_index=True, return_inverse=True)
        ids = block.ids[self.doc[begin]] if len(begin) else np.zeros(0, np.int64)
        least = np.full(len(sample), X.NULL_ID, np.int64)
        np.minimum.at(least, index, ids)
        return some, sample, index, ids, least


def _reply(size: int):
    def reply(questions: list[X.Question]) -> list[bytes]:
        """A bit for each window of each run: a document of smaller id holds it."""
        texts = [X.read_array(q["text"], np.uint8) for q in questions]
        lengths = [X.read_array(q["lengths"], np.int32) for q in questions]
        ids = np.concatenate([X.read_array(q["ids"], np.int64) for q in questions])
        counts = [len(x) for x in lengths]
        buf, length = np.concatenate(texts), np.concatenate(lengths).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(length)))
        sums = T.prefix_hashes(T.byte_values(buf))
        prints = T.span_hashes(sums, starts[:-1], starts[1:]) ^ T.mix(length.astype(np.uint64))
        _, sample, index = np.unique(prints, return_index=True, return_inverse=True)
        least = np.full(len(sample), X.NULL_ID, np.int64)
        np.minimum.at(least, index, ids)
        # One copy of every distinct run, one after the other.
        size_of = length[sample]
        begins = np.concatenate(([0], np.cumsum(size_of)))
        take = np.repeat(starts[:-1][sample] - begins[:-1], size_of) + np.arange(begins[-1])
        array = SuffixArray(buf[take], begins, size)
        run_of = np.repeat(np.arange(len(sample)), size_of)
        intervals = array.runs()
        first = np.full(begins[-1], X.NULL_ID, np.int64)
        if len(intervals):
            lowest = np.minimum.reduceat(least[run_of[array.at]], intervals)
            first[array.at] = np.repeat(lowest, np.diff(np.append(intervals, len(array.at))))
        # Windows of a run stand at its first (length - size + 1) positions.
        windows = length - size + 1
        ends = np.cumsum(windows)
        where = np.repeat(begins[:-1][index] - (ends - windows), windows) + np.arange(ends[-1])
        bits = first[where] < np.repeat(ids, windows)
        cuts = ends[np.cumsum(counts)[:-1] - 1]
        return [X.pack_array(np.packbits(x)) for x in np.split(bits, cuts)]

    return reply


def remove_repeated_bytes(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept].

    Removes each byte covered by a ``size``-byte string that also starts in a
    document of smaller id.  Blocks first ask which anchors are met in other
    blocks or twice in their own; runs of windows with such an anchor are sent,
    each distinct text of a block once, to the anchor's bucket.  A bucket builds
    one suffix array over its distinct runs; each interval whose common prefix
    reaches ``size`` is a repeat group with all its occurrences, and its least
    id tells every window whether an earlier document holds it.  (Intervals
    deeper in the tree lie inside these and right of them start other windows,
    so the groups at ``size`` cover what all maximal repeats cover.)

    ``kept`` (binary) are the bytes left.  Null texts are empty.  Rows that
    repeat an id are separate documents of which neither is earlier; a null id
    is larger than any other.  A long text is a block of its own.  An empty
    table gives an empty result.
    """
    found = X.blocks(docs, id_col, text_col)
    n = X.buckets(docs)
    fields = ("text", "lengths", "ids")

    def ask_anchors(block: X.Block, _: dict, n: int) -> Iterator[tuple[int, X.Question]]:
        yield from X.repeated_keys_question(_Runs(block, size).keys, n)

    def ask_runs(block: X.Block, answers: dict, n: int) -> Iterator[tuple[int, X.Question]]:
        runs = _Runs(block, size)
        some, sample, _, _, least = runs.distinct(block, answers["anchors"], n)
        picked = some[sample]
        length = runs.windows[picked] + size - 1
        for b, at in X.by_bucket(runs.anchor[picked], n):
            ends = np.cumsum(length[at])
            take = np.repeat(runs.begin[picked[at]] - (ends - length[at]), length[at]) + np.arange(ends[-1])
            yield b, {"text": X.pack_array(block.buf[take]), "lengths": X.pack_array(length[at].astype(np.int32)), "ids": X.pack_array(least[at])}

    def old_windows(block: X.Block, answers: dict) -> np.ndarray:
        runs = _Runs(block, size)
        some, sample, index, ids, least = runs.distinct(block, answers["anchors"], n)
        picked = some[sample]
        bits: list = [None] * len(picked)
        for b, at in X.by_bucket(runs.anchor[picked], n):
            windows = runs.windows[picked[at]]
            flags = np.unpackbits(X.read_array(answers["runs"][b], np.uint8), count=int(windows.sum())).astype(bool)
            for j, part in zip(at.tolist(), np.split(flags, np.cumsum(windows)[:-1]), strict=True):
                bits[j] = part
        old = np.zeros(len(block.buf), bool)
        later = ids > least[index] if len(ids) else np.zeros(0, bool)
        begins, counts = runs.begin[some].tolist(), runs.windows[some].tolist()
        for j in range(len(some)):
            old[begins[j] : begins[j] + counts[j]] = True if later[j] else bits[index[j]]
        return old

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in X.unpack(batch):
                old = old_windows(block, X.answers_of(batch, row))
                gone = T.covered(old, size, len(block.buf))
                total = np.concatenate(([0], np.cumsum(gone)))
                opens = gone.copy()
                edge = np.zeros(len(gone) + 1, bool)
                edge[block.starts] = True
                opens[1:] &= ~gone[:-1] | edge[1:-1]
                spans = np.concatenate(([0], np.cumsum(opens)))
                s, e = block.starts[:-1], block.starts[1:]
                kept = [block.buf[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else block.buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                out = {"doc_id": block.out_ids(), "n_bytes": e - s, "n_removed": total[e] - total[s], "n_spans": spans[e] - spans[s], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                if with_text:
                    out["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    anchors = X.answer(X.ask(found, ask_anchors, ("keys",), n), X.repeated_keys_reply, ("keys",))
    with_anchors = X.returned(found, anchors, "anchors")
    runs = X.answer(X.ask(with_anchors, ask_runs, fields, n), _reply(size), fields)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return X.returned(with_anchors, runs, "runs").mapInArrow(run, schema)
