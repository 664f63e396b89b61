"""Score texts with context-tree weighting over bytes.

A node of the tree is a context (the last ``d`` bytes, d = 0..depth) and a
prefix of the next byte's bits; it predicts the next bit by the
Krichevsky-Trofimov rule.  A node's weighted probability is half its own
estimate and half the product of its children's (contexts one byte longer), so
all depths are mixed.  With P_kt and P_w of the training counts, a node stops
with weight P_kt / (2 P_w) and passes the rest of its weight to the child on
the path; where the path leaves the training data it stops.  The bits of a byte
are predicted in turn, hence probabilities of all bytes sum to one.

Counts of a context's whole subtree meet in the bucket of its last two bytes,
so trees are built in parallel and only depth 2 (65,536 contexts of 255 nodes
at most) is summed up on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import _exchange as X
from tablewright.llm import _text as T

DEPTH = 4
END = np.uint64(0x5851F42D4C957F2D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 by Stirling's series after a shift of eight."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for j in range(8):
        shift = shift * np.where(x < 1e6, x + j, 1.0)
    y = np.where(x < 1e6, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    return series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a string with these counts."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1.0)


def _weighted(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P_w of inner nodes, and the weight with which they stop."""
    return np.logaddexp(kt, below) - np.log(2.0), 1.0 / (1.0 + np.exp(np.clip(below - kt, -700, 700)))


class Tree:
    """Nodes of the contexts of ``low`` to ``depth`` bytes, from byte counts.

    ``grams`` (context bytes, oldest first, then the next byte) are distinct;
    ``counts`` are theirs in training and positive.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH, low: int = 2):
        self.depth, self.low = depth, low
        self.nodes: dict[tuple[int, int], list[np.ndarray]] = {}
        g, n = grams, counts.astype(np.float64)
        for d in range(depth, low - 1, -1):
            g = g & np.uint64((1 << (8 * (d + 1))) - 1)
            order, begin = T.group_sorted(g)
            g, n = g[order][begin], (np.add.reduceat(n[order], begin) if len(begin) else n)
            context, byte = g >> np.uint64(8), g & np.uint64(255)
            for j in range(8):
                key = (context << np.uint64(8)) | (byte >> np.uint64(8 - j)) | np.uint64(1 << j)
                first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)
                one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                n1 = np.add.reduceat(np.where(one, n, 0.0), first) if len(first) else np.zeros(0)
                n0 = np.add.reduceat(np.where(one, 0.0, n), first) if len(first) else np.zeros(0)
                keys, kt = key[first], log_kt(n0, n1)
                if d == depth:
                    log_w, stop = kt, np.ones(len(kt))
                else:
                    child = self.nodes[d + 1, j]
                    up = ((child[0] >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8) | (child[0] & np.uint64(255))
                    below = np.bincount(np.searchsorted(keys, up), weights=child[3], minlength=len(keys))
                    log_w, stop = _weighted(kt, below)
                self.nodes[d, j] = [keys, n0, n1, log_w, stop]

    def summary(self) -> np.ndarray:
        """Nodes at ``low``: rows of context and prefix, n0, n1, ln P_w."""
        rows = [np.stack([k.astype(np.float64), n0, n1, w]) for (d, _), (k, n0, n1, w, _) in self.nodes.items() if d == self.low]
        return np.concatenate(rows, axis=1).T

    def log_p(self, grams: np.ndarray, top: Top) -> np.ndarray:
        """ln P(byte | context) of each gram, ``top`` being the shallower nodes."""
        total = np.zeros(len(grams))
        byte = (grams & np.uint64(255)).astype(np.int64)
        for j in range(8):
            prefix = (byte >> (8 - j)) | (1 << j)
            one = ((byte >> (7 - j)) & 1).astype(bool)
            p1, weight = np.zeros(len(grams)), np.ones(len(grams))
            q_last = np.full(len(grams), 0.5)
            alive = np.ones(len(grams), bool)
            for d in range(self.depth + 1):
                if d < self.low:
                    context = ((grams >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)).astype(np.int64)
                    n0, n1, stop = (x[context, prefix] for x in top.levels[d])
                    here = alive & (n0 + n1 > 0)
                else:
                    keys, a, b, _, s = self.nodes[d, j]
                    key = ((grams >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8) | prefix.astype(np.uint64)
                    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                    here = alive & (keys[at] == key) if len(keys) else np.zeros(len(grams), bool)
                    n0, n1, stop = (x[at] if len(keys) else np.zeros(len(grams)) for x in (a, b, s))
                q = (n1 + 0.5) / (n0 + n1 + 1.0)
                p1 = np.where(here, p1 + weight * stop * q, p1)
                weight = np.where(here, weight * (1.0 - stop), weight)
                q_last = np.where(here, q, q_last)
                alive = here
            p1 = np.clip(p1 + weight * q_last, 1e-300, 1.0)
            total += np.log(np.where(one, p1, np.clip(1.0 - p1, 1e-300, 1.0)))
        return total


class Top:
    """Nodes of the contexts of fewer than two bytes, from the summed depth 2."""

    def __init__(self, rows: np.ndarray):
        context, prefix = rows[:, 0].astype(np.int64) >> 8, rows[:, 0].astype(np.int64) & 255
        self.levels = []
        n0, n1, log_w = rows[:, 1], rows[:, 2], rows[:, 3]
        for d in (1, 0):
            context = context & ((1 << (8 * d)) - 1)
            shape = (256**d, 256)
            at = context * 256 + prefix
            a, b, below = (np.bincount(at, weights=x, minlength=shape[0] * 256) for x in (n0, n1, log_w))
            w, stop = _weighted(log_kt(a, b), below)
            self.levels.insert(0, (a.reshape(shape), b.reshape(shape), stop.reshape(shape)))
            at = np.flatnonzero(a + b > 0)
            context, prefix, n0, n1, log_w = at >> 8, at & 255, a[at], b[at], w[at]


class _Counts:
    """A block's distinct grams and words, what each position holds, and training counts."""

    def __init__(self, block: X.Block, depth: int):
        self.held_out = np.array([zlib.crc32(b"" if i == X.NULL_ID else str(i).encode()) % 10 == 0 for i in block.ids.tolist()], bool)
        buf = _LOWER[block.buf]
        doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(block.starts))
        grams = buf.astype(np.uint64)
        for d in range(1, depth + 1):
            back = buf[:-d] * (doc[d:] == doc[:-d])
            grams[d:] |= back.astype(np.uint64) << np.uint64(8 * d)
        self.doc = doc
        self.gram_code, self.grams, self.gram_train = self._distinct(grams, ~self.held_out[doc])
        begin, end, self.word_doc = T.words(buf, block.starts)
        hashes = np.concatenate([T.word_hashes(buf, begin, end), np.full(len(block), END)])
        self.word_doc = np.concatenate([self.word_doc, np.arange(len(block))])
        self.word_code, self.words, self.word_train = self._distinct(hashes, ~self.held_out[self.word_doc])

    @staticmethod
    def _distinct(keys: np.ndarray, train: np.ndarray):
        codes, distinct = pd.factorize(keys)
        counts = np.bincount(codes, weights=train, minlength=len(distinct)).astype(np.int64)
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[codes], distinct[order], counts[order]

    def parts(self, n: int) -> Iterator[tuple[bool, int, np.ndarray]]:
        """``(of grams, bucket, positions)``; words go to buckets n to 2n - 1."""
        for b, at in X.by_bucket(T.mix((self.grams >> np.uint64(8)) & np.uint64(0xFFFF)), n):
            yield True, b, at
        for b, at in X.by_bucket(self.words, n):
            yield False, n + b, at


def _merged(questions: list[X.Question]):
    keys = [np.cumsum(X.read_array(q["keys"], np.uint64), dtype=np.uint64) for q in questions]
    counts = np.concatenate([X.read_array(q["counts"], np.int64) for q in questions])
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(index, weights=counts, minlength=len(every)), index, np.cumsum([len(k) for k in keys])[:-1]


def score_documents(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A-Z are lower-cased.  Documents whose crc32 of the id's digits is divisible
    by ten are held out (a null id counts as no digits and is held out); all
    others train.  ``base_score`` is the log10 probability of the words and one
    end token under add-0.1 unigram counts; ``score`` that of the text's bytes
    under the weighted tree, and ``bits_per_byte`` its code length.

    Blocks send each bucket their distinct grams or words with training counts
    and get back log probabilities or corpus counts, in the same order.  Null
    texts are empty: one end token, score 0 and null bits per byte.  Repeated
    rows count and are scored like any other.  A long text is a block of its own
    and is scored whole.  Equal counts are no ties: nothing is ranked.  Without
    training text every bit has probability one half.  An empty table gives an
    empty result.  Log probabilities of single bytes travel as 32-bit floats and
    are summed in double precision.
    """
    found = X.blocks(docs, id_col, text_col)
    n = X.buckets(docs)
    fields = ("keys", "counts")

    def questions(block: X.Block, _: dict, n: int) -> Iterator[tuple[int, X.Question]]:
        held = _Counts(block, depth)
        for grams, b, at in held.parts(n):
            keys, counts = (held.grams, held.gram_train) if grams else (held.words, held.word_train)
            yield b, {"keys": X.pack_array(np.diff(keys[at], prepend=np.uint64(0))), "counts": X.pack_array(counts[at])}

    asked = X.ask(found, questions, fields, n)

    def summarize(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts, _, _ = _merged(table.select(list(fields)).to_pylist())
        seen = counts > 0
        out = {"words": [0], "tokens": [0], "nodes": [b""]}
        if bucket < n:
            out["nodes"] = [Tree(keys[seen], counts[seen], depth).summary().tobytes()]
        else:
            out["words"], out["tokens"] = [int(seen.sum())], [int(counts.sum())]
        return pa.table(out, schema=pa.schema([("words", pa.int64()), ("tokens", pa.int64()), ("nodes", pa.binary())]))

    parts = asked.groupBy("bucket").applyInArrow(summarize, "words long, tokens long, nodes binary").collect()
    vocabulary, train_tokens = sum(r["words"] for r in parts), sum(r["tokens"] for r in parts)
    rows = [np.frombuffer(r["nodes"], np.float64).reshape(-1, 4) for r in parts if r["nodes"]]
    top = Top(np.concatenate(rows) if rows else np.zeros((0, 4)))

    def reply(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts, index, cuts = _merged(table.select(list(fields)).to_pylist())
        if bucket < n:
            seen = counts > 0
            values = Tree(keys[seen], counts[seen], depth).log_p(keys, top).astype(np.float32)
        else:
            values = counts.astype(np.int64)
        replies = [X.pack_array(x) for x in np.split(values[index], cuts)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary())})

    answers = asked.groupBy("bucket").applyInArrow(reply, "block long, bucket int, reply binary")
    log_all = np.log10(train_tokens + 0.1 * (vocabulary + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in X.unpack(batch):
                held, replies = _Counts(block, depth), X.answers_of(batch, row)["answers"]
                log_p, known = np.zeros(len(held.grams)), np.zeros(len(held.words), np.int64)
                for grams, b, at in held.parts(n):
                    if grams:
                        log_p[at] = X.read_array(replies[b], np.float32)
                    else:
                        known[at] = X.read_array(replies[b], np.int64)
                docs_n = len(block)
                tokens = np.bincount(held.word_doc, minlength=docs_n)
                c = known[held.word_code]
                base = np.bincount(held.word_doc, weights=np.log10(c + 0.1), minlength=docs_n) - tokens * log_all
                total = np.bincount(held.doc, weights=log_p[held.gram_code], minlength=docs_n) / np.log(10.0)
                size = np.diff(block.starts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.out_ids(),
                        "held_out": held.held_out,
                        "n_tokens": tokens,
                        "n_known": np.bincount(held.word_doc, weights=c > 0, minlength=docs_n).astype(np.int64),
                        "train_tokens": np.full(docs_n, train_tokens),
                        "base_score": base,
                        "score": total,
                        "bits_per_byte": pa.array(-total * np.log2(10.0) / np.maximum(size, 1), mask=size == 0),
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return X.returned(found, answers, "answers").mapInArrow(score, schema)
