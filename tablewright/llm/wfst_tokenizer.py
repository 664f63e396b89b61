"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

Four machines are compiled once from the model file and composed with every
input: the normaliser (a prefixed blank, blanks escaped), the piece lexicon, the
byte fallback for characters no piece covers, and a machine over neighbouring
pieces.  Weights add along a path and the least path wins (tropical semiring).

For a unigram model a piece weighs minus its score and neighbours weigh nothing.
For a BPE model scores only order merges, so their sum is not what the model
minimises; there pieces weigh nothing and two neighbours weigh 0 if the merges,
run on the two pieces' characters alone, end in exactly these two pieces, and
infinity otherwise.  A segmentation all of whose neighbours agree in this way is
the one the merges make, so the only finite path is the model's encoding.

Texts are cut between characters that no piece has side by side, which no path
can bridge; each distinct segment is solved once in a worker.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import _text as T

BLANK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Text that is encoded at a time, and solved segments that a worker remembers.
CHUNK_BYTES, MEMORY = 1 << 20, 400_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores, kinds and the normaliser's settings, from a model file."""

    def __init__(self, path: str = MODEL_FILE):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze, self.escape = False, True, True, True
        charsmap = b""
        with open(path, "rb") as f:
            message = f.read()
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if charsmap or self.squeeze or not self.escape:
            raise ValueError("only normalisers that keep all characters and escape blanks are supported")


class Transducer:
    """The composed machines.  Small enough to travel with a task: the pieces."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: j for j, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
        self.byte_ids = [0] * 256
        for j, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = j
        self.longest = max(map(len, self.ids), default=1)
        joined = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.char_class = np.zeros(0x110000, np.uint16)
        for j, c in enumerate(joined, 1):
            self.char_class[ord(c)] = j
        number = {c: j for j, c in enumerate(joined, 1)}
        self.joins = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.joins[number[a], number[b]] = True
        self.pairs: dict[tuple[int, int], float] = {}
        self.solved: dict[int, tuple[int, ...]] = {}
        raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_starts = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.is_byte = np.array([k == BYTE for k in model.kinds])

    def merged(self, text: str) -> list[str]:
        """The model's merges run to the end on a short text."""
        parts, ids, scores = list(text), self.ids, self.model.scores
        while len(parts) > 1:
            best, where = -math.inf, -1
            for j in range(len(parts) - 1):
                piece = ids.get(parts[j] + parts[j + 1])
                if piece is not None and scores[piece] > best:
                    best, where = scores[piece], j
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def pair_weight(self, a: int, b: int) -> float:
        weight = self.pairs.get((a, b))
        if weight is None:
            left, right = self.model.pieces[a], self.model.pieces[b]
            weight = self.pairs[a, b] = 0.0 if self.merged(left + right) == [left, right] else math.inf
        return weight

    def shortest_path(self, segment: str) -> tuple[int, ...]:
        """Pieces of the least path; bytes of a character without a piece."""
        ids, bpe, n = self.ids, self.model.bpe, len(segment)
        # arrive[j]: last piece -> (weight, the piece before it)
        arrive: list[dict] = [{} for _ in range(n + 1)]
        arrive[0][-1] = (0.0, -1)
        for i in range(n):
            before = arrive[i]
            if not before:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = ids.get(segment[i:j])
                if piece is None:
                    continue
                own = 0.0 if bpe else -self.model.scores[piece]
                best, came = math.inf, -1
                for last, (weight, _) in before.items():
                    weight += own + (self.pair_weight(last, piece) if bpe and last >= 0 else 0.0)
                    if weight < best:
                        best, came = weight, last
                if best < math.inf:
                    arrive[j][piece] = (best, came)
                    if not bpe:
                        continue
        if not arrive[n]:
            if n > 1:  # a character inside has no piece of its own
                return tuple(x for c in segment for x in self.shortest_path(c))
            return tuple(self.byte_ids[b] for b in segment.encode())
        piece = min(arrive[n], key=lambda p: (arrive[n][p][0], p))
        path, at = [], n
        while piece >= 0:
            path.append(piece)
            came = arrive[at][piece][1]
            at -= len(self.model.pieces[piece])
            piece = came
        return tuple(reversed(path))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin."""
        mark = BLANK if self.model.prefix else ""
        ready = [mark + t.replace(" ", BLANK) if t else "" for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in ready]))).astype(np.int64)
        whole = "".join(ready)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = self.char_class[code]
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.joins[kind[:-1], kind[1:]]
        cut[starts] = True
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        sums = T.prefix_hashes(T.mix(code.astype(np.uint64) + np.uint64(7)))
        number, keys = pd.factorize(T.span_hashes(sums, begin, end))
        sample = np.zeros(len(keys), np.int64)
        sample[number[::-1]] = np.arange(len(number))[::-1]
        paths = []
        if len(self.solved) > MEMORY:
            self.solved.clear()
        for key, s in zip(keys.tolist(), sample.tolist(), strict=True):
            path = self.solved.get(key)
            if path is None:
                path = self.solved[key] = self.shortest_path(whole[begin[s] : end[s]])
            paths.append(path)
        sizes = np.fromiter((len(p) for p in paths), np.int64, len(paths))
        flat = np.fromiter((x for p in paths for x in p), np.int32, int(sizes.sum()))
        offsets = np.cumsum(sizes) - sizes
        length = sizes[number]
        ends = np.cumsum(length)
        ids = flat[np.repeat(offsets[number] - (ends - length), length) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(begin, starts)]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of id lists laid end to end."""
        length = (self.raw_starts[1:] - self.raw_starts[:-1])[ids]
        ends = np.cumsum(length)
        data = self.raw[np.repeat(self.raw_starts[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate(([0], ends))[starts].tolist()
        skip = 1 if self.model.prefix else 0
        return [data[a:b].replace(BLANK.encode(), b" ")[skip:] for a, b in zip(at[:-1], at[1:], strict=True)]


_ready: dict[str, Transducer] = {}


def _transducer(model: Model) -> Transducer:
    """The worker's machine for this model, with what it has solved so far."""
    key = hashlib.sha256("\0".join(model.pieces).encode()).hexdigest()
    if key not in _ready:
        _ready[key] = Transducer(model)
    return _ready[key]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    keys, texts, size = [], [], 0
    for j in range(batch.num_rows):
        keys.append(batch.column(0)[j].as_py())
        texts.append(batch.column(1)[j].as_py())
        size += len(texts[-1] or "")
        if size >= CHUNK_BYTES:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, n_byte_tokens, ids)`` of every document.

    With ``digest`` the ids give way to ``ids_sha256`` (little-endian 32-bit
    ids) and ``round_trip`` (decoding the ids gives the text back, U+2581 read
    as the blank it stands for).  The model file is read on the driver.

    Null text is empty and has no ids.  Repeated rows and equal ids are encoded
    each, a null id stays null.  A long text is encoded whole: it is cut only
    where no piece joins two characters.  Of paths of one weight the one whose
    last piece has the least id wins.  An empty table gives an empty result.
    """
    model = Model(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model)
        for batch in batches:
            for keys, texts in _chunks(batch):
                texts = [t or "" for t in texts]
                ids, starts = machine.encode(texts)
                n_bytes = np.concatenate(([0], np.cumsum(machine.is_byte[ids])))[starts]
                out = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": np.diff(starts), "n_byte_tokens": np.diff(n_bytes)}
                if digest:
                    data, at = ids.astype("<i4").tobytes(), (starts * 4).tolist()
                    out["ids_sha256"] = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                    back = machine.decode(ids, starts)
                    out["round_trip"] = [b == t.replace(BLANK, " ").encode() for b, t in zip(back, texts, strict=True)]
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    last = "ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_tokens long, n_byte_tokens long, {last}")


def decode_documents(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    model = Model(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            texts = machine.decode(np.array([i for x in lists for i in x], np.int64), starts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": [t.decode("utf-8", "replace") for t in texts]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
