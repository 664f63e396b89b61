"""Ask-and-answer exchanges between blocks of documents.

A *block* is a durable row: the ids and the compressed texts of some documents
that one task read together, about ``BLOCK_BYTES`` of text.  An operator asks
questions about the fingerprints of a block: each block sends every bucket of
fingerprints one packed row, a bucket answers each of its rows, and the answers
return to the block.  A frequent fingerprint costs a row per block, never one
per occurrence, and no task holds more than a bucket or a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm._spark import durable, partitions

#: Text gathered in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Stands for a null id; it is larger than any other.
NULL_ID = np.iinfo(np.int64).max


class Block:
    """Documents of a block: ``ids``, ``buf`` (all bytes), ``starts``, other columns."""

    def __init__(self, number: int, ids: np.ndarray, starts: np.ndarray, buf: np.ndarray, rest: bytes | None = None):
        self.number, self.ids, self.starts, self.buf, self._rest = number, ids, starts, buf, rest

    def rest(self) -> pa.Table:
        """The columns that were carried along."""
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._rest)).read_all()

    def __len__(self) -> int:
        return len(self.ids)

    def out_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NULL_ID)


BLOCK_SCHEMA = "block long, ids binary, starts binary, text binary, rest binary"


def _pack(number: int, ids: list, texts: list, rest: list[pa.RecordBatch]) -> dict:
    packed = None
    if rest:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema) as writer:
            for batch in rest:
                writer.write_batch(batch)
        packed = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return {
        "block": number,
        "ids": np.array(ids, np.int64).tobytes(),
        "starts": np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tobytes(),
        "text": zstandard.ZstdCompressor(level=1).compress(b"".join(texts)),
        "rest": packed,
    }


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents as durable blocks; a null text is empty, ``carry`` goes along."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, texts, rest, size = [], [], [], 0
        schema = pa.schema([("block", pa.int64()), *((f, pa.binary()) for f in ("ids", "starts", "text", "rest"))])
        for batch in batches:
            begin = 0
            others = batch.select(list(range(2, batch.num_columns)))
            for j, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True), 1):
                ids.append(NULL_ID if key is None else key)
                texts.append(text or b"")
                size += len(texts[-1]) + 16
                if size >= block_bytes:
                    if carry:
                        rest.append(others.slice(begin, j - begin))
                    yield pa.RecordBatch.from_pylist([_pack(number, ids, texts, rest)], schema)
                    number, ids, texts, rest, size, begin = number + 1, [], [], [], 0, j
            if carry and begin < batch.num_rows:
                rest.append(others.slice(begin))
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(number, ids, texts, rest)], schema)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])
    with small_batches(docs.sparkSession):
        return durable(slim.mapInArrow(gather, BLOCK_SCHEMA))


@contextmanager
def small_batches(spark: SparkSession, records: int = 256, size: str = "8m"):
    """Hand Python few texts at a time while an action inside runs."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[Block, int]]:
    names = {n: j for j, n in enumerate(batch.schema.names)}
    for row in range(batch.num_rows):
        get = lambda n, row=row: batch.column(names[n])[row].as_py()
        text = zstandard.ZstdDecompressor().decompress(get("text"))
        yield Block(get("block"), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("starts"), np.int64), np.frombuffer(text, np.uint8), get("rest")), row


def pack_array(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def read_array(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


#: What a question carries: arrays by name, packed; which, is up to the operator.
Question = dict[str, bytes]


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of ``keys`` by bucket, each in ascending order of position."""
    at = ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def ask(found: DataFrame, questions: Callable[[Block, dict, int], Iterator[tuple[int, Question]]], fields: tuple[str, ...], n_buckets: int) -> DataFrame:
    """``(block, bucket, *fields)`` rows that ``questions`` yields for each block.

    ``found`` are blocks, with or without the answers of earlier exchanges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((f, pa.binary()) for f in fields)])
        for batch in batches:
            for block, row in unpack(batch):
                rows = [{"block": block.number, "bucket": b} | q for b, q in questions(block, answers_of(batch, row), n_buckets)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return found.mapInArrow(run, "block long, bucket int" + "".join(f", {f} binary" for f in fields))


def answer(questions: DataFrame, reply: Callable[[list[Question]], list[bytes]], fields: tuple[str, ...]) -> DataFrame:
    """``(block, bucket, reply)``: each bucket sees all its questions at once."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(list(fields)).to_pylist()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "reply": pa.array(reply(rows), pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, "block long, bucket int, reply binary")


def returned(found: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``found`` with the answers of its blocks as the list ``name``."""
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    return found.join(gathered, "block", "left")


def answers_of(batch: pa.RecordBatch, row: int) -> dict[str, dict[int, bytes]]:
    """The answer lists of a block: by name, then by bucket."""
    out = {}
    for j, field in enumerate(batch.schema):
        if pa.types.is_list(field.type):
            out[field.name] = {x["bucket"]: x["reply"] for x in batch.column(j)[row].as_py() or ()}
    return out


def buckets(df: DataFrame) -> int:
    return 4 * partitions(df.sparkSession)


def repeated_keys_question(keys: np.ndarray, n: int) -> Iterator[tuple[int, Question]]:
    """Ask which of the block's distinct 64-bit ``keys`` other blocks hold too.

    A bucket is chosen by the upper half of a key and 32 lower bits are sent, so
    a rare chance match may say "yes" for a key that is alone, never "no".
    """
    for b, at in by_bucket(keys, n):
        yield b, {"keys": pack_array(keys[at].astype(np.uint32))}


def repeated_keys_reply(questions: list[Question]) -> list[bytes]:
    each = [read_array(q["keys"], np.uint32) for q in questions]
    all_keys = np.concatenate(each)
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    order = np.argsort(all_keys, kind="stable")
    k, o = all_keys[order], owner[order]
    shared = np.zeros(len(k), bool)
    other = (k[1:] == k[:-1]) & (o[1:] != o[:-1])
    shared[1:] |= other
    shared[:-1] |= other
    # In a run of one key that several blocks sent, spread the flag to all.
    begin = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1)) if len(k) else np.zeros(0, np.int64)
    if len(k):
        flags = np.repeat(np.maximum.reduceat(shared, begin), np.diff(np.append(begin, len(k))))
        out = np.empty(len(k), bool)
        out[order] = flags
    else:
        out = shared
    cuts = np.cumsum([len(x) for x in each])[:-1]
    return [zlib.compress(np.packbits(part).tobytes(), 1) for part in np.split(out, cuts)]


def read_flags(keys: np.ndarray, replies: dict[int, bytes], n: int) -> np.ndarray:
    """The flags of ``keys``, which were asked about in this very order."""
    flags = np.zeros(len(keys), bool)
    for b, at in by_bucket(keys, n):
        flags[at] = np.unpackbits(np.frombuffer(zlib.decompress(replies[b]), np.uint8), count=len(at)).astype(bool)
    return flags
