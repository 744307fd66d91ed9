"""Token counts: pieces counted once per distinct pre-token, joined to pre-token frequencies, summed.

No ids of whole texts are made.  A chunk of documents keeps each document's
pre-token frequencies under chunk-local numbers, and sends its distinct
pre-tokens, packed by bucket, to where each distinct one is tokenised once.
The piece counts come back by chunk and are summed over the frequencies.  A
pre-token that every document holds travels once per chunk.

Defined cases: a null or empty text has no tokens; strings of special tokens
inside a text count one each, as the library has it; repeated rows count each;
null ids stay null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bucket_count, cut, planes, runs, text_bytes, unplanes
from weftline.llm.pieces import default_path, vocabulary

TOKEN_LIMIT = 1024
#: Text of one chunk of documents, and pre-tokens whose numbers travel together.
CHUNK_BYTES = 16 << 20
#: Buckets of pre-tokens, at most: a chunk sends a row to each, and a task holds the distinct pre-tokens of one, which grow far more slowly than the text.
MOST_BUCKETS = 4096

_SPLIT = "chunk long, bucket int, doc_id long, n_bytes long, special long, a binary, b binary"
_SPLIT_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPLIT_SCHEMA, strict=True)], schema=_SPLIT_SCHEMA)


class _Chunk:
    """Documents' frequencies under numbers that the chunk gives to its distinct pre-tokens."""

    def __init__(self, number: int):
        self.number, self.size, self.slot, self.docs = number, 0, {}, []

    def add(self, doc_id, raw: bytes, vocab) -> None:
        pieces, special = vocab.pre_tokens(raw.decode(), raw)
        slot = self.slot
        numbers = np.sort(np.fromiter((slot.setdefault(p, len(slot)) for p in pieces), np.int64, len(pieces)))
        starts = runs(numbers)
        count = np.diff(np.append(starts, len(numbers)))
        self.docs.append((self.number, None, doc_id, len(raw), special, zlib.compress(planes(np.diff(numbers[starts], prepend=0)), 1), zlib.compress(planes(count), 1)))
        self.size += len(raw)

    def rows(self, n_buckets: int):
        yield from self.docs
        pieces = [p.encode() for p in self.slot]
        bucket = np.fromiter(map(zlib.crc32, pieces), np.uint64, len(pieces)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        starts = runs(bucket[order])
        for s, e in zip(starts, np.append(starts, len(order))[1:], strict=True):
            own = order[s:e]
            texts = [pieces[i] for i in own]
            sizes = planes(np.array([len(t) for t in texts]))
            yield (self.number, int(bucket[own[0]]), None, None, None, zlib.compress(planes(np.diff(own, prepend=0)), 1), zlib.compress(sizes + b"".join(texts), 1) + len(texts).to_bytes(4, "little"))


def _split(path: str, n_buckets: int):
    def split(batches):
        vocab = vocabulary(path)
        first = TaskContext.get().partitionId() << 32
        chunk = _Chunk(first)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True):
                chunk.add(doc_id, raw, vocab)
                if chunk.size >= CHUNK_BYTES:
                    rows = list(chunk.rows(n_buckets))
                    yield from (_batch(rows[i : i + 2000]) for i in range(0, len(rows), 2000))
                    chunk = _Chunk(chunk.number + 1)
        if chunk.docs:
            rows = list(chunk.rows(n_buckets))
            yield from (_batch(rows[i : i + 2000]) for i in range(0, len(rows), 2000))

    return split


def _count(path: str):
    """Rows of one bucket after another: each pre-token of a bucket is tokenised where it comes first; one row is held at a time, and the bucket's pre-tokens."""

    def count(batches):
        vocab, known, of = vocabulary(path), {}, None
        for batch in batches:
            for bucket, chunk, a, b in zip(*(batch.column(c) for c in ("bucket", "chunk", "a", "b")), strict=True):
                if bucket.as_py() != of:
                    known, of = {}, bucket.as_py()
                packed = b.as_py()
                n, data = int.from_bytes(packed[-4:], "little"), zlib.decompress(packed[:-4])
                ends = 4 * n + np.cumsum(unplanes(data[: 4 * n]).astype(np.int64))
                texts = [data[s:e].decode() for s, e in zip(np.concatenate(([4 * n], ends[:-1])), ends, strict=True)]
                new = [t for t in texts if t not in known]
                for i in range(0, len(new), 4096):
                    known.update(zip(new[i : i + 4096], map(len, vocab.ids(new[i : i + 4096])), strict=True))
                counts = zlib.compress(planes(np.fromiter(map(known.__getitem__, texts), np.int64, n)), 1)
                yield pa.record_batch([pa.array([chunk.as_py()], pa.int64()), pa.array([a.as_py()], pa.binary()), pa.array([counts], pa.binary())], names=["chunk", "a", "b"])

    return count


def _numbers(data: bytes) -> np.ndarray:
    return unplanes(zlib.decompress(data)).astype(np.int64)


def _sum(docs: pa.Table, counted: pa.Table) -> pa.Table:
    slots = [np.cumsum(_numbers(x)) for x in counted.column("a").to_pylist()]
    pieces = np.zeros(1 + max((int(x[-1]) for x in slots), default=-1), np.int64)
    for at, n in zip(slots, counted.column("b").to_pylist(), strict=True):
        pieces[at] = _numbers(n)
    tokens = [int((pieces[np.cumsum(_numbers(a))] * _numbers(b)).sum()) + special for a, b, special in zip(docs.column("a").to_pylist(), docs.column("b").to_pylist(), docs.column("special").to_pylist(), strict=True)]
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64())})


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    path = path or default_path()
    n_buckets = min(bucket_count(docs, text_bytes(docs, text_col)), MOST_BUCKETS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = cut(rows.mapInArrow(_split(path, n_buckets), _SPLIT))
    pieces = split.where("bucket IS NOT NULL").select("bucket", "chunk", "a", "b").repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket")
    counted = pieces.mapInArrow(_count(path), "chunk long, a binary, b binary")
    own = split.where("bucket IS NULL").select("chunk", "doc_id", "n_bytes", "special", "a", "b")
    return own.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
