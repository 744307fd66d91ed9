"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A document's ids (with the end id) are cut into full pieces of the capacity, and
what is left into a piece of a multiple of CUT ids and a tail.  Full pieces are
sequences of their own.  The other pieces are dealt to shards of about
SHARD_TOKENS ids; in each, pieces go in descending size to the sequence of the
lowest estimated cost (linear plus quadratic in the piece's length) that has
room for them.  A shard starts with as many sequences as its ids fill, and opens
another one only where a piece fits in none.

Defined cases: a null or empty text is the end id alone; null ids stay null;
repeated rows are packed each; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import CHUNK_BYTES, cut, keyed
from weftline.llm.pieces import default_path, vocabulary

CAPACITY = 2048
END_ID = 1
CUT = 256
SHARD_TOKENS = 4 << 20
#: Weight of the quadratic share: a full sequence of one piece costs twice its length.
QUADRATIC = 1.0

_PIECES = "doc_id long, tag binary, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("tag", pa.binary()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_ids(raw: bytes, path: str) -> np.ndarray:
    """The ids that the tokenizer file gives for a text."""
    return vocabulary(path).ids_of_texts([raw])[0]


def piece_bounds(n: int, capacity: int = CAPACITY, step: int = CUT) -> list[int]:
    """Where the pieces of a document of n ids start, and n."""
    full = n - n % capacity
    rest = full + (n - full) // step * step
    return sorted({*range(0, full, capacity), full, rest, n} - ({n} if n == 0 else set()) | {n})


def _groups(batch: pa.RecordBatch, limit: int):
    """(doc_ids, tags, texts) of rows one after another, of at most `limit` bytes of text, or one row."""
    at, size, texts = 0, 0, batch.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
    for i, raw in enumerate([*texts, None]):
        if i > at and (raw is None or size + len(raw) > limit):
            yield batch.column(0).slice(at, i - at).to_pylist(), batch.column(1).slice(at, i - at).to_pylist(), texts[at:i]
            at, size = i, 0
        size += len(raw or b"")


def _cut(path: str, capacity: int, step: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def pieces(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for doc_ids, tags, texts in _groups(batch, CHUNK_BYTES):
                rows, at = [], 0
                ids, ends = vocab.ids_of_texts(texts)
                data = memoryview(ids.tobytes())
                for doc_id, tag, to in zip(doc_ids, tags, (4 * ends).tolist(), strict=True):
                    n = (to - at) // 4 + 1
                    bounds = piece_bounds(n, capacity, step)
                    rows += [(doc_id, tag, s, e - s, zlib.crc32(end if e == n else b"", zlib.crc32(data[at + 4 * s : min(at + 4 * e, to)])), n) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                    at = to
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES_SCHEMA, strict=True)], schema=_PIECES_SCHEMA)

    return pieces


def assign(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths in descending order."""
    cost = lengths + quadratic * lengths.astype(np.float64) ** 2 / capacity
    n = max(1, -(-int(lengths.sum()) // capacity))
    total, room = np.zeros(2 * n + len(lengths)), np.full(2 * n + len(lengths), capacity)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        open_cost = np.where(room[:n] >= size, total[:n], np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            at, n = n, n + 1
        sequence[i], offset[i] = at, capacity - room[at]
        room[at] -= size
        total[at] += cost[i]
    return sequence, offset


def _pack(capacity: int, n_shards: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("tag", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_numpy()
        full = int((lengths == capacity).sum())
        sequence, offset = assign(lengths[full:], capacity)
        sequence = np.concatenate((np.arange(full), full + sequence))
        offset = np.concatenate((np.zeros(full, np.int64), offset))
        shard = table.column("shard")[0].as_py()
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence * n_shards + shard)).append_column("offset", pa.array(offset))

    return pack


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a vocabulary file of the tokenizers library, byte-level BPE."""
    path = path or default_path()
    pieces = cut(keyed(docs, id_col, text_col).mapInArrow(_cut(path, capacity, CUT, end_id), _PIECES))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    n_shards = max(1, total // SHARD_TOKENS)
    shard = F.pmod(F.xxhash64("doc_id", "tag", "start"), F.lit(n_shards)).alias("shard")
    return pieces.select("*", shard).groupBy("shard").applyInArrow(_pack(capacity, n_shards), _PACKED)
