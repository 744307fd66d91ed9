"""Plumbing shared by the corpus operators.

Row identity: a document is addressed by ``doc_id`` together with ``tag``, 128
bits of hash of the whole row's id and text.  Rows that repeat both are alike in
every respect the operators look at; rows that repeat only ``doc_id``, or have
none, stay apart.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one Python step holds at a time, unless one document is longer.
CHUNK_BYTES = 4 << 20
#: Text whose keys one bucket of a keyed exchange is sized for.
BUCKET_BYTES = 32 << 20
#: Where a missing doc_id stands in the order of documents: after all others.
NO_ID = np.iinfo(np.int64).max

_BLOCK = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster shares; one of our own only where none is set and all of Spark runs in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-checkpoints-")
    context.setCheckpointDir(folder)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage; Spark removes the shuffle files behind it as soon as it is written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, so that it takes the setting
    finally:
        spark.conf.set(_CLEAN_UP, before)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def bucket_count(docs: DataFrame, total: int, size: int = BUCKET_BYTES) -> int:
    """Buckets of a keyed exchange: they grow with the input, so that a bucket doesn't."""
    return max(shuffle_partitions(docs.sparkSession), -(-total // size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tag_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The tag of a row: two 64-bit hashes, from different seeds, of its id as long and its text as string, whatever types they come in; as 16 bytes."""
    row = (F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*row), F.xxhash64(F.lit(1), *row)))))


#: A tag in numpy.
TAG = np.dtype("V16")


def tags_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), TAG)


def tag_numbers(tags: np.ndarray) -> np.ndarray:
    """The first 64 bits of each tag."""
    return np.ascontiguousarray(tags).view("<u8").reshape(-1, 2)[:, 0]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tag, text, the columns of `carry`, and nothing else, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(id_col, text_col).alias("tag"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in carry))


def chunks(batches, columns: tuple[str, ...] = ("doc_id", "tag"), limit: int = CHUNK_BYTES, rows: int = 1 << 20):
    """(texts as list of bytes, then each column as array) for pieces of the batches of at most `rows` rows and `limit` bytes of text, or one row.

    Null texts come as b""; null ids as NO_ID."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.binary())
        if text.null_count:
            text = text.fill_null(b"")
        ends = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + limit, "right"))), at + rows)
            part = batch.slice(at, to - at)
            yield [text.slice(at, to - at).to_pylist(), *(tags_of(part.column(c)) if c == "tag" else part.column(c).fill_null(NO_ID if c == "doc_id" else 0).to_numpy(zero_copy_only=False) for c in columns)]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[bytes], lower: bool = False, ways: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of every word of every text, in as many independent ways, and the number of words of each text.

    A word is taken by blocks of eight bytes; each block is mixed with its number,
    and what comes of the blocks is added up and mixed with the word's length.  So
    words of up to eight bytes never share a hash, and longer ones by chance only.
    lower: A-Z count as a-z."""
    flat = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    if lower:
        flat = _LOWER[flat]
    space = _SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = (edge[0::2], edge[1::2]) if space[0] else (np.concatenate(([0], edge[1::2])), edge[0::2])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    eight = np.ndarray((len(flat) - 7,), "<u8", buffer=flat, strides=(1,))
    out = [np.empty(len(starts), np.uint64) for _ in range(ways)]
    at = 0
    while at < len(starts):
        to = max(at + 1, min(at + _BLOCK, int(np.searchsorted(ends, starts[at] + 8 * _BLOCK, "right"))))
        s, size = starts[at:to], ends[at:to] - starts[at:to]
        n_blocks = (size + 7) >> 3
        long = np.flatnonzero(n_blocks > 1)
        more = n_blocks[long] - 1
        word = np.repeat(long, more)
        number = np.arange(1, len(word) + 1) - np.repeat(np.cumsum(more) - more, more)
        first, rest = _block_values(eight, s, size), _block_values(eight, s[word] + 8 * number, size[word] - 8 * number)
        for way, hashes in enumerate(out):
            salt = np.uint64(_SALTS[way])
            total = mix(first ^ salt)
            if len(word):
                total[long] += np.add.reduceat(mix(rest ^ mix(number.astype(np.uint64) * np.uint64(_BASE) + salt)), np.cumsum(more) - more)
            hashes[at:to] = mix(total ^ size.astype(np.uint64) * np.uint64(_BASE))
        at = to
    return out, counts


def _block_values(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The blocks at these places as numbers, of which only the first `left` bytes count."""
    value = eight[at]
    short = left < 8
    value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
    return value


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each `width` consecutive words of one text, the text's number, and the window's first word within it."""
    n = len(words)
    first = np.cumsum(counts) - counts
    per = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per)
    pos = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    if not len(doc):
        return np.empty(0, np.uint64), doc, pos
    rolled = np.zeros(n - width + 1, np.uint64)
    scaled = np.empty_like(rolled)
    for j in range(width):
        np.multiply(words[j : j + len(rolled)], np.uint64(pow(base, width - j, 1 << 64)), out=scaled)
        rolled += scaled
    return mix(rolled[first[doc] + pos]), doc, pos


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all first bytes before all second ones: small numbers then compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def id_planes(values: np.ndarray) -> bytes:
    """64-bit ids as steps from one to the next, byte by byte: ids near each other then compress well."""
    return np.diff(values, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def un_id_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def binary_runs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of a numeric array as an Arrow column of binaries."""
    offsets = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in the given order, without sorting all rows in one task.

    Rows are dealt by range and kept; a row's place is its place in its range plus
    the sizes of the ranges before, of which there are as many as partitions.  Rows
    that are alike in the order stand in any order, and may be in several ranges."""
    spark = df.sparkSession
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1021)))
    dealt = cut(salted.repartitionByRange(shuffle_partitions(spark), *order, "_salt").select("*", F.spark_partition_id().alias("_part")))
    sizes = dealt.groupBy("_part").count()
    before = sizes.select(F.col("_part"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = dealt.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_salt")) - 1)
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before", "_salt")
