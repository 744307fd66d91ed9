"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of `width` words of every document gets an 80-bit polynomial hash:
two polynomials of different bases over two independent word hashes.  The keyed
exchange of first_owner counts each hash's owners; a window loses if a document
with a smaller doc_id has it.  Losing windows of a document merge into maximal
intervals of words to remove.

Defined cases: a null or blank text has no words and loses none; a text shorter
than the window loses none; a null doc_id comes after every other id; rows with
one doc_id never remove from each other, repeated rows get the same result;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bucket_count, chunks, keyed, text_bytes, window_hashes, word_hashes
from weftline.llm.first_owner import REQUEST, Buckets, marked_places, places_of, requests, with_places

WINDOW_WORDS = 13
#: Text whose windows one Python step holds at a time, unless one document is longer.
CHUNK_BYTES = 2 << 20
_SECOND_BASE = 0xD6E8FEB86659FD93


def _ask(width: int, buckets: Buckets):
    def ask(batches):
        for texts, ids, tags in chunks(batches, limit=CHUNK_BYTES):
            (first, second), counts = word_hashes(texts, ways=2)
            main, doc, place = window_hashes(first, counts, width)
            extra = (window_hashes(second, counts, width, _SECOND_BASE)[0] >> np.uint64(48)).astype(np.uint16)
            yield from requests(buckets, main, extra, doc, place, ids, tags)

    return ask


def removal_spans(docs: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_it_was: bool = False) -> DataFrame:
    """doc_id, tag, n_words, spans (array of struct start, stop: words start..stop-1 go), cleaned (kept words joined by one space), and the columns in `carry`.

    as_it_was: the cleaned text of a document that loses nothing is its text, white space (or null) and all."""
    rows = keyed(docs, id_col, text_col, carry)
    buckets = Buckets(bucket_count(docs, text_bytes(docs, text_col)))
    lost = marked_places(rows.drop(*carry).mapInArrow(_ask(width, buckets), REQUEST), buckets)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)
    schema = f"doc_id long, tag binary, n_words long, spans array<struct<start:int,stop:int>>, cleaned string{more}"
    return with_places(rows, lost).mapInArrow(_cleaner(width, carry, as_it_was), schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def merged(starts: np.ndarray, width: int) -> list[dict]:
    """Maximal intervals covered by windows of `width` words at these ascending places."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) > width)))
    last = np.append(first[1:] - 1, len(starts) - 1)
    return [{"start": int(s), "stop": int(e) + width} for s, e in zip(starts[first], starts[last], strict=True)]


def _cleaner(width: int, carry: tuple[str, ...], as_it_was: bool):
    def clean(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, spans, cleaned = [], [], []
                for raw, places in zip(part.column("text").cast(pa.binary()), part.column("at0"), strict=True):
                    text = raw.as_py()
                    words = (text or b"").split()
                    n_words.append(len(words))
                    spans.append(found := merged(places_of(places.as_py()), width))
                    for x in reversed(found):
                        del words[x["start"] : x["stop"]]
                    cleaned.append(text if as_it_was and not found else b" ".join(words))
                made = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(cleaned, pa.binary()).cast(pa.string())]
                yield pa.record_batch([part.column("doc_id"), part.column("tag"), *made, *(part.column(c) for c in carry)], names=["doc_id", "tag", "n_words", "spans", "cleaned", *carry])

    return clean


def substring_report(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256."""
    found = removal_spans(docs, width)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x.stop - x.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("cleaned"), 256).alias("kept_sha256"))
