"""Exact dedup of byte substrings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document of smaller id, or before in the same one.

Ordering all suffixes of the corpus together would move each of them several
times.  Only suffixes whose first bucket holds more than one text are refined:

1. Of each string of LENGTH bytes the least gram of GRAM bytes, by hash, stands
   for it.  Strings in a row with the same least gram, and on the same side of HALF
   bytes before it, form a stretch.  All have a core of bytes in common: the
   stretch's bucket, named by its content (80 bits), as is the stretch's whole
   text.  Cores in stretches of one text only, and stretches whose text stands
   earlier, are settled here; that is the bulk of the text.
2. What is left are stretches of several texts around one core.  Their suffixes
   are refined chunk by chunk (bucket_pointers): buckets of their first bytes are
   sorted on the pointers of later offsets, 8, 16, 32 and 36 bytes on, until strings
   of LENGTH bytes are told apart exactly.  One string of each bucket then goes,
   named by its content, to meet those of other chunks.

Equal strings have equal least grams at equal places, so none is missed.

Defined cases: a null or empty text has no bytes, a text shorter than LENGTH
loses none; a null doc_id comes after every other; rows of one doc_id don't
remove from each other, repeated rows get the same result; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bucket_pointers import bucket_pointers
from weftline.llm.common import bucket_count, chunks, keyed, mix, runs, text_bytes
from weftline.llm.first_owner import REQUEST, Buckets, marked_in_chunk, marked_places, places_of, requests, with_places

LENGTH, GRAM = 100, 16
#: Strings that begin fewer bytes before their gram, and others, are told apart.
HALF = 42
#: Text whose strings one Python step holds at a time, unless one document is longer.
CHUNK_BYTES = 2 << 20
#: Text whose entries one bucket is sized for.
BUCKET_BYTES = 16 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BLOCK = 1 << 19
#: Bytes of stretches that are refined together.
_REFINED = 1 << 19
_PLACE_BITS = 24


def names(data: np.ndarray, base: int) -> dict[int, np.ndarray]:
    """Bucket names of each place for 16, 32 and 64 bytes, each from two of half the length; a name of places too near the end is left out."""
    name, size, out = data.astype(np.uint64) + np.uint64(1), 1, {}
    while size < 64:
        name = name[: max(len(name) - size, 0)] * np.uint64(pow(base, size, 1 << 64)) + name[size:]
        size *= 2
        if size >= GRAM:
            out[size] = name
    return out


def _joined(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    out = mix(first)
    for x in others:
        out = mix(out * np.uint64(_BASES[0]) + x)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Stretches:
    """Runs of strings with one least gram, and one side of it, in some texts.

    doc, first, last: each stretch's document, and places there of its first and last
    string; key, text: names of the core and of the whole stretch."""

    def __init__(self, texts: list[bytes], named: bool = True):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        parts = [self._block(at, to, named) for at, to in self._blocks()]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 4
        self.doc, self.first, self.last, self.key, self.key_extra, self.text, self.text_extra = columns

    def _blocks(self) -> list[tuple[int, int]]:
        """Pieces of the data: some whole texts, or _BLOCK bytes of a longer one; so a text is cut alike whatever texts are beside it."""
        out: list[tuple[int, int]] = []
        for begin, size in zip(self.begins.tolist(), self.sizes.tolist(), strict=True):
            if size > _BLOCK:
                out += [(at, min(at + _BLOCK, begin + size)) for at in range(begin, begin + size, _BLOCK)]
            elif out and begin + size - out[-1][0] <= _BLOCK:
                out[-1] = (out[-1][0], begin + size)
            else:
                out.append((begin, begin + size))
        return [(at, to) for at, to in out if min(to, len(self.data) - LENGTH + 1) > at]

    def _block(self, at: int, to: int, named: bool) -> tuple:
        """Stretches of the strings that start in one block of the data; a stretch across its end is two."""
        n = min(to, len(self.data) - LENGTH + 1) - at
        data = self.data[at : at + n + LENGTH - 1]
        main = names(data, _BASES[0])
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        hashed = (mix(main[GRAM]) & ~mask) | np.arange(len(main[GRAM]), dtype=np.uint64)
        gram = (_least(hashed, LENGTH - GRAM + 1)[:n] & mask).astype(np.int64)
        start = np.arange(n)
        doc = np.searchsorted(self.begins, at + start, "right") - 1
        valid = np.flatnonzero(at + start + LENGTH <= (self.begins + self.sizes)[doc])
        if not len(valid):
            return tuple([np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 4)
        far = gram - start >= HALF
        heads = runs(2 * gram[valid] + far[valid])
        first = valid[heads]
        last = valid[np.append(heads, len(valid))[1:] - 1]
        own, gram, far = doc[first], gram[first], far[first]
        found = []
        if named:
            size = last - first + LENGTH
            # the core: HALF bytes and a gram before the gram's end, or LENGTH - HALF bytes from the gram on
            one, two = np.where(far, gram - HALF, gram), np.where(far, gram + GRAM - 32, gram + LENGTH - HALF - 32)
            side = far.astype(np.uint64)
            for base, name in ((_BASES[0], main), (_BASES[1], names(data, _BASES[1]))):
                key = _joined(name[32][one], name[32][two], side)
                found += [key, _joined(key, name[64][first], name[64][first + (size - 64) // 2], name[64][last + LENGTH - 64], size.astype(np.uint64), (gram - first).astype(np.uint64))]
        else:
            found = [np.empty(0, np.uint64)] * 4
        key, text, key_extra, text_extra = found
        back = at - self.begins[own]
        return own, first + back, last + back, key, key_extra, text, text_extra

    def refined(self, which: np.ndarray):
        """The strings of these stretches, some stretches at a time: document, place, and bucket after refinement."""
        begin, size = self.begins[self.doc] + self.first, self.last - self.first + LENGTH
        piece = np.cumsum(size[which]) // _REFINED
        for s in np.split(which, runs(piece)[1:]) if len(which) else []:
            ends = np.cumsum(size[s])
            inside = np.arange(ends[-1]) - np.repeat(ends - size[s], size[s])
            pointer = bucket_pointers(self.data[np.repeat(begin[s], size[s]) + inside], np.repeat(ends, size[s]), LENGTH)
            starts = inside <= np.repeat(size[s] - LENGTH, size[s])
            yield np.repeat(self.doc[s], size[s])[starts], (np.repeat(self.first[s], size[s]) + inside)[starts], pointer[starts]

    def string_names(self, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the strings of LENGTH bytes at these places, in two parts."""
        out = [np.empty(len(doc), np.uint64), np.empty(len(doc), np.uint64)]
        where = self.begins[doc] + place
        for at in range(0, max(len(self.data) - LENGTH + 1, 0), _BLOCK):
            here = slice(*np.searchsorted(where, (at, at + _BLOCK)))
            own = where[here] - at
            if len(own):
                data = self.data[at : at + _BLOCK + LENGTH - 1]
                for k, base in enumerate(_BASES):
                    name = names(data, base)[64]
                    out[k][here] = _joined(name[own], name[own + LENGTH - 64])
        return out[0], out[1]


def _high(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(48)).astype(np.uint16)


STANDS_EARLIER, SEVERAL_TEXTS = 0, 1
STRINGS, FIRSTS, LASTS = 0, 1, 2


def _ask_stretches(buckets: Buckets):
    def ask(batches):
        for texts, ids, tags in chunks(batches, limit=CHUNK_BYTES):
            s = Stretches(texts)
            yield from requests(buckets, s.text, _high(s.text_extra), s.doc, s.first, ids, tags, kind=STANDS_EARLIER, within=True)
            yield from requests(buckets, s.key, _high(s.key_extra), s.doc, s.first, ids, tags, kind=SEVERAL_TEXTS, rule="other", holder=s.text.view(np.int64))

    return ask


def _pieces(batches, n: int):
    """Rows in pieces of at most CHUNK_BYTES of text, or one row: (texts, owners, tags, marked places of each kind, a list of them for each text)."""
    for batch in batches:
        at = 0
        for texts, ids, tags in chunks([batch], limit=CHUNK_BYTES):
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield texts, ids, tags, [[places_of(x.as_py()) for x in part.column(f"at{k}")] for k in range(n)]


def _flags(found: list[np.ndarray], s: Stretches) -> np.ndarray:
    """Which bytes' places are marked, over the pieces' data."""
    flags = np.zeros(len(s.data) + 1, bool)
    for begin, places in zip(s.begins.tolist(), found, strict=True):
        flags[begin + places] = True
    return flags


def _ask_strings(buckets: Buckets):
    def ask(batches):
        for texts, ids, tags, (earlier, several) in _pieces(batches, 2):
            s = Stretches(texts, named=False)
            at = s.begins[s.doc] + s.first
            lost = _flags(earlier, s)[at]
            refine = _flags(several, s)[at] & ~lost
            ask, marked = [], []
            for doc, place, bucket in s.refined(np.flatnonzero(refine)):
                gone = marked_in_chunk(bucket, doc, ids)
                ask.append((doc[~gone], place[~gone]))
                marked.append((doc[gone], place[gone]))
            (doc, place), settled = ([np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*x, strict=True)] or [np.empty(0, np.int64)] * 2 for x in (ask, marked))
            main, extra = s.string_names(doc, place)
            yield from requests(buckets, main, _high(extra), doc, place, ids, tags, within=True, settled=settled)
            for kind, ends in ((FIRSTS, s.first), (LASTS, s.last)):  # lost stretches go as their two ends
                yield from requests(buckets, *(x[:0] for x in (main, extra, doc, place)), ids, tags, kind=kind, settled=(s.doc[lost], ends[lost]))

    return ask


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def spans_of(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by these intervals; intervals that touch are one run."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[first], reach[np.append(first[1:] - 1, len(starts) - 1)]


def _clean(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            columns: dict[str, list] = {"n_bytes": [], "spans": [], "kept": []}
            for text, *found in zip(part.column("text").cast(pa.binary()), *(part.column(f"at{k}") for k in range(3)), strict=True):
                raw = text.as_py() or b""
                single, first, last = (places_of(x.as_py()) for x in found)
                starts, stops = spans_of(np.concatenate((single, first)), np.concatenate((single, last)) + LENGTH)
                columns["n_bytes"].append(len(raw))
                columns["spans"].append([{"start": s, "stop": e} for s, e in zip(starts.tolist(), stops.tolist(), strict=True)])
                columns["kept"].append(b"".join(raw[s:e] for s, e in zip([0, *stops.tolist()], [*starts.tolist(), len(raw)], strict=True)))
            types = (pa.int64(), _SPANS, pa.binary())
            yield pa.record_batch([part.column("doc_id"), part.column("tag"), *(pa.array(v, t) for v, t in zip(columns.values(), types, strict=True))], names=["doc_id", "tag", *columns])


def byte_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, n_bytes, spans (array of struct start, stop: bytes start..stop-1 go), kept (the remaining bytes)."""
    rows = keyed(docs, id_col, text_col)
    buckets = Buckets(bucket_count(docs, text_bytes(docs, text_col), BUCKET_BYTES))
    first = marked_places(rows.mapInArrow(_ask_stretches(buckets), REQUEST), buckets, ("earlier", "other"))
    lost = marked_places(with_places(rows, first).mapInArrow(_ask_strings(buckets), REQUEST), buckets, ("earlier",) * 3)
    return with_places(rows, lost).mapInArrow(_clean, "doc_id long, tag binary, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x.stop - x.start)
    return byte_spans(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
