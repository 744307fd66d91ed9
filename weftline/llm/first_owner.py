"""Keyed exchange that tells, for every occurrence of a key, whether others have it too.

Each chunk of text makes (key, owner, place) entries by the hundred thousand.
Entries travel packed, one row per chunk and bucket of keys, not as a row each.
A chunk settles what it can among its own entries first.  Under the rule
`earlier` an entry is marked if an entry of a smaller owner has its key: of one
key a chunk sends only the entries of its smallest owner, as the others are
marked already.  Under the rule `other` it is marked if any other owner has the
key: a chunk with several owners marks them all, and sends an entry of the
smallest and one of the largest as witnesses.  So a key that a third of all
documents hold reaches its bucket once per chunk and not once per document.

Buckets grow in number with the input, and chunks do too.  A chunk deals its
entries to at most `fan_out` coarse buckets, whatever their number; where there are
more buckets than that, rows of one coarse bucket are gathered by the million
entries, settled among themselves by the same rules as a chunk's, and what is
left is dealt to the buckets within it.  So rows hold many entries at any size,
their number grows with the input and not with its square, and a key that every
chunk has reaches its bucket once in a million entries.  A bucket is sorted in
slices of its keys, of which one is held at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, TAG, cut, id_planes, planes, runs, shuffle_partitions, tag_numbers, un_id_planes, unplanes


@dataclass(frozen=True)
class Buckets:
    """How keys are dealt: n, number of buckets; fan_out, buckets that a chunk deals to; again_entries, entries of a coarse bucket that are dealt again together; slice_entries, entries that a bucket sorts at a time, about."""

    n: int
    fan_out: int = 1024
    again_entries: int = 1 << 20
    slice_entries: int = 1 << 19

    @property
    def coarse(self) -> int:
        return min(self.n, self.fan_out)


#: Tasks of one exchange.
MOST_TASKS = 1 << 16

REQUEST = "kind int, bucket int, settled boolean, main binary, extra binary, holders binary, owners binary, tags binary, counts binary, places binary"
_ANSWER = "kind int, part int, owners binary, tags binary, counts binary, places binary"
_ENTRIES = [(c, pa.binary()) for c in ("owners", "tags", "counts", "places")]
_REQUEST_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("settled", pa.bool_()), ("main", pa.binary()), ("extra", pa.binary()), ("holders", pa.binary()), *_ENTRIES])
_ANSWER_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *_ENTRIES])


def _groups(main: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, otherwise as before, and where each key starts in it."""
    order = np.argsort(main, kind="stable")
    m, x = main[order], extra[order]
    starts = runs(m)
    if len(order) and ((m[1:] == m[:-1]) & (x[1:] != x[:-1])).any():
        order = np.lexsort((extra, main))
        m, x = main[order], extra[order]
        starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (x[1:] != x[:-1]))))
    return order, starts


def _marked(main: np.ndarray, extra: np.ndarray, holder: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are marked by the rule, and an entry of the least and of the greatest holder of each key."""
    marked = np.zeros(len(main), bool)
    if not len(main):
        return marked, np.empty(0, np.int64)
    order, starts = _groups(main, extra)
    held = holder[order]
    sizes = np.diff(np.append(starts, len(order)))
    least = np.minimum.reduceat(held, starts)
    if rule != "other":
        marked[order] = held > np.repeat(least, sizes)
        return marked, order[starts]
    most = np.maximum.reduceat(held, starts)
    marked[order] = np.repeat(most != least, sizes)
    key, witness = np.repeat(np.arange(len(starts)), sizes), []
    for end in (least, most):
        at = np.flatnonzero(held == end[key])
        witness.append(order[at[runs(key[at])]])
    return marked, np.concatenate(witness)


def _again(main: np.ndarray, extra: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a key that their document has had before; entries in document and place order."""
    marked = np.zeros(len(main), bool)
    if len(main):
        order, starts = _groups(main, extra)
        again = np.zeros(len(order), bool)
        again[1:] = doc[order][1:] == doc[order][:-1]
        again[starts] = False
        marked[order] = again
    return marked


def marked_in_chunk(key: np.ndarray, doc: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Entries marked by a smaller owner's entry, or by an earlier one of the document, within the chunk; entries in document and place order."""
    none = np.zeros(len(key), np.uint8)
    return _marked(key, none, owners[doc], "earlier")[0] | _again(key, none, doc)


def _packed(doc: np.ndarray, place: np.ndarray, owners: np.ndarray, tags: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Entries in document order: their documents, how many each has, and steps from place to place."""
    starts = runs(doc)
    step = np.diff(place, prepend=0)
    step[starts] = place[starts]
    present = doc[starts]
    return id_planes(owners[present]), tags[present].tobytes(), planes(np.diff(np.append(starts, len(doc)))), zlib.compress(planes(step), 1)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owners, tags and counts of the documents, and the places of their entries."""
    counts = unplanes(row["counts"]).astype(np.int64)
    steps = unplanes(zlib.decompress(row["places"]))
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return un_id_planes(row["owners"]), np.frombuffer(row["tags"], TAG), counts, total - np.repeat(total[first] - steps[first], counts)


def _batches(rows, schema: pa.Schema, size: int = 64):
    for i in range(0, len(rows), size):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), schema, strict=True)], schema=schema)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """The rows, binaries as views of the table's memory."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            values = (c[i] for c in columns)
            yield {f.name: v.as_buffer() if pa.types.is_binary(f.type) and v.is_valid else v.as_py() for f, v in zip(batch.schema, values, strict=True)}


def bucket_of(main: np.ndarray, n_buckets: int) -> np.ndarray:
    """A key's bucket: as many ranges of the upper half of the key."""
    return ((main >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.uint16 if n_buckets < 1 << 16 else np.uint32)


def _dealt(bucket: np.ndarray, kind: int, entries: np.ndarray | slice, main: np.ndarray, extra: np.ndarray, holder: np.ndarray | None, doc: np.ndarray, place: np.ndarray, owners: np.ndarray, tags: np.ndarray) -> list[tuple]:
    """A row for each bucket of these entries."""
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], np.arange(len(main))[entries][order]
    starts = runs(bucket)
    rows = []
    for s, e in zip(starts, np.append(starts, len(entries))[1:], strict=True):
        x = entries[s:e]
        rows.append((kind, int(bucket[s]), False, main[x].tobytes(), extra[x].astype(np.uint16).tobytes(), None if holder is None else holder[x].astype(np.int64).tobytes(), *_packed(doc[x], place[x], owners, tags)))
    return rows


def requests(buckets: Buckets, main: np.ndarray, extra: np.ndarray, doc: np.ndarray, place: np.ndarray, owners: np.ndarray, tags: np.ndarray, *, kind: int = 0, holder: np.ndarray | None = None, rule: str = "earlier", within: bool = False, settled: tuple[np.ndarray, np.ndarray] | None = None):
    """Arrow batches with the packed entries of one chunk; entries come in document and place order.

    main, extra: 64 and 16 bits of the key.  doc: number of the document in the
    chunk; owners, tags: by that number.  holder: what owns the entry, if it isn't
    its document's owner.  within: a key's later places in one document are marked
    too.  settled: documents and places marked beforehand."""
    held = owners[doc] if holder is None else holder
    marked, witness = _marked(main, extra, held, rule)
    ask = ~marked
    if rule == "other":
        ask[witness] = True
    elif within:
        marked |= _again(main, extra, doc)
        ask = ~marked
    rows: list[tuple] = []
    own, at = (doc[marked], place[marked]) if settled is None else (np.concatenate((doc[marked], settled[0])), np.concatenate((place[marked], settled[1])))
    if len(own):
        order = np.lexsort((at, own)) if settled is not None else slice(None)
        own, at = own[order], at[order]
        rows.append((kind, int(own[0] + at[0]) % buckets.coarse, True, b"", b"", None, *_packed(own, at, owners, tags)))
    asked = np.flatnonzero(ask)
    rows += _dealt(bucket_of(main[asked], buckets.coarse), kind, asked, main, extra, holder, doc, place, owners, tags)
    yield from _batches(rows, _REQUEST_SCHEMA)


def _entries(rows: list[dict]) -> tuple:
    """Entries of several rows: main, extra, holder (or None), document number, place; owners and tags by that number."""
    owners, tags, counts, places = (np.concatenate(c) for c in zip(*map(_unpacked, rows), strict=True))
    main = np.concatenate([np.frombuffer(r["main"], np.uint64) for r in rows])
    extra = np.concatenate([np.frombuffer(r["extra"], np.uint16) for r in rows])
    holder = None if rows[0]["holders"] is None else np.concatenate([np.frombuffer(r["holders"], np.int64) for r in rows])
    return main, extra, holder, np.repeat(np.arange(len(owners), dtype=np.int32), counts), places, owners, tags


def _deal_again(buckets: Buckets, rules: tuple[str, ...]):
    """Rows of coarse buckets, one bucket after another, to rows of the buckets within them; entries that those gathered with them mark are settled."""

    def flush(rows: list[dict], kind: int, coarse: int) -> list[tuple]:
        main, extra, holder, doc, place, owners, tags = _entries(rows)
        marked, witness = _marked(main, extra, owners[doc] if holder is None else holder, rules[kind])
        ask = ~marked
        if rules[kind] == "other":
            ask[witness] = True
        asked, settled = np.flatnonzero(ask), np.flatnonzero(marked)
        out = _dealt(bucket_of(main[asked], buckets.n), kind, asked, main, extra, holder, doc, place, owners, tags)
        if len(settled):
            out.append((kind, coarse * buckets.n // buckets.coarse, True, b"", b"", None, *_packed(doc[settled], place[settled], owners, tags)))
        return out

    def deal(batches):
        held, size, of = [], 0, None
        for batch in batches:
            for row in _rows(batch):
                if row["settled"]:
                    yield from _batches([(row["kind"], row["bucket"] * buckets.n // buckets.coarse, True, *(None if row[c] is None else bytes(row[c]) for c in _REQUEST_SCHEMA.names[3:]))], _REQUEST_SCHEMA)
                    continue
                if held and (size >= buckets.again_entries or of != (row["kind"], row["bucket"])):
                    yield from _batches(flush(held, *of), _REQUEST_SCHEMA)
                    held, size = [], 0
                of = (row["kind"], row["bucket"])
                held.append({k: bytes(v) if isinstance(v, pa.Buffer) else v for k, v in row.items()})
                size += len(row["main"]) // 8
        if held:
            yield from _batches(flush(held, *of), _REQUEST_SCHEMA)

    return deal


def _answer(buckets: Buckets, rules: tuple[str, ...]):
    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        settled, asked = [], []
        for row in _rows(table):
            (settled if row["settled"] else asked).append(row)
        out = []
        if settled:
            owners, tags, counts, places = (np.concatenate(c) for c in zip(*map(_unpacked, settled), strict=True))
            out.append((np.repeat(np.arange(len(owners)), counts), places, owners, tags))
        if asked:
            main, extra, holder, doc, place, owners, tags = _entries(asked)
            marked = np.zeros(len(main), bool)
            n_slices = -(-len(main) // buckets.slice_entries)
            slice_of = mixed_slice(main, n_slices)
            for i in range(n_slices):
                x = np.flatnonzero(slice_of == i) if n_slices > 1 else slice(None)
                marked[x] = _marked(main[x], extra[x], owners[doc[x]] if holder is None else holder[x], rules[kind])[0]
            out.append((doc[marked], place[marked], owners, tags))
        rows = []
        for doc, place, owners, tags in out:
            part = (tag_numbers(tags) % np.uint64(buckets.n)).astype(np.int64)[doc]
            order = np.argsort(part, kind="stable")
            doc, place, part = doc[order], place[order], part[order]
            starts = runs(part)
            rows += [(kind, int(part[s]), *_packed(doc[s:e], place[s:e], owners, tags)) for s, e in zip(starts, np.append(starts, len(part))[1:], strict=True)]
        return pa.Table.from_batches(_batches(rows, _ANSWER_SCHEMA, 4096), schema=_ANSWER_SCHEMA)

    return answer


def mixed_slice(main: np.ndarray, n: int) -> np.ndarray:
    """A slice of the keys, by bits that don't name the bucket."""
    return ((main & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16)


def marked_places(asked: DataFrame, buckets: Buckets, rules: tuple[str, ...] = ("earlier",)) -> DataFrame:
    """owner, tag and, by kind of request, at0, at1, ... (binary, read with places_of): the marked places of each document that has any. Cut from its lineage.

    A missing doc_id is the owner NO_ID.  rules: by kind of request."""
    n_tasks = max(shuffle_partitions(asked.sparkSession), min(buckets.n, MOST_TASKS))
    if buckets.n > buckets.coarse:
        # a coarse bucket is split over as many tasks as it has buckets, so that no task gathers one
        spread = F.pmod(F.xxhash64("main"), F.lit(-(-buckets.n // buckets.coarse)))
        asked = asked.repartition(n_tasks, "bucket", spread).sortWithinPartitions("kind", "bucket").mapInArrow(_deal_again(buckets, rules), REQUEST)
    # a task for each bucket, as far as a job can have so many
    asked = asked.repartitionById(buckets.n, "bucket") if buckets.n <= MOST_TASKS else asked.repartition(n_tasks, "bucket")
    answers = cut(asked.groupBy("kind", "bucket").applyInArrow(_answer(buckets, rules), _ANSWER))
    schema = ", ".join(["owner long", "tag binary", *(f"at{k} binary" for k in range(len(rules)))])
    return answers.groupBy("part").applyInArrow(_by_document(len(rules)), schema)


def _by_document(n_kinds: int):
    def collect(answers: pa.Table) -> pa.Table:
        found: dict[tuple[int, bytes], list[list[np.ndarray]]] = {}
        for row in _rows(answers):
            owners, tags, counts, places = _unpacked(row)
            for owner, tag, own in zip(owners.tolist(), tags.tolist(), np.split(places.astype(np.uint32), np.cumsum(counts)[:-1]), strict=True):
                found.setdefault((owner, tag), [[] for _ in range(n_kinds)])[row["kind"]].append(own)
        columns = [[None if not kinds[k] else zlib.compress(planes(np.diff(np.unique(np.concatenate(kinds[k])), prepend=0)), 1) for kinds in found.values()] for k in range(n_kinds)]
        owner, tag = ([key[i] for key in found] for i in (0, 1))
        return pa.table({"owner": pa.array(owner, pa.int64()), "tag": pa.array(tag, pa.binary()), **{f"at{k}": pa.array(c, pa.binary()) for k, c in enumerate(columns)}})

    return collect


def places_of(data: bytes | None) -> np.ndarray:
    """The places of one document, ascending."""
    return np.empty(0, np.int64) if data is None else np.cumsum(unplanes(zlib.decompress(data)), dtype=np.int64)


def with_places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, tag, text, more) with the marked places of each; both sides are sorted and met in the JVM, and a row is held, not its part."""
    keys = rows.withColumn("owner", F.coalesce("doc_id", F.lit(int(NO_ID))))
    return keys.join(found, ["owner", "tag"], "left").drop("owner")
