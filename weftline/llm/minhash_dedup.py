"""Near-duplicate documents by circulant MinHash and exact Jaccard verification.

A first permutation scatters the shingles over a ring of 2**32 places; a second
one, shifted around the ring by k, orders them for signature coordinate k.  So
two permutations make all coordinates.  Bands of ROWS coordinates put documents
into buckets; BANDS of them find a pair of similarity 0.8 but for 2 in 100,000.

Documents with one shingle set are one node.  Nodes of a bucket are not paired
with each other.  First each node is compared, on whole shingle sets, with one
leader: the node of its buckets that meets most others, such as the text that
others are copies of.  Linked nodes merge.  What then is left in
buckets of several components goes through an exact join: two sets of the wanted
similarity share one of their first shingles, rare ones first, at places that
leave room for enough others.  Only pairs across components that pass this are
compared.  So links between nodes already connected are not computed, no group's
pairs are written out, and no link between components is lost.

Defined cases: a text of fewer words than a shingle is one shingle, a null or
blank text has none and is linked with nothing; rows of one doc_id are one
document; rows without doc_id come after all others, and a component of such
rows only has a null component_id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, chunks, cut, keyed, mix, ranked, window_hashes, word_hashes
from weftline.llm.components import connected

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
BANDS, ROWS = 36, 6
#: A bucket of more than this part of all members is hot, and its members are dealt to so many parts.
HOT_SHARE, SALTS = 1000, 64
#: Nodes without a doc_id are numbered from here on.
_NAMELESS = 1 << 62
_SIGMA, _PI = np.uint64(0x2545F4914F6CDD1D), (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    (words,), counts = word_hashes(texts, lower=True)
    hashes, doc, _ = window_hashes(words, counts, width)
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))) if len(doc) else np.zeros(len(texts), np.int64)
    firsts = np.cumsum(counts) - counts
    out = []
    for i, (n, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n >= width:
            out.append(np.unique(hashes[e - (n - width + 1) : e]))
        elif n:
            own = words[firsts[i] : firsts[i] + n]
            out.append(window_hashes(own, np.array([n]), n)[0])
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n circulant MinHash coordinates of each non-empty set, one row per set."""
    ring = (mix(np.concatenate(sets) ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint32)
    x, y = np.empty_like(ring), np.empty_like(ring)
    for k in range(n):
        np.add(ring, np.uint32(k), out=x)
        for shift, factor in ((16, _PI[0]), (13, _PI[1])):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, factor, out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


_SIGNED = "doc_id long, tag binary, n_shingles long, set_key binary, bands array<long>"
_SIGNED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("tag", pa.binary()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(width: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            at = 0
            for texts, _ in chunks([batch], ("doc_id",)):
                sets = shingle_sets(texts, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((0, bands), np.int64)
                if full:
                    keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                found: list = [None] * len(sets)
                for i, k in zip(full, keys.tolist(), strict=True):
                    found[i] = k
                part = batch.slice(at, len(texts))
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.record_batch([part.column("doc_id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=_SIGNED_SCHEMA)
                at += len(texts)

    return sign


def _sets(width: int):
    """node, set: the node's shingle set as sorted 64-bit numbers."""

    def sets(batches):
        for batch in batches:
            at = 0
            for texts, _ in chunks([batch], ("node",)):
                yield pa.record_batch([batch.column("node").slice(at, len(texts)), pa.array([s.astype("<u8").tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["node", "set"])
                at += len(texts)

    return sets


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _verify(percent: int):
    def verify(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set").to_pylist(), batch.column("leader_set").to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("node"), batch.column("leader"), pa.array(linked, pa.bool_())], names=["node", "leader", "linked"])

    return verify


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, leader, linked of each pair, decided on the whole sets."""
    of_node = pairs.join(sets, "node")
    of_both = of_node.join(sets.toDF("leader", "leader_set"), "leader")
    return cut(of_both.select("node", "leader", "set", "leader_set").mapInArrow(_verify(percent), "node long, leader long, linked boolean"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    done = tested.select("node", "leader")
    return pairs.join(done.union(done.select("leader", "node")), ["node", "leader"], "left_anti")


def _joined(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """frame with its components replaced by those that they are now part of."""
    rest = [c for c in frame.columns if c != "comp"]
    return frame.join(roots.toDF("comp", "root"), "comp", "left").select(*rest, F.coalesce("root", "comp").alias("comp"))


def _links(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """The found links as edges between components."""
    one = tested.where("linked").join(labels.toDF("node", "a"), "node")
    return one.join(labels.toDF("leader", "b"), "leader").select("a", "b")


def _with_bucket(members: DataFrame, buckets: DataFrame, hot: list[int]) -> DataFrame:
    """members with the columns of their buckets (one row each); hot: names of the hot buckets.

    A bucket of more than a HOT_SHARE-th of all members is hot, so that there are at
    most HOT_SHARE.  The members of a hot bucket are dealt to SALTS parts, and its row
    to each of them."""
    is_hot = F.col("bucket").isin(hot) if hot else F.lit(False)
    salted = members.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    parts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(buckets.withColumn("salt", F.explode(parts)), ["bucket", "salt"]).drop("salt")


def _active(members: DataFrame, hot: list[int]) -> DataFrame:
    """Members of the buckets in which several components are left."""
    buckets = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return _with_bucket(members, buckets.select("bucket"), hot)


def _after(tested: DataFrame, labels: DataFrame, members: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Labels, and members of the buckets that still have several components, once the found links have merged components."""
    roots = connected(_links(tested, labels))
    return cut(_joined(labels, roots)), cut(_active(_joined(members, roots), hot))


def _near_in_size(percent: int):
    return 100 * F.least("size", "leader_size") >= percent * F.greatest("size", "leader_size")


def _star_pairs(members: DataFrame, percent: int, hot: list[int]) -> DataFrame:
    """Each node with the one leader that it shares most buckets with; a bucket's leader is its node that meets most others over all buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("others"))
    meets = _with_bucket(members, sizes, hot).groupBy("node").agg(F.sum("others").alias("meets"))
    stars = members.join(meets, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "size"), F.struct("meets", "node")).alias("l"))
    pairs = _with_bucket(members, stars, hot).where("node <> l.node").select("node", "size", F.col("l.node").alias("leader"), F.col("l.size").alias("leader_size"))
    pairs = pairs.where(_near_in_size(percent)).groupBy("node", "leader").count()
    return pairs.groupBy("node").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))


def _shingles(batches):
    """node, size, shingle: a row for each member of each set."""
    for batch in batches:
        for node, data in zip(batch.column("node").to_pylist(), batch.column("set").to_pylist(), strict=True):
            shingles = _unpacked(data).view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(shingles), node)), pa.array(np.full(len(shingles), len(shingles))), pa.array(shingles)], names=["node", "size", "shingle"])


def _prefix_pairs(members: DataFrame, sets: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that can be similar enough, by an exact join on first shingles.

    Shingles are ordered by how many of these nodes have them.  Sets of a and b
    members that are similar enough have at least percent / (100 + percent) *
    (a + b) in common.  Their first common shingle has room for that many from its
    place on in both sets, so the place of each bounds the other's size; for the
    smaller set this leaves about the first ninth of its shingles, for the larger
    one the first fifth.  Shingles of a single node come first, match nothing, and
    are only counted.

    Rows of one shingle that belong to one component are not paired: those of the
    component that most of its rows belong to meet the other rows only."""
    nodes = members.select("node", "comp").distinct()
    rows = sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(_shingles, "node long, size long, shingle long")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ordered = F.array_sort(F.collect_list(F.struct("n", "shingle")))
    per_node = rows.join(shared, "shingle").groupBy("node", "size").agg(ordered.alias("shingles"))
    alone = F.col("size") - F.size("shingles")
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    first = per_node.where(length > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("shingles", 1, length.cast("int"))).alias("at", "s"))
    room = F.col("size") - F.col("alone") - F.col("at")
    most = F.floor((100 + percent) * room / percent) - F.col("size")  # the largest size that a partner can have
    first = first.select("node", "size", F.col("s.shingle").alias("shingle"), most.alias("most")).where(100 * F.col("most") >= percent * F.col("size"))
    first = cut(first.join(nodes, "node"))
    counted = first.groupBy("shingle", "comp").count()
    main = counted.groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    placed = cut(first.join(main.select("shingle", "main"), "shingle").withColumn("is_main", F.col("comp") == F.col("main")).drop("main"))
    large = placed.select("shingle", *(F.col(c).alias(f"large_{c}") for c in ("node", "size", "comp", "most", "is_main")))
    small = placed.where("most >= size")
    fits = (F.col("large_size") <= F.col("most")) & (F.col("size") <= F.col("large_most")) & (100 * F.col("size") >= percent * F.col("large_size"))
    order = (F.col("large_size") > F.col("size")) | ((F.col("large_size") == F.col("size")) & (F.col("large_node") != F.col("node")))
    found = [large.join(small.where("NOT is_main"), "shingle"), large.where("NOT large_is_main").join(small.where("is_main"), "shingle")]
    both = found[0].unionByName(found[1]).where(fits & order & (F.col("comp") != F.col("large_comp")))
    pairs = both.select(F.greatest("node", "large_node").alias("node"), F.least("node", "large_node").alias("leader"))
    return _untested(pairs.distinct(), tested)


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with numbers of their own for those without a doc_id, in the order of their sets."""
    nameless = classes.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return classes
    numbered = ranked(nameless, F.col("set_key"), name="place").withColumn("node", F.lit(_NAMELESS) + F.col("place")).drop("place")
    return cut(classes.where("doc_id IS NOT NULL").unionByName(numbered))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, n_shingles, component_id, stays of every row; stays: true for one row of each component (and its repetitions)."""
    texts = keyed(docs, id_col, text_col)
    signed = cut(texts.mapInArrow(_sign(width, bands, rows), _SIGNED))
    owner = F.coalesce("doc_id", F.lit(int(NO_ID)))
    named = signed.where("set_key IS NOT NULL").withColumn("owner", owner)
    classes = named.groupBy("set_key").agg(F.min(F.struct("owner", "doc_id", "tag")).alias("least"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = _numbered(cut(classes.select("set_key", F.col("least.owner").alias("node"), F.col("least.doc_id").alias("doc_id"), F.col("least.tag").alias("tag"), "size", "bands")))

    placed = classes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = cut(shared.select("bucket", "n"))
    n_members = shared.agg(F.sum("n")).first()[0] or 0
    hot = [r["bucket"] for r in shared.where(F.col("n") > n_members // HOT_SHARE).collect()]  # HOT_SHARE rows at most
    members = cut(_with_bucket(placed, shared.select("bucket"), hot).select("bucket", "node", "size", F.col("node").alias("comp")))

    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("of"), F.col("tag").alias("of_tag"))
    whole = texts.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("of"), F.col("tag").alias("of_tag"), "text")
    held = wanted.join(whole, ["of", "of_tag"]).groupBy("of", "of_tag").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = cut(held.select("node", "text").mapInArrow(_sets(width), "node long, set binary"))

    labels = cut(members.select("node", "comp").distinct())
    tested = _tested(_star_pairs(members, percent, hot), sets, percent)
    labels, members = _after(tested, labels, members, hot)
    tested = _tested(_prefix_pairs(members, sets, tested, percent), sets, percent)
    labels, _ = _after(tested, labels, members, hot)
    firsts = classes.select("set_key", "node", F.col("tag").alias("first_tag"))
    out = signed.join(firsts, "set_key", "left").join(labels, "node", "left")
    component = F.coalesce("comp", "node", "doc_id")
    stays = F.col("node").isNull() | ((F.coalesce("comp", "node") == F.col("node")) & (F.col("tag") == F.col("first_tag")))
    return out.select("doc_id", "tag", "n_shingles", F.when(component < _NAMELESS, component).alias("component_id"), stays.alias("stays"))


def near_duplicate_report(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    found = near_duplicates(docs, width)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
