"""Hard negatives by distributed radix selection over integer scores.

Components become floor(SCALE * x), so scores are whole numbers.  Anchors are a
stated set of rows (every ANCHOR_EVERY-th id), scored against all rows in blocks: a
block of rows and a block of anchors are two packed matrices, which Spark
brings together and a task multiplies.  No row of scores leaves a task.

A window is a range of scores in which an anchor wants its first k rows: all
scores of its own label for its positives, then for each positive a part of
that one's score among other labels.  Passes over the blocks find the k-th row's
score digit by digit: each block sends a histogram of DIGIT buckets of each
window's range, Spark adds them up, the bucket that holds the k-th row becomes
the range, and so on until no more than ENOUGH * k rows qualify, or the range
is one score.  A last pass gathers the rows from there up; of what qualifies a
block sends its first k at most, as the others can't be among the first k,
so ties between thousands of rows don't travel.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do those whose squares add up to 2^56 or more, as
shares of their scores might not fit; of rows of one id the least by label and vector
counts; shorter vectors count as ending in zeros; equal scores go by the smaller
id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

SCALE = 256
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies.
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Buckets of a digit; a window is narrow enough once so many times k rows qualify.
DIGIT, ENOUGH = 64, 4
#: Bytes of a packed block of rows and of anchors.
ROW_BLOCK_BYTES, ANCHOR_BLOCK_BYTES = 4 << 20, 1 << 19
#: Scores that a task holds at a time.
_STRIP = 1 << 21
_LARGEST = float(1 << 56)

_PACKED = "block int, ids binary, labels binary, matrix binary"
_PACKED_SCHEMA = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary())])
_WINDOW = ["anchor", "positive", "lo", "hi", "top", "need", "above"]


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, q (array of long): one row of each id that takes part."""
    vec = F.col(vec_col)
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), usable.alias("usable")).where("usable AND id IS NOT NULL AND label IS NOT NULL")
    named = named.select("id", "label", F.transform("vec", lambda x: F.floor(x.cast("double") * float(SCALE))).alias("q"))
    named = named.withColumn("squares", F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return named.where(F.col("squares") < _LARGEST).groupBy("id").agg(F.min(F.struct("label", "q", "squares")).alias("r")).select("id", "r.label", "r.q", "r.squares")


def _packer(width: int):
    """All rows of a block as one row: ids, labels, and the vectors as a matrix of long."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        q = table.column("q").combine_chunks()
        flat, ends = q.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(q).to_numpy(zero_copy_only=False))
        matrix = np.zeros((len(ids), width), np.int64)
        sizes = np.diff(ends, prepend=0)
        row = np.repeat(np.arange(len(ids)), sizes)
        matrix[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
        kind = next(t for t in (np.int16, np.int32, np.int64) if not len(flat) or (np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), [ids[order].astype("<i8").tobytes()], [table.column("label").to_numpy()[order].astype("<i8").tobytes()], [matrix[order].astype(kind).tobytes()]], schema=_PACKED_SCHEMA)

    return pack


def _packed(rows: DataFrame, n_blocks: int, width: int) -> DataFrame:
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "label", "q")
    return cut(dealt.groupBy("block").applyInArrow(_packer(width), _PACKED))


def _matrix(ids: bytes, matrix: bytes, width: int) -> np.ndarray:
    n = len(ids) // 8
    return np.frombuffer(matrix, {2: "<i2", 4: "<i4", 8: "<i8"}[len(matrix) // max(n * width, 1)] if n * width else "<i2").reshape(n, width)


class _Cells:
    """Row blocks and anchor blocks, and what each pair of them makes of the windows of the anchors."""

    def __init__(self, rows: DataFrame, anchor_every: int):
        rows = cut(rows)
        n, width, most = rows.agg(F.count("*"), F.max(F.size("q")), F.max("squares")).first()
        n_anchors = rows.where(F.col("id") % anchor_every == 0).count()
        self.width, self.exact = width or 1, np.float32 if (most or 0) < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        blocks = lambda count, size: max(1, -(-count * self.width * 2 // size))
        self.n_rows, self.n_anchors = blocks(n, ROW_BLOCK_BYTES), blocks(n_anchors, ANCHOR_BLOCK_BYTES)
        anchors = rows.where(F.col("id") % anchor_every == 0)
        self.rows = _packed(rows, self.n_rows, self.width).select(F.col("block").alias("row_block"), F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"), F.col("matrix").alias("r_matrix"))
        self.anchors = _packed(anchors, self.n_anchors, self.width)
        self.all = anchors.select(F.col("id").alias("anchor"), "squares")
        self.norm = float(most or 0)

    def run(self, windows: DataFrame, same: bool, work, schema: str) -> DataFrame:
        """work over each pair of blocks with the windows of the block's anchors; windows: the columns _WINDOW."""
        block = F.pmod(F.xxhash64(F.col("anchor")), F.lit(self.n_anchors)).cast("int")
        asked = windows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(*_WINDOW))).alias("windows"))  # of the anchors of one block
        placed = self.anchors.join(asked, "block").withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(self.n_rows - 1))))
        return placed.join(self.rows, "row_block").select("ids", "labels", "matrix", "windows", "r_ids", "r_labels", "r_matrix").mapInArrow(_cell(self.width, self.exact, same, work), schema)


def _cell(width: int, exact, same: bool, work):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                of = {name: row[name].as_py() for name in ("ids", "labels", "matrix", "r_ids", "r_labels", "r_matrix")}
                ids, r_ids = np.frombuffer(of["ids"], "<i8"), np.frombuffer(of["r_ids"], "<i8")
                labels, r_labels = np.frombuffer(of["labels"], "<i8"), np.frombuffer(of["r_labels"], "<i8")
                a, r = _matrix(of["ids"], of["matrix"], width).astype(exact), _matrix(of["r_ids"], of["r_matrix"], width).astype(exact)
                fields = row["windows"].values
                w = {name: fields.field(i).to_numpy(zero_copy_only=False) for i, name in enumerate(_WINDOW)}
                at = np.searchsorted(ids, w["anchor"])
                strip = max(1, _STRIP // max(len(r_ids), 1))
                for first in range(0, len(ids), strip):
                    own = np.flatnonzero((at >= first) & (at < first + strip))
                    if not len(own):
                        continue
                    scores = (a[first : first + strip] @ r.T).astype(np.int64)
                    found = []
                    anchor = -1
                    for i in own.tolist():
                        if at[i] != anchor:
                            anchor = int(at[i])
                            take = (r_labels == labels[anchor]) == same
                            if same:
                                take &= r_ids != ids[anchor]
                            s, x = scores[anchor - first][take], r_ids[take]
                        found += work({name: int(w[name][i]) for name in _WINDOW}, s, x)
                    if found:
                        yield from _record(found)

    return run


def _record(found: list[tuple]):
    """Rows of a histogram (anchor, positive, counts) or of gathered rows (anchor, positive, score, id)."""
    columns = list(zip(*found, strict=True))
    if len(columns) == 3:
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["anchor", "positive", "counts"])
    else:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["anchor", "positive", "score", "id"])


def _histogram(w: dict, scores: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """Rows in each DIGIT-th of the window's range, from its top."""
    inside = scores[(scores >= w["lo"]) & (scores <= w["hi"])]
    if not len(inside):
        return []
    step = -(-(w["hi"] - w["lo"] + 1) // DIGIT)
    return [(w["anchor"], w["positive"], np.bincount((w["hi"] - inside) // step, minlength=DIGIT).astype(np.int32))]


def _gather(k: int):
    """The rows that qualify, of which no more than the first k of a block can be among the first k of all."""

    def gather(w: dict, scores: np.ndarray, ids: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((scores >= w["lo"]) & (scores <= w["top"]))
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= least]
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
        return [(w["anchor"], w["positive"], int(scores[i]), int(ids[i])) for i in at]

    return gather


def _narrowed(windows: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The windows with the bucket of the k-th row as their range; whole windows, if they hold fewer rows."""
    summed = counts.groupBy("anchor", "positive").agg(*(F.sum(F.get("counts", i)).alias(f"c{i}") for i in range(DIGIT)))
    step = F.expr(f"(hi - lo + {DIGIT}) div {DIGIT}")
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto"), F.lit(0).alias("buckets"))

    def fold(state, c):
        return F.when(state.upto >= F.col("need"), state).otherwise(F.struct(state.upto.alias("before"), (state.upto + c).alias("upto"), (state.buckets + 1).alias("buckets")))

    at = F.aggregate(F.array(*(F.coalesce(f"c{i}", F.lit(0).cast("long")) for i in range(DIGIT))), start, fold)
    met = windows.join(summed, ["anchor", "positive"], "left").withColumn("at", at).withColumn("step", step)
    full = F.col("at.upto") >= F.col("need")
    hi = F.when(full, F.col("hi") - (F.col("at.buckets") - 1) * F.col("step")).otherwise(F.col("hi"))
    lo = F.when(full, F.greatest(F.col("lo"), F.col("hi") - F.col("at.buckets") * F.col("step") + 1)).otherwise(F.col("lo"))
    done = ~full | (F.col("above") + F.col("at.upto") <= ENOUGH * k) | (F.col("step") == 1)
    return met.select("anchor", "positive", lo.alias("lo"), hi.alias("hi"), "top", F.when(full, F.col("need") - F.col("at.before")).otherwise(F.col("need")).alias("need"), (F.col("above") + F.when(full, F.col("at.before")).otherwise(0)).alias("above"), done.alias("done"))


def _first(cells: _Cells, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, positive, score, id, place (from 1): the first k rows of each window, by score and id. windows: anchor, positive, lo, hi."""
    open_ = cut(windows.where("lo <= hi").select("anchor", "positive", "lo", "hi", F.col("hi").alias("top"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("above")))
    settled = []
    while open_.limit(1).count():  # once a digit of the widest range at most
        counts = cells.run(open_, same, _histogram, "anchor long, positive long, counts array<int>")
        narrowed = cut(_narrowed(open_, counts, k))
        settled.append(narrowed.where("done").drop("done"))
        open_ = narrowed.where("NOT done").drop("done")
    ready = reduce(DataFrame.unionByName, settled) if settled else open_
    gathered = cells.run(ready, same, _gather(k), "anchor long, positive long, score long, id long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "id")
    return cut(gathered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))


def hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    anchor_every: int = ANCHOR_EVERY,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    cells = _Cells(whole_vectors(rows, id_col, vec_col, label_col), anchor_every)
    reach = (F.ceil(F.sqrt(F.col("squares")) * F.lit(cells.norm**0.5 * (1 + 1e-9))) + 1).cast("long")  # no score of the anchor is larger
    first = _first(cells, cells.all.select("anchor", F.lit(0).cast("long").alias("positive"), (-reach).alias("lo"), reach.alias("hi")), positives, same=True)
    near = first.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    some = near.where("positive_score >= 0")  # a negative score leaves no room between its shares
    within = some.select("anchor", "positive", F.expr(f"({low_percent} * positive_score + 99) div 100").alias("lo"), F.expr(f"({high_percent} * positive_score) div 100").alias("hi"))
    found = _first(cells, within, negatives, same=False).join(near, ["anchor", "positive"])
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, every: int = RELABEL_EVERY, labels: int = LABELS, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """rows with the next label where the id is divisible by `every`."""
    return rows.withColumn(label_col, F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col)))


def negatives_report(rows: DataFrame) -> DataFrame:
    return hard_negatives(relabelled(rows))
