"""Quality classifier by co-training of a text view and a metadata view.

The text view is hashed byte n-grams of the whole text; the metadata view is
source, language and length.  Both start from labelled rows.  In each round every
document outside the fit is seen by both views; those that one view is sure of
teach the other.  What they teach travels as sums: number, feature sums and sums
of squares of each class, added up in a tree of tasks.  From the sums comes each
view's prior, the difference of the classes' means over their common variance
(a diagonal discriminant), and around it the view is fitted to the labelled rows.
Each view is calibrated on labelled rows that it has not learnt from; the
calibrated views, taken as independent given the class, are combined, and all
documents are scored.

Labelled rows for the fit are bounded, as they come to the driver: about
`labelled_rows` of them, by a hash of doc_id.  Everything else covers all
documents.

Defined cases: a null text counts as empty, null metadata as a value of their
own; labels that are null, or of ids that no document has, are ignored, of
repeated labels of an id the least counts, and of rows with one labelled id one
teaches; without labels of both kinds every score is 0.5; repeated rows are
scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, tag_of
from weftline.llm.linear import DIMENSIONS, ROWS, dense, fit_logistic, margins, ngram_counts, scaled, sigmoid, sparse

LABELLED_ROWS = 4000
ROUNDS, SURE = 2, 0.9
#: Every so many labelled rows are kept back for the calibration.
CALIBRATION = 4
META = 512
KEEP_FROM = 0.5
#: Groups in which sums are added up, level by level.
TREE = (8192, 128, 1)
#: Weight of the prior from all documents: its margins' spread.
PRIOR_SPREAD = 2.0


def _hash(text: str, salt: int) -> int:
    h = salt
    for b in text.encode():
        h = (h * 0x01000193 ^ b) & 0xFFFFFFFF
    return (h ^ h >> 13) % (META - 32)


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One hashed place for the source, one for the language, one for the length by powers of two."""
    x = np.zeros((len(source), META), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        x[i, _hash(s or "\0", 17)] = x[i, _hash(g or "\0", 31)] = 1
        x[i, META - 32 + min(int(n or 0), 1 << 30).bit_length()] = 1
    return x


def class_sums(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each class (0, 1): number of rows, sums and sums of squares of the features."""
    return np.stack([np.concatenate(([own.sum()], own @ x, own @ (x * x))) for own in ((label == k).astype(np.float64) for k in (0, 1))])


def prior_of(sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weights (last: intercept) of the diagonal discriminant between the classes that were summed up, scaled by the margins of x."""
    d = (sums.shape[1] - 1) // 2
    n = np.maximum(sums[:, :1], 1)
    mean, square = sums[:, 1 : 1 + d] / n, sums[:, 1 + d :] / n
    spread = (np.maximum(square - mean * mean, 0) * sums[:, :1]).sum(0) / max(sums[:, 0].sum(), 1)
    w = (mean[1] - mean[0]) / (spread + 1e-5)
    m = x @ w
    w *= PRIOR_SPREAD / max(m.std(), 1e-9)
    return np.append(w, -w @ mean.mean(0))[:, None]


@dataclass(frozen=True)
class View:
    """Weights of one view, and the line that turns its margin into a calibrated log-odds."""

    weights: np.ndarray
    line: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return margins(margins(x, self.weights), self.line)[:, 0]


def fitted(x: np.ndarray, label: np.ndarray, back: np.ndarray, sums: np.ndarray, **how) -> View:
    """A view fitted to labelled rows around the prior of the sums, calibrated on the rows kept back."""
    y = label[~back]
    weights = fit_logistic(x[~back], y, 0.5 / np.bincount(y.astype(int), minlength=2)[y.astype(int)], prior=prior_of(sums, x[~back]), **how)
    held = margins(x[back], weights)
    size = max(float(held.std()), 1e-9)
    line = fit_logistic(held / size, label[back], rate=1.0, turns=400)
    return View(weights, np.stack([line[0] / size, line[1]]))


@dataclass(frozen=True)
class QualityModel:
    text: View
    meta: View
    log_prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, of the metadata view, and of both together."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.log_prior)


def _views(batches, model_of):
    """For pieces of the batches: the piece, and what model_of makes of its two views."""
    for batch in batches:
        at = 0
        for (texts,) in chunks([batch], (), rows=ROWS):
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield part, model_of(ngram_counts(texts), part)


def _meta(part: pa.RecordBatch) -> np.ndarray:
    return meta_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


_SAMPLE = "doc_id long, tag binary, source string, lang string, n_chars long, label int, slots binary, counts binary"


def _sparse(batches):
    names = [c.split()[0] for c in _SAMPLE.split(", ")]
    for part, (slots, values) in _views(batches, lambda counts, part: sparse(counts)):
        yield pa.record_batch([*(part.column(c) for c in names[:6]), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=names)


def _taught(model: QualityModel, sure: float):
    """Sums of what the sure documents of each view teach the other: one row per task."""

    def taught(batches):
        sums = {"text": np.zeros((2, 1 + 2 * DIMENSIONS)), "meta": np.zeros((2, 1 + 2 * META))}

        def add(counts, part):
            views = {"text": scaled(counts), "meta": _meta(part)}
            p = dict(zip(views, model.scores(*views.values()), strict=False))
            for one, other in (("text", "meta"), ("meta", "text")):
                sums[other] += class_sums(views[other], np.where(p[one] >= sure, 1, np.where(p[one] <= 1 - sure, 0, -1)))

        for _ in _views(batches, add):
            pass
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums["text"].tobytes()]), pa.array([sums["meta"].tobytes()])], names=["place", "text", "meta"])

    return taught


def _added(table: pa.Table) -> pa.Table:
    total = [sum(np.frombuffer(x.as_buffer()) for x in table.column(c)) for c in ("text", "meta")]
    return pa.table({"place": table.column("place").slice(0, 1), "text": pa.array([total[0].tobytes()]), "meta": pa.array([total[1].tobytes()])})


def _lessons(rows: DataFrame, model: QualityModel, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums for the text view and for the metadata view over all rows, added up in a tree."""
    sums = rows.mapInArrow(_taught(model, sure), "place long, text binary, meta binary")
    for groups in TREE:
        sums = sums.withColumn("place", F.col("place") % groups).groupBy("place").applyInArrow(_added, sums.schema)
    found = sums.collect()  # one row
    return tuple(np.frombuffer(found[0][c]).reshape(2, -1) if found else 0.0 for c in ("text", "meta"))


def train(rows: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, sure: float = SURE) -> QualityModel | None:
    """rows: doc_id, tag, text, source, lang, n_chars; labels: doc_id, label. None without both labels to learn from and to calibrate on."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    there = known.join(rows.select("doc_id"), "doc_id", "left_semi")
    n = there.count()
    if not n:
        return None
    share = min(1.0, labelled_rows / n)
    drawn = F.broadcast(there.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))  # about labelled_rows ids
    found = rows.join(drawn, "doc_id").mapInArrow(_sparse, _SAMPLE)
    each = found.groupBy("doc_id").agg(F.min_by(F.struct("source", "lang", "n_chars", "label", "slots", "counts"), "tag").alias("r"))
    got = [r["r"] for r in sorted(each.collect(), key=lambda r: r["doc_id"])]
    label = np.array([r["label"] for r in got], float)
    back = np.arange(len(label)) % CALIBRATION == 0
    if min((np.bincount(label[m].astype(int), minlength=2).min() for m in (back, ~back)), default=0) == 0:
        return None
    text, meta = scaled(dense(got)), meta_features(*([r[c] for r in got] for c in ("source", "lang", "n_chars")))
    log_prior = float(np.log(label.mean() / (1 - label.mean())))
    own = [class_sums(x[~back], label[~back]) for x in (text, meta)]
    free = rows.join(drawn.select("doc_id"), "doc_id", "left_anti")
    model, lessons = None, (0.0, 0.0)
    for turn in range(rounds + 1):
        if turn:
            lessons = _lessons(free, model, sure)
        model = QualityModel(fitted(text, label, back, own[0] + lessons[0]), fitted(meta, label, back, own[1] + lessons[1], rate=2.0, decay=1e-3), log_prior)
    return model


def _score(model: QualityModel | None):
    def views_of(counts, part):
        return [np.full(len(counts), 0.5)] * 3 if model is None else model.scores(scaled(counts), _meta(part))

    def score(batches):
        for part, views in _views(batches, views_of):
            yield pa.record_batch([part.column("doc_id"), *(pa.array(v.astype(float)) for v in views), pa.array(views[2] >= KEEP_FROM)], names=["doc_id", "text_score", "meta_score", "quality_score", "kept"])

    return score


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, text_score, meta_score, quality_score, kept of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(id_col, text_col).alias("tag"), text.alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.length(text).cast("long").alias("n_chars"))
    model = train(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")), labelled_rows)
    return rows.mapInArrow(_score(model), "doc_id long, text_score double, meta_score double, quality_score double, kept boolean")
