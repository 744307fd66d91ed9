"""Language identification by error-correcting output codes over n-gram classifiers.

Every language has a codeword; each bit is predicted by one binary classifier on
hashed letter n-grams.  The language whose codeword costs least is chosen, a
bit's loss weighing by how well its classifier does on labelled texts kept back
from its training; a small lead over the next language flags the answer as
ambiguous.

Training takes about `per_language` labelled texts of each language, drawn by a
hash of the row, or its share of `training_rows` where there are many languages,
and never less than LEAST: bounded by the number of languages, all of which are
learnt.  Prediction reads whole texts of all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0, as
is every text if nothing is labelled; rows without doc_id or lang don't train;
repeated rows are predicted each; other columns are ignored; an empty table
gives an empty result.  Rows that repeat in id, text and language teach once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks
from weftline.llm.linear import ROWS, dense, fit_logistic, letters_only, margins, ngram_counts, scaled, sparse

PER_LANGUAGE, TRAINING_ROWS, LEAST = 400, 8000, 20
#: Every so many drawn texts are kept back to measure the bits' classifiers.
KEPT_BACK = 5
FOLDS = 5
#: Languages up to which a codeword has a bit for every way to split them.
EXHAUSTIVE = 6
AMBIGUOUS_LEAD = 0.2
UNDETERMINED = "und"


def least_distance(n: int, width: int) -> int:
    """The most bits in which n words of this width can be made to differ by drawing: of all words, those nearer to any of n are half at most."""
    ball, d = 1, 0
    while 2 * n * ball <= 1 << width:
        d += 1
        ball += comb(width, d)
    return max(d, 1)


def codewords(n: int) -> np.ndarray:
    """n rows of bits, no two equal and no column constant: all splits for few languages, else words drawn one after another, each at least_distance or more from all before."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return ((splits[None, :] >> np.arange(n)[:, None]) & 1).astype(np.float64)
    rng, width = np.random.default_rng(7), 4 * int(np.ceil(np.log2(n))) + 8
    apart, lanes = least_distance(n, width), -(-width // 64)
    while True:
        words, bits, at = np.zeros((n, lanes), np.uint64), np.zeros((n, width), np.uint8), 0
        while at < n:
            drawn = rng.integers(0, 2, width, np.uint8)
            word = np.packbits(np.pad(drawn, (0, 64 * lanes - width))).view(np.uint64)
            if np.bitwise_count(words[:at] ^ word).sum(1).min(initial=width) >= apart:
                words[at], bits[at], at = word, drawn, at + 1
        if 0 < bits.sum(0, dtype=np.int64).min() and bits.sum(0, dtype=np.int64).max() < n:
            return bits.astype(np.float64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and lead over the next, per row."""
        m = margins(x, self.weights)
        signs = 2 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -m * s) * self.trust).sum(1) for s in signs], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        ordered = np.sort(share, 1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        return best, ordered[:, -1], lead


def _features(batches):
    table = letters_only()
    for batch in batches:
        at = 0
        for (texts,) in chunks([batch], (), rows=ROWS):
            slots, values = sparse(ngram_counts(texts, table))
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield pa.record_batch([part.column("lang"), part.column("draw"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["lang", "draw", "slots", "counts"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, training_rows: int = TRAINING_ROWS) -> LanguageModel:
    """labelled: doc_id, text, lang, without nulls. A bounded number of rows of each language comes to the driver, as features."""
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((1, 1)), np.ones(1))
    each = max(LEAST, min(per_language, training_rows // len(languages)))
    share = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["count"]) * (1 << 30))) for r in sizes], "lang string, share long")
    drawn = labelled.withColumn("draw", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share"))
    found = drawn.groupBy("lang", "draw").agg(F.first("text").alias("text")).mapInArrow(_features, "lang string, draw long, slots binary, counts binary")
    rows = sorted(found.collect(), key=lambda r: (r["lang"], r["draw"]))
    code, number = codewords(len(languages)), {v: i for i, v in enumerate(languages)}
    x, y = scaled(dense(rows)), np.array([number[r["lang"]] for r in rows])
    weight = 1 / np.bincount(y, minlength=len(languages))[y]
    back = np.arange(len(y)) % KEPT_BACK == KEPT_BACK - 1
    weights = fit_logistic(x[~back], code[y[~back]], weight[~back])
    if not back.any():
        return LanguageModel(languages, code, weights, np.ones(code.shape[1]))
    right = (((margins(x[back], weights) > 0) == code[y[back]]) * weight[back, None]).sum(0) / weight[back].sum()
    return LanguageModel(languages, code, weights, np.clip(2 * right - 1, 0.05, 1))


def _predict(model: LanguageModel):
    names = np.array([*model.languages, UNDETERMINED], object)
    table = letters_only()

    def predict(batches):
        for batch in batches:
            at = 0
            for (texts,) in chunks([batch], (), rows=ROWS):
                known = np.array([bool(model.languages) and any(map(str.isalpha, t.decode())) for t in texts])
                best, score, lead = (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
                if known.any():
                    best, score, lead = model.predict(scaled(ngram_counts(texts, table)))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(~known | (lead < AMBIGUOUS_LEAD))],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; rows whose crc32(doc_id) is a multiple of FOLDS don't train."""
    key = F.col(id_col).cast("long")
    fold = F.crc32(key.cast("string").cast("binary")) % FOLDS
    rows = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    labelled = rows.where("NOT held_out AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    model = train(labelled, per_language, training_rows)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
