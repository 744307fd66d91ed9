"""Spelling variants by symmetric deletes: words one letter apart, each led to the most frequent one.

A document's words are its runs of letters, A-Z in lower case.  So that variants
are there to be found, one in SLIP_ONE_IN pairs of document and word loses a
letter, which one the CRC-32 of the pair says.  Counted over all documents they are the
vocabulary, whose words have numbers.

Every word emits itself and its distinct single deletions, as 64-bit polynomial
hashes with the word's number, so that a row is as small for a word of a hundred
thousand letters as for one of five.  Deletions within a run of one letter are
one string and those in different runs are different ones, so a word emits
a row per run.  Words that share a key meet in an equi-join, and the distance
of each pair is verified on the words themselves.  Two words at distance one
share exactly one key: what is left of both without the letter that differs, or
the shorter word.  So pairs need no distinct.  Words that share a key are few
at any size, as each of them is the key with one letter put in.

A word's form is its most frequent near word, if that is FORM_TIMES as
frequent.  Forms grow in frequency from step to step, so they lead to roots, which
joins of the table of forms with itself find, the way doubling each time.

Defined cases: a null or empty text has no words; a null doc_id is written as
nothing before the colon; repeated rows count each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, mix
from weftline.llm.line_dedup import lower_ascii

LETTERS = "[A-Za-zÀ-ÿ]+"
SLIP_ONE_IN = 97
MIN_LETTERS, MIN_COUNT = 5, 3
FORM_TIMES = 2
#: Letters of the words that one Python step emits the deletions of, unless one word is longer.
STEP_LETTERS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def slipped(doc_id: Column, word: Column) -> Column:
    """The word, or what is left of it where the pair's CRC-32 says that a letter is lost."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % SLIP_ONE_IN == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, id: the words that are long and frequent enough, numbered. Cut, so that the numbers stay."""
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("doc"), lower_ascii(F.col("run"))).alias("word")).where(F.length("word") >= min_letters)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return cut(counted.withColumn("id", F.monotonically_increasing_id()))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word and of its distinct deletions, and the word's place in the list; words are not empty."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    firsts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - firsts[of]
    longest = int(sizes.max())
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64))), dtype=np.uint64)
    value = mix(points + np.uint64(1)) * power[place]
    upto = np.cumsum(value, dtype=np.uint64)  # wraps, and so do the differences
    before = upto - value
    start, end = before[firsts], upto[firsts + sizes - 1]
    whole = end - start
    left = before - start[of] + (end[of] - upto) * np.uint64(_INVERSE)
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    length = sizes.astype(np.uint64)
    keys = np.concatenate((mix(whole ^ mix(length)), mix(left ^ mix(length - np.uint64(1))[of])[new]))
    return keys.view(np.int64), np.concatenate((np.arange(len(words)), of[new]))


def _emit(batches):
    for batch in batches:
        words, ids, at = batch.column("word").to_pylist(), batch.column("id").to_numpy(), 0
        sizes = np.cumsum([len(w) for w in words])
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_LETTERS, "right")))
            keys, of = deletion_keys(words[at:to])
            yield pa.record_batch([pa.array(keys), pa.array(ids[at:to][of])], names=["key", "id"])
            at = to


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (structs of word, n, id): the pairs of words at edit distance one, once each."""
    emitted = cut(words.select("word", "id").mapInArrow(_emit, "key long, id long"))
    shared = emitted.toDF("key", "a").join(emitted.toDF("key", "b"), "key").where("a < b").select("a", "b")
    whole = F.struct("word", "n", "id")
    met = shared.join(words.select(F.col("id").alias("a"), whole.alias("x")), "a").join(words.select(F.col("id").alias("b"), whole.alias("y")), "b")
    return met.where(F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _roots(forms: DataFrame) -> DataFrame:
    """id, root of every word that has a form. forms: id, root, where a root may have a form itself."""
    while True:
        further = forms.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        led = cut(forms.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        forms = led.select("id", "root")
        if not led.where("moved").limit(1).count():
            return forms


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, id_col, text_col, min_letters, min_count)
    both = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a.id").alias("id"), F.col("b").alias("other")), F.struct(F.col("b.id").alias("id"), F.col("a").alias("other")))).alias("p"))
    first = F.min(F.struct((-F.col("p.other.n")).alias("n"), F.col("p.other.word").alias("word"), F.col("p.other.id").alias("id"))).alias("first")
    found = both.groupBy(F.col("p.id").alias("id")).agg(F.count("*").alias("n_near"), first)
    enough = -F.col("first.n") >= times * F.col("n")
    led = words.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.struct(F.col("first.word").alias("word"), (-F.col("first.n")).alias("n"), F.col("first.id").alias("id"))).alias("form"))
    led = cut(led)
    roots = _roots(led.where("form IS NOT NULL").select("id", F.col("form.id").alias("root")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return led.join(named, "id", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
