"""Quality rules: histograms of a document against language references by Jensen-Shannon distance.

A reference of each language is built from all labelled documents: the shares of
character classes, and the shares of the TOP_WORDS words that the language uses
most (everything else is one bin).  A document's two histograms are compared with
the references of every language, and the nearest counts.  A distance decides
only from a least length on, as short texts scatter.  Before that, base rules
refuse texts of too few words or of mostly repeated word triples.

The verdict is row-local: no shuffle, no Python.  The references are two
aggregates over the corpus; what comes to the driver is a row for each language
and its TOP_WORDS words.

Defined cases: a null text counts as empty, and an empty or blank text fails the
base rules (no words); rows without language or text are in no reference; without
any reference the base rules decide alone; of words that are as frequent the
first in byte order is taken; a null doc_id stays null; repeated rows are judged
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words of a language's reference.
TOP_WORDS = 200
#: Largest distances (0 to 1) that are accepted, and lengths from which they count.
MAX_CLASS_DISTANCE, CLASS_GUARD_CHARS = 0.20, 200
MAX_WORD_DISTANCE, WORD_GUARD_WORDS = 0.55, 100
#: Slots of the table that finds a reference word by its hash.
_SLOTS = 1 << 13

_LOWER, _UPPER, _DIGIT, _BLANK, _POINT = r"[\p{L}&&[^\p{Lu}]]+", r"\p{Lu}+", r"\p{N}+", r"[\x20\x09-\x0D]+", r"[.,;:!?'\"()\-]+"
CLASSES = 6


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _entropy(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _shared(x: Column, y: Column) -> Column:
    """Of two shares, what their mean takes off the sum of their entropies."""
    return F.when(x + y > 0, (x + y) * F.log2((x + y) / 2)).otherwise(0.0)


def _plain(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def _distance(twice: Column) -> Column:
    """From twice the Jensen-Shannon divergence, to base 2: the sum over all bins of the two entropies less what is shared."""
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def class_counts(text: Column) -> Column:
    """Characters of a text by class: lower-case letters, blanks, capitals, points, digits, anything else."""

    def strip(rest, patterns, lengths):
        lengths = [*lengths, F.length(rest)]
        if not patterns:
            return F.array(*lengths)
        return let(_removed(rest, patterns[0]), lambda left: strip(left, patterns[1:], lengths))

    rests = strip(text, [_LOWER, _BLANK, _UPPER, _POINT, _DIGIT], [])
    return let(rests, lambda r: F.transform(r, lambda x, i: x - F.coalesce(F.get(r, i + 1), F.lit(0))))


@dataclass(frozen=True)
class References:
    """By language: shares of the character classes, and shares of its most frequent words."""

    classes: dict[str, list[float]]
    words: dict[str, dict[str, float]]


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP_WORDS) -> References:
    """The references of all languages that documents are labelled with."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.select("lang", class_counts(F.col("text")).alias("c"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    sums = counted.groupBy("lang").agg(F.sum("n").alias("n_words"), *(F.sum(F.get("c", i)).alias(f"c{i}") for i in range(CLASSES))).collect()
    words = rows.select("lang", F.explode(F.split(F.lower("text"), _BLANK)).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    frequent = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).collect()
    n_words = {r["lang"]: r["n_words"] for r in sums}
    chars = {r["lang"]: [r[f"c{i}"] for i in range(CLASSES)] for r in sums}
    found: dict[str, dict[str, float]] = {lang: {} for lang in sorted(n_words) if n_words[lang]}
    for r in sorted(frequent, key=lambda r: (r["lang"], r["rank"])):
        found[r["lang"]][r["word"]] = r["count"] / n_words[r["lang"]]
    return References({lang: [c / sum(chars[lang]) for c in chars[lang]] for lang in found}, found)


def class_distance(text: Column, refs: References) -> Column:
    """Distance of a text's character classes from the nearest language; 0 for an empty text, or without references."""
    if not refs.classes:
        return F.lit(0.0)
    listed = list(refs.classes.values())
    every, entropies = _constant([x for q in listed for x in q], "double"), _constant([sum(map(_plain, q)) for q in listed], "double")
    shares = let(class_counts(text), lambda c: let(F.greatest(_total(c), F.lit(1.0)), lambda n: F.transform(c, lambda x: x / n)))

    def one(p, own, lang):
        """The distance from a language, by its number."""
        return _distance(own + F.get(entropies, lang) - _total(F.transform(p, lambda x, i: _shared(x, F.get(every, lang * CLASSES + i)))))

    numbers = F.sequence(F.lit(0), F.lit(len(listed) - 1))
    nearest = let(shares, lambda p: let(_total(F.transform(p, _entropy)), lambda own: F.array_min(F.transform(numbers, lambda lang: one(p, own, lang)))))
    return F.when(F.length(text) > 0, nearest).otherwise(0.0)


def _constant(values, kind: str) -> Column:
    """A list of numbers or words as a literal array, folded once."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def word_distance(words: Column, refs: References) -> Column:
    """Distance of a text's words from the frequent ones of the nearest language; words: array of lower-case words; 1 without words.

    Reference words are numbered; a word's number is found by its hash, and words
    that share a slot stand next to each other.  One table leads from a word's
    number to the languages that have it, with their shares.  Only reference words that
    the text has are gone through, once for each of their languages: their terms
    are sorted by language and added up in one pass.  A word that the text lacks adds
    its share alone; of the languages of which the text has no word the nearest is
    known beforehand.  So the plan is one and the same for any number of languages."""
    if not refs.words:
        return F.lit(0.0)
    known = sorted({w for q in refs.words.values() for w in q})
    n_slots = max(_SLOTS, 1 << (4 * len(known)).bit_length())
    slots: dict[int, list[str]] = {}
    for w in known:
        slots.setdefault(xxhash.xxh64_intdigest(w.encode(), seed=42) % n_slots, []).append(w)  # as xxhash64 has it
    known = [w for own in slots.values() for w in own]
    begins = dict(zip(slots, itertools.accumulate(map(len, slots.values()), initial=0), strict=False))
    listed, first = _constant(known, "string"), _constant([begins.get(s, -1) for s in range(n_slots)], "int")
    deepest = max(map(len, slots.values()))

    langs = list(refs.words.values())
    of_word = [[(k, q[w]) for k, q in enumerate(langs) if w in q] for w in known]
    starts = _constant(list(itertools.accumulate(map(len, of_word), initial=0)), "int")
    owners, shares = (_constant([x[i] for own in of_word for x in own], kind) for i, kind in ((0, "int"), (1, "double")))
    alone = _constant([_plain(q) - q for own in of_word for _, q in own], "double")
    sums = [sum(q.values()) for q in langs]
    others = [max(1 - x, 0.0) for x in sums]
    total, other, other_entropy = (_constant(x, "double") for x in (sums, others, list(map(_plain, others))))
    without = [math.sqrt(max(0.0, (x + _plain(o) - (1 + o) * math.log2((1 + o) / 2)) / 2)) for x, o in zip(sums, others, strict=True)]
    by_distance, distances = _constant(sorted(range(len(langs)), key=lambda k: without[k]), "int"), _constant(without, "double")

    def number(w):
        at = lambda s: F.coalesce(*(F.when(F.get(listed, s + k) == w, s + k) for k in range(deepest)))
        return let(F.get(first, F.pmod(F.xxhash64(w), F.lit(n_slots)).cast("int")), at)

    def ends(ordered):
        return F.filter(F.transform(ordered, lambda x, i: F.when(x != F.coalesce(F.get(ordered, i + 1), F.lit("")), i + 1)), lambda i: i.isNotNull())

    def run(s, e, n):
        """The run that ends with each of the places e in the sorted words s."""
        part = F.transform(e, lambda x, i: F.struct(F.get(s, x - 1).alias("word"), ((x - F.coalesce(F.get(e, i - 1), F.lit(0))) / n).alias("share")))
        return F.transform(part, lambda x: F.struct(number(x.word).alias("number"), x.share.alias("share"), _entropy(x.share).alias("entropy")))

    def terms(x):
        """What a reference word of the text adds for each language that has it."""

        def term(j):
            q = F.get(shares, j)
            return F.struct(F.get(owners, j).alias("lang"), (x.entropy + F.get(alone, j) - (x.share + q) * F.log2((x.share + q) / 2)).alias("added"), x.share.alias("taken"))

        return F.transform(F.sequence(F.get(starts, x.number), F.get(starts, x.number + 1) - 1), term)

    def distance(s):
        """Of the language that a state has added up; further than any before there was one."""
        rest = F.greatest(1 - s.taken, F.lit(0.0))
        whole = F.get(total, s.lang) + s.added + let(rest, lambda r: _entropy(r) + F.get(other_entropy, s.lang) - _shared(r, F.get(other, s.lang)))
        return F.when(s.lang < 0, F.lit(2.0)).otherwise(_distance(whole))

    def state(lang, added, taken, best):
        return F.struct(lang.alias("lang"), added.alias("added"), taken.alias("taken"), best.alias("best"))

    def step(s, x):
        same = state(s.lang, s.added + x.added, s.taken + x.taken, s.best)
        return F.when(s.lang == x.lang, same).otherwise(state(x.lang, x.added, x.taken, F.least(s.best, distance(s))))

    def nearest(ordered):
        start = state(F.lit(-1), F.lit(0.0), F.lit(0.0), F.lit(2.0))
        met = F.aggregate(ordered, start, step, lambda s: F.least(s.best, distance(s)))
        unmet = F.get(distances, F.get(F.array_except(by_distance, F.transform(ordered, lambda x: x.lang)), 0))
        return F.least(met, unmet)  # null if every language was met

    frequent = F.sort_array(F.filter(words, lambda w: w.isin(known)))
    counted = let(frequent, lambda s: let(ends(s), lambda e: run(s, e, F.size(words))))
    every = let(counted, lambda r: F.sort_array(F.flatten(F.transform(r, terms))))
    return F.when(F.size(words) > 0, let(every, nearest)).otherwise(1.0)


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more in the array."""
    high = F.lit(-(1 << 32))

    def beside(array, same):
        """Elements equal to the one before or after, in a sorted array."""
        return F.filter(array, lambda x, i: F.coalesce(same(x, F.get(array, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(array, i + 1)), F.lit(False)))

    def covered(places):
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)

    def exactly(hashes, maybe):
        """Of the places whose windows may be equal, those whose whole hashes are."""
        pairs = F.sort_array(F.transform(maybe, lambda x: F.struct(F.get(hashes, x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("h"), x.bitwiseAND(F.lit((1 << 31) - 1)).alias("p"))))
        return let(let(pairs, lambda s: beside(s, lambda x, y: x.h == y.h)), lambda s: let(F.sort_array(F.transform(s, lambda x: x.p)), covered))

    def of(hashes):
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        maybe = let(packed, lambda s: beside(s, lambda x, y: x.bitwiseAND(high) == y.bitwiseAND(high)))
        return let(maybe, lambda m: F.when(F.size(m) > 0, exactly(hashes, m)).otherwise(F.lit(0).cast("long")))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), of(h)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) >= 4, let(hashes, some)).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept; refs: of these documents, if not given."""
    refs = references(docs, lang_col, text_col) if refs is None else refs
    return docs.select(F.col(id_col).alias("doc_id"), judgement(F.col(text_col), refs).alias("j")).select("doc_id", "j.*")


def judgement(text_col: Column, refs: References) -> Column:
    """The verdict on one text with all that it rests on, as a struct."""
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))

    def measured(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.length(text).alias("n_chars"),
            class_distance(text, refs).alias("class_distance"),
            let(F.transform(words, F.lower), lambda w: word_distance(w, refs)).alias("word_distance"),
        )

    def judged(m):
        failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
        near = ((m.n_chars < CLASS_GUARD_CHARS) | (m.class_distance <= MAX_CLASS_DISTANCE)) & ((m.n_words < WORD_GUARD_WORDS) | (m.word_distance <= MAX_WORD_DISTANCE))
        fields = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*fields, failed.alias("base_failed"), m.class_distance.alias("class_distance"), m.word_distance.alias("word_distance"), (~failed & near).alias("kept"))

    return let(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), measured), judged)


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_report(docs: DataFrame) -> DataFrame:
    return quality(docs).select(*REPORT)
