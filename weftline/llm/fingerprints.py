"""Document fingerprints by winnowing, in DataFrame functions only.

Every GRAM consecutive code points get a polynomial hash modulo PRIME, rolled up by
doubling: from one code point's value to that of two in a row, four, and eight.
Of every WINDOW consecutive hashes the least is chosen, the rightmost one on ties,
and its position kept.
Two texts that share GRAM + WINDOW - 1 code points in a row share a fingerprint.
A text with fewer hashes than a window is one window; a text shorter than a gram
is one gram (missing code points count as 0).  Likeness of two fingerprints is the Jaccard similarity of their
hashes, 1 for equal ones.

Defined cases: a null text counts as empty and has the empty fingerprint; null
ids come after all others in descending order, rows of one id by a hash of
their text; repeated rows stand next to each other and count each; other
columns are ignored; an empty table gives an empty result, and a single
document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, cut, ranked, tag_of

#: A power of two.
GRAM = 8
#: The window is the product of these steps.
STEPS = (3, 4, 4)
WINDOW = 48
#: Code points of a window: grams and windows that start so far before a place don't reach it.
LEAD = GRAM + WINDOW - 1
PRIME = (1 << 31) - 1
BASE = 1_000_003

_PLACES = 1 << 31


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def _rolled(values: Column, span: int = 1) -> Column:
    """Hashes of GRAM code points from those of `span`, each with its position counted down in the low half; the last GRAM - 1 values only fill grams up."""
    factor = F.lit(pow(BASE, span, PRIME))
    if 2 * span < GRAM:
        wider = F.zip_with(values, F.slice(values, span + 1, F.greatest(F.size(values) - span, F.lit(0))), lambda x, y: (x * factor + y) % F.lit(PRIME))
        return let(wider, lambda v: _rolled(v, 2 * span))
    grams = F.slice(values, 1, F.greatest(F.size(values) - 2 * (GRAM - 1), F.lit(1)))
    return F.transform(grams, lambda x, i: (x * factor + F.get(values, i + span)) % F.lit(PRIME) * F.lit(_PLACES) + (F.lit(_PLACES - 1) - i))


def chosen(text: Column) -> Column:
    """The chosen grams of a non-null text, by position: 62-bit numbers of hash (high half) and position counted down (low half)."""
    points = F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("long"))
    packed = let(F.concat(points, F.array_repeat(F.lit(0).cast("long"), GRAM - 1)), lambda p: _rolled(p))

    def least(hashes, span, steps):
        """The least of each WINDOW hashes: the least of spans, of spans of spans, and so on."""
        if not steps:
            return hashes
        wider = F.transform(hashes, lambda x, i: F.least(x, *(F.get(hashes, i + span * s) for s in range(1, steps[0]))))
        return let(wider, lambda w: least(w, span * steps[0], steps[1:]))

    def windows(p):
        n = F.size(p) - WINDOW + 1
        every = let(least(p, 1, STEPS), lambda m: F.array_distinct(F.slice(m, 1, F.greatest(n, F.lit(1)))))  # a gram is the least of windows in a row
        return F.when(n > 1, every).otherwise(F.array(F.array_min(p)))

    none = F.array().cast("array<bigint>")
    return F.when(F.length(text) == 0, none).otherwise(let(packed, windows))


def hash_of(x: Column) -> Column:
    return F.shiftright(x, 31).cast("int")


def position_of(x: Column) -> Column:
    return F.lit(_PLACES - 1) - x.bitwiseAND(F.lit(_PLACES - 1))


def winnowed(text: Column) -> Column:
    """The fingerprint of a text: array of struct hash (int), pos (long, from 0)."""
    return F.transform(chosen(F.coalesce(text.cast("string"), F.lit(""))), lambda x: F.struct(hash_of(x).alias("hash"), position_of(x).alias("pos")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.hex(h.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), " ")


def successors(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Each row's successor in descending doc_id, the first one after the last; and whether rows repeat.

    docs: of, tag, n_chars.  Returns of, tag, n_chars, place, next_of, next_tag."""
    order = [F.when(F.col("of") == NO_ID, None).otherwise(F.col("of")).desc_nulls_last(), F.col("tag")]
    rows = cut(ranked(docs, *order, name="place"))
    n = rows.count()
    repeated = rows.groupBy("of", "tag").count().where("count > 1").limit(1).count() > 0
    after = rows.select(F.col("of").alias("next_of"), F.col("tag").alias("next_tag"), F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"))
    return cut(rows.join(after, "place")), repeated


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of the text whose last third gives way to the beginning of the next document.

    doc_id, n_chars, edited, hashes, edited_hashes, next_hashes (arrays of int).

    A text's fingerprint is made once.  All windows around a gram that starts LEAD or
    more code points before the end of what is kept are the text's own; all those
    around a gram from the WINDOW-th on, and as far from the end of what is put on,
    are the next document's.  So both are taken from there, and only what stands
    around the seam and at the end is made anew."""
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.coalesce(key, F.lit(int(NO_ID))).alias("of"), tag_of(id_col, text_col).alias("tag"), whole.alias("text"))
    steps, repeated = successors(rows.select("of", "tag", F.length("text").alias("n_chars")))

    made = rows.select("of", "tag", "text", chosen(F.col("text")).alias("chosen"))
    made = made.select("of", "tag", "text", F.transform("chosen", hash_of).alias("hashes"), F.transform("chosen", lambda x: position_of(x).cast("int")).alias("places"))
    if repeated:
        made = made.dropDuplicates(["of", "tag"])

    ask = steps.select(F.col("next_of").alias("of"), F.col("next_tag").alias("tag"), F.col("of").alias("to_of"), F.col("tag").alias("to_tag"), "place", F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    head = F.expr("substring(text, 1, take)")
    met = made.join(ask, ["of", "tag"]).select(F.col("to_of").alias("of"), F.col("to_tag").alias("tag"), "place", head.alias("head"), F.col("hashes").alias("next_hashes"), "places")
    put = F.length("head")
    inside = _between(F.col("next_hashes"), F.col("places"), F.lit(WINDOW - 1), put - LEAD)
    given = met.select("of", "tag", "place", "head", "next_hashes", inside.alias("inside"))
    both = made.join(given, ["of", "tag"])

    kept = (F.length("text") - F.floor(F.length("text") / 3)).cast("int")
    own = _between(F.col("hashes"), F.col("places"), F.lit(0), kept - LEAD)
    both = both.select("of", "hashes", "next_hashes", "inside", own.alias("own"), F.length("text").cast("long").alias("n_chars"), kept.alias("kept"), put.alias("put"), F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited"))
    # the first and last gram that are made anew at the seam, and the first one at the end; in one stretch, if what is put on is short
    seam, end = F.col("kept") - LEAD + 1, F.col("kept") + F.greatest(F.col("put") - LEAD + 1, F.lit(WINDOW - 1))
    seam_stop = F.when(F.col("put") - LEAD >= WINDOW - 1, F.col("kept") + (WINDOW - 2)).otherwise(F.col("kept") + F.col("put"))
    anew = _made_anew(F.col("edited"), seam, seam_stop)
    last = F.when(F.col("put") - LEAD >= WINDOW - 1, _made_anew(F.col("edited"), end, F.length("edited"))).otherwise(F.array().cast("array<int>"))
    edited_hashes = F.concat("own", anew, "inside", last)
    doc_id = F.when(F.col("of") != NO_ID, F.col("of"))
    return both.select(doc_id.alias("doc_id"), "n_chars", "edited", "hashes", edited_hashes.alias("edited_hashes"), "next_hashes")


def _between(hashes: Column, places: Column, low: Column, high: Column) -> Column:
    """The hashes of a fingerprint whose positions are from low to high, both included."""
    bounds = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    ends = let(bounds, lambda b: F.struct(F.size(F.filter(places, lambda p: p < b.low)).alias("before"), F.size(F.filter(places, lambda p: p <= b.high)).alias("upto")))
    return let(ends, lambda e: F.slice(hashes, e.before + 1, F.greatest(e.upto - e.before, F.lit(0))))


def _made_anew(text: Column, low: Column, high: Column) -> Column:
    """Hashes chosen from the grams at low to high, from as much of the text as their windows cover."""
    bounds = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.greatest(low - (WINDOW - 1), F.lit(0)).cast("int").alias("start"))
    part = let(bounds, lambda b: F.struct(F.substring(text, b.start + 1, b.high - b.start + LEAD + 1).alias("text"), (b.low - b.start).alias("low"), (b.high - b.start).alias("high")))
    return let(part, lambda x: F.transform(F.filter(chosen(x.text), lambda g: (position_of(g) >= x.low) & (position_of(g) <= x.high)), hash_of))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    found = edited_fingerprints(docs)
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("hashes")).alias("fingerprint"),
        as_string(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
