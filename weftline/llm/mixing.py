"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target number of words is shared out by weight, stopped at
MAX_COPIES times its size, the excess shared again by weight.  Within a source
every document should be copied target / size times.  The whole part is copied
for certain; the fractional parts are rounded in pairs: words move from one
document of a pair to the other, in a random direction that keeps both
expectations, until one of the two is integral.  A chunk of documents leaves at
most one fractional document; those of many chunks meet in further chunks, level
by level, until each source has one, which a last draw rounds.  So a source's
words differ from its target by less than its largest document.

Defined cases: a null text has no words and is taken 0 times over; a null source
is a source, after all others; null ids stay null; repeated rows are drawn each;
ties go by a hash; other columns are ignored; an empty table gives an empty
result.  Reruns draw alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WORD, cut, ranked, tag_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 20_240_601
#: Documents that one task rounds one after another.
FAN_IN = 8192
#: Sources up to which their targets are sent to every task; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, n_docs, source_size, target of each source; sizes: rows with source, size. Cut from its lineage."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_rank = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    sources = cut(ranked(sources, F.col("source").asc_nulls_last()).select("source", "n_docs", "source_size", by_rank.alias("weight"), (max_copies * F.col("source_size")).alias("most")))
    level, before = 0.0, None
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    while total and weight and level != before:  # each turn stops further sources, and ends when none is above
        before, level = level, total / weight
        stopped = F.col("most") <= F.col("weight") * level
        row = sources.agg(F.sum(F.when(stopped, F.col("most")).otherwise(0)).alias("most"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum("source_size").alias("all")).first()
        total, weight = row["all"] - row["most"], row["weight"]
        level = max(level, total / weight) if weight else level
    return sources.select("source", "n_docs", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def _uniform(key: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the rows' keys and the level only."""
    h = key.astype(np.uint64) ^ np.uint64((SEED * 0x9E3779B97F4A7C15 + level * 0xD6E8FEB86659FD93) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded probabilities, and the place of the one that is still fractional, or -1.  Keeps the sum of p * size and each expectation."""
    p, held = p.tolist(), -1
    for i, (s, u) in enumerate(zip(size.tolist(), draw.tolist(), strict=True)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        t = size[held]
        up, down = min((1 - p[held]) * t, p[i] * s), min(p[held] * t, (1 - p[i]) * s)  # words that may move to held, and from it
        moved = up if u * (up + down) < down else -down
        to_held, to_i = p[held] + moved / t, p[i] - moved / s
        p[held], p[i] = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (to_held, to_i))
        held = held if 0.0 < p[held] < 1.0 else i if 0.0 < p[i] < 1.0 else -1
    return np.array(p), held


def _round(level: int, last: bool):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw_key", "doc_id", "size"], kind="stable", ignore_index=True)
        draw = _uniform(rows["draw_key"].to_numpy(), level)
        p, held = pivot(rows["p"].to_numpy(), rows["size"].to_numpy(), draw)
        if held >= 0 and last:
            p[held] = float(_uniform(rows["draw_key"].to_numpy()[held : held + 1], -1)[0] < p[held])
            held = -1
        rows["p"], rows["open"] = p, np.arange(len(rows)) == held
        return rows

    return rounded


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, tag, source, size, source_size, target, copies of every row."""
    key, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sizes = cut(docs.select(key.alias("doc_id"), tag_of(id_col, text_col).alias("tag"), F.xxhash64(tag_of(id_col, text_col)).alias("draw_key"), source.alias("source"), size.alias("size")))
    targets = source_targets(sizes, weights, max_copies)
    n_sources, most = targets.agg(F.count("*"), F.max("n_docs")).first()
    side = targets.withColumnRenamed("source", "of")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(side, sizes["source"].eqNullSafe(F.col("of"))).drop("of").withColumn("base", F.floor(share))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, share - F.col("base")).otherwise(0.0)).withColumn("open", F.lit(True))
    schema = rows.schema
    chunks, level, settled = -(-(most or 1) // FAN_IN), 0, []
    while True:
        last = chunks == 1
        group = F.pmod(F.xxhash64("draw_key", F.lit(level)), F.greatest(F.least(F.lit(chunks), F.ceil(F.col("n_docs") / FAN_IN)), F.lit(1))) if level == 0 else F.pmod(F.xxhash64("draw_key", F.lit(level)), F.lit(chunks))
        done = rows.groupBy(F.col("source"), group.alias("chunk")).applyInPandas(_round(level, last), schema)
        if last:
            settled.append(done)
            break
        done = cut(done)
        settled.append(done.where(~F.col("open")))
        rows, level, chunks = done.where("open"), level + 1, -(-chunks // FAN_IN)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "tag", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mixture_report(docs: DataFrame) -> DataFrame:
    return mixture(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
