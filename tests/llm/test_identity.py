"""Rows without an id are told apart by 128 bits; none is lost or taken for another."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints, minhash_dedup, mixing, substring_dedup, suffix_dedup
from weftline.llm.common import tag_of

N = 400_000


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(N).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("record number "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))


@pytest.fixture(scope="module")
def alike(spark, texts):
    """Pairs of these texts with one 32-bit hash, and as many others, as documents of many words."""
    pairs = texts.groupBy(F.hash("doc_id", "text")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).orderBy("t").limit(5).collect()
    rows = [t for r in pairs for t in r["t"]]
    assert len(rows) >= 10 and all(len({*r["t"]}) == len(r["t"]) for r in pairs)
    rows += [f"another text {hashlib.sha256(str(k).encode()).hexdigest()}" for k in range(len(rows))]
    return spark.createDataFrame([(None, t, "en", "a", len(t)) for t in rows], "doc_id long, text string, lang string, source string, n_chars long"), sorted(rows)


def test_tags_differ(texts):
    assert texts.select(F.hash("doc_id", "text").alias("h")).distinct().count() < N
    assert texts.select(tag_of().alias("t")).distinct().count() == N


def test_nothing_is_lost(spark, alike):
    docs, rows = alike
    assert sorted(r["text"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == rows
    assert sorted(r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()) == rows
    mixed = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert set(mixed) == set(rows)
    assert minhash_dedup.near_duplicates(docs).where("stays").count() == len(rows) == mixing.mixture(docs).count()


def test_nothing_is_mixed_up(alike):
    docs, rows = alike
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for report in (substring_dedup.substring_report, suffix_dedup.suffix_report):
        assert sorted(r["kept_sha256"] for r in report(docs).collect()) == sorted(map(digest, rows))
    prints = {r["text"]: fingerprints.as_string for r in docs.collect()}
    want = {r["text"]: r["p"] for r in docs.select("text", fingerprints.as_string(F.transform(fingerprints.winnowed(F.col("text")), lambda x: x.hash)).alias("p")).collect()}
    assert len(prints) == len(rows) and sorted(r["fingerprint"] for r in fingerprints.fingerprint_report(docs).collect()) == sorted(want.values())


def test_many_rows_without_an_id(texts):
    """All of them through the operators that look their texts up again."""
    assert minhash_dedup.near_duplicates(texts).where("stays").select("tag").distinct().count() == N
    assert substring_dedup.removal_spans(texts).select("cleaned").distinct().count() == N
