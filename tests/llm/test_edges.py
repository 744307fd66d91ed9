"""Every corpus operator on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftline.llm import cotraining, fingerprints, language_id, line_dedup, minhash_dedup, mixing, packing, quality_rules, substring_dedup, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 9973}x{i % 7919}" for i in range(150_000))
PROSE = "the cat of the house and a dog is in the garden that it was made for " * 8
ROWS = [
    (1, PROSE, "en", "a", 1),
    (1, PROSE, "en", "a", 1),
    (1, "another text under the same id", "en", None, None),
    (None, "a text without an id", None, "a", None),
    (None, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n", "en", "b", 3),
    (5, "one", "de", "b", 3),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (8, "x" * 300_000, None, "c", 300_000),
    (9, "\U0001f6a6 日本語 café <|endoftext|> \x00 tail", "fr", "é", 30),
]
OPERATORS = {
    "op1": lambda df: minhash_dedup.near_duplicate_report(df),
    "op2": lambda df: fingerprints.fingerprint_report(df),
    "op3": lambda df: cotraining.classify(df, df.select("doc_id", F.lit(1).alias("quality"))),
    "op4": lambda df: quality_rules.quality_report(df),
    "op5": lambda df: token_counts.token_report(df),
    "op6": lambda df: suffix_dedup.suffix_report(df),
    "op7": lambda df: mixing.mixture_report(df),
    "op8": lambda df: language_id.identify(df),
    "op9": lambda df: substring_dedup.substring_report(df),
    "op10": lambda df: packing.packed(df),
    "op12": lambda df: line_dedup.line_report(df),
}


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    clashing = "tag bucket part chunk node comp rank place key owner size weight p open base copies hashes chosen next_of label slots spans kept target".split()
    return df.select("*", *(F.lit("clash").alias(c) for c in clashing))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    per_doc = {(r["doc_id"]) for r in rows}
    assert per_doc == {1, 3, 4, 5, 6, 7, 8, 9, None}
    if name == "op10":
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", ["awkward", "none"])
@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages(spark, awkward, rows, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = awkward.select(*corpus_pipeline.COLUMNS, F.lit(1).alias("tag")) if rows == "awkward" else spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, "nowhere")
    assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    kept = out.collect()
    found = Counter(r["doc_id"] for r in kept)
    if rows == "none":
        assert not found
    elif name == "quality_rules":  # the long texts make up the references; the others are too short or say one thing again and again
        assert [tuple(r) for r in sorted(kept, key=lambda r: r["doc_id"])] == [(6, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG))]
    elif name == "minhash_dedup":  # a row of each group, and of a repeated row; one that holds nothing stays
        assert found == {1: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1}
    elif name == "substring_dedup":
        assert found == {1: 3, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    elif name == "packing":
        assert found.keys() == {1, None, 3, 4, 5, 6, 7, 8, 9}


def test_defined_results(awkward):
    near = {(r["doc_id"], r["n_shingles"]): r for r in minhash_dedup.near_duplicate_report(awkward).collect()}
    assert near[(3, 0)]["component_id"] == 3 and near[(3, 0)]["kept"] and near[(5, 1)]["n_shingles"] == 1
    assert {r["component_id"] for r in near.values() if r["doc_id"] in (6, 7)} == {6}
    assert [r["component_id"] for k, r in near.items() if k[0] is None] == [None, None]
    langs = {r["doc_id"]: r for r in language_id.identify(awkward).where("doc_id IN (3, 4)").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in langs.values())
    tokens = {r["doc_id"]: r for r in token_counts.token_report(awkward).where("doc_id IN (3, 7)").collect()}
    assert tokens[3]["n_tokens"] == 0 and not tokens[3]["over_limit"] and tokens[7]["over_limit"]
    bytes_ = {r["doc_id"]: r for r in suffix_dedup.suffix_report(awkward).where("doc_id IN (6, 7, 8)").collect()}
    assert bytes_[7]["n_removed"] == len(LONG) and bytes_[8]["n_removed"] == 299_999 and bytes_[8]["n_spans"] == 1
    words = {r["doc_id"]: r for r in substring_dedup.substring_report(awkward).where("doc_id IN (6, 7)").collect()}
    assert words[6]["n_removed"] == 0 and words[7]["n_removed"] == 150_000
    prints = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprint_report(awkward).collect()}
    assert prints[(3, 0)]["fingerprint"] == "" and prints[(None, 0)]["fingerprint"] == "" and len(prints[(5, 3)]["fingerprint"].split()) == 1
    assert prints[(6, len(LONG))]["fingerprint"] == prints[(7, len(LONG))]["fingerprint"] and prints[(7, len(LONG))]["near_next"] == 1.0
    scores = cotraining.classify(awkward, awkward.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert all((r["text_score"], r["meta_score"], r["quality_score"], r["kept"]) == (0.5, 0.5, 0.5, True) for r in scores)  # labels of one kind only
    rules = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_report(awkward).collect()}
    assert all(rules[k]["base_failed"] and not rules[k]["kept"] for k in ((None, 0), (3, 0), (4, 0), (5, 1), (8, 1)))
    assert not rules[(6, 150_000)]["base_failed"]
    mixed = mixing.mixture_report(awkward).collect()
    assert all(r["taken"] == 0 for r in mixed if r["doc_id"] in (3, 4)) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    nameless = [r["source_size"] for r in mixed if r["doc_id"] == 1 and r["size"] == 6]
    assert nameless == [6]  # the only words without a source; the empty ones beside it weigh nothing
    pieces = [r for r in packing.packed(awkward).collect() if r["doc_id"] in (3, None)]
    assert sorted(r["doc_tokens"] for r in pieces if r["doc_id"] == 3) == [1] and min(r["doc_tokens"] for r in pieces) == 1


def test_ties(spark):
    """Equal texts under two ids, equal sizes and equal scores fall out alike however rows are dealt."""
    rows = [(i, f"{PROSE} {i // 2}", "en", "ab"[i % 2], 1) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in OPERATORS:
        one, other = (sorted(map(tuple, OPERATORS[name](d).collect())) for d in (df.repartition(1), df.repartition(6, "text")))
        assert one == other, name
    near = {r["doc_id"]: r["component_id"] for r in OPERATORS["op1"](df).collect()}
    assert all(near[2 * k] == near[2 * k + 1] for k in range(10))


def test_hot_rows(spark):
    """A third of all rows alike in everything, without id or text or with both."""
    rows = [(None, None, None, None, None)] * 60 + [(5, PROSE, "en", "a", 1)] * 60 + [(i, f"{PROSE} {i}", "en", "b", 1) for i in range(10, 70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in OPERATORS:
        found = Counter(r["doc_id"] for r in OPERATORS[name](df).collect())
        assert found[None] == found[5] == 60 or name == "op10" and found[None] == 60 and found[5] % 60 == 0, name


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from weftline.llm import common

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Session())
