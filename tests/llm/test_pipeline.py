"""The pipeline's stages against plain Python on the driver's smallest table, each on what the one before wrote."""

import re
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_models import base_rules, class_shares, js_distance, water_level
from test_pairs import sets_of
from tokenizers import Tokenizer

from weftline.llm import quality_rules

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(stages):
    before, after = stages[:2]
    words, chars = {}, {}
    for r in before:
        if r["lang"] is not None and r["text"] is not None:
            words.setdefault(r["lang"], Counter()).update(w.lower() for w in words_of(r["text"]))
            chars[r["lang"]] = chars.get(r["lang"], 0) + np.array(class_shares(r["text"])) * len(r["text"])
    classes = {g: c / c.sum() for g, c in chars.items()}
    tops = {g: {w: n / c.total() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality_rules.TOP_WORDS]} for g, c in words.items()}

    def good(text):
        own = Counter(w.lower() for w in words_of(text))
        near_class = min(js_distance(class_shares(text), q) for q in classes.values())
        shares = lambda q: [own[w] / own.total() for w in q]
        near_words = min(js_distance([*shares(q), max(1 - sum(shares(q)), 0)], [*q.values(), 1 - sum(q.values())]) for q in tops.values())
        return (len(text) < quality_rules.CLASS_GUARD_CHARS or near_class <= quality_rules.MAX_CLASS_DISTANCE) and (own.total() < quality_rules.WORD_GUARD_WORDS or near_words <= quality_rules.MAX_WORD_DISTANCE)

    expected = [tuple(r) for r in before if not base_rules(r["text"])[-1] and good(r["text"])]
    assert 0 < len(expected) < len(before) and sorted(map(tuple, after)) == sorted(expected)


def test_near_copies(stages):
    before, after = stages[1:3]
    sets = sets_of([(r["doc_id"], r["text"]) for r in before], 5)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i in sets:
        for j in {j for x in sets[i] for j in holders[x] if j < i}:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    expected = [tuple(r) for r in before if find(r["doc_id"]) == r["doc_id"]]
    assert len(expected) < len(before) and sorted(map(tuple, after)) == sorted(expected)


def test_repeated_passages(stages):
    before, after = stages[2:4]
    seen, expected = set(), []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        w = words_of(r["text"])
        windows = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {j for k, x in enumerate(windows) if x in seen for j in range(k, k + 13)}
        seen.update(windows)
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r["text"]
        expected.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert sorted(map(tuple, after)) == sorted(expected) and sum(len(r["text"]) for r in after) < sum(len(r["text"]) for r in before)


def test_mix(stages):
    before, after = stages[3:5]
    copies = Counter(r["doc_id"] for r in after)
    own = {r["doc_id"]: tuple(r) for r in before}
    assert all(tuple(r) == own[r["doc_id"]] for r in after)
    size = {r["doc_id"]: len(words_of(r["text"])) for r in before}
    by_source = Counter()
    for r in before:
        by_source[r["source"]] += size[r["doc_id"]]
    target = water_level(dict(by_source))
    for source, goal in target.items():
        mine = [r["doc_id"] for r in before if r["source"] == source]
        share = goal / by_source[source]
        assert abs(sum(size[i] * copies[i] for i in mine) - goal) <= max(size[i] for i in mine)
        assert all(np.floor(share) <= copies[i] <= np.ceil(share) for i in mine if size[i])


def test_packing(stages):
    before, after = stages[4:6]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in before}
    copies, starts, sequences = Counter(r["doc_id"] for r in before), Counter(), {}
    for r in after:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        starts[r["doc_id"], r["start"], r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = Counter()
    for (i, _, length), n in starts.items():
        assert n == copies[i]
        total[i] += length
    assert total == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_ids_of_any_type(spark, stages):
    """Integer ids, and columns whose names the stages use themselves, change no stage's rows."""
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stages[k][:60]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        other = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
        for c in ("tag", "owner", "copies", "copy", "at0", "cleaned", "spans", "size", "word", "c", "shard"):
            other = other.withColumn(c, F.lit("clash"))
        expected, found = (sorted(map(tuple, stage(spark, df, DATA).collect())) for df in (docs, other))
        assert expected and expected == found, k


def test_runs_leave_one_folder(spark):
    result = corpus_pipeline.run(spark, DATA)
    folder = next(Path(f.removeprefix("file:")).parent for f in [spark.sparkContext.getCheckpointDir()])
    left = [p for p in folder.rglob("pipeline-*/*") if p.is_dir()]
    assert result.count() > 0 and {p.name for p in left} <= {"3"}
