"""Spelling variants, line dedup and hard negatives against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives, line_dedup, spelling

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string"


# Spelling variants.


def spelled(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(others)]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], words[form[w]] if form[w] else None)
    return sorted(out.values())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéßxÀ÷") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randrange(1, 40)])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxÿ") + w[k:], w[:k] + rng.choice("abcxÿ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i if i % 11 else None, rng.choice([" ", ", ", "\n"]).join(words), "en"))
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "1234 ?! ", "en"), (5, docs[5][1], "en"), (5, docs[5][1], "en")]
    docs += [(k, "y" * 50_000 + " " + "y" * 49_999, "en") for k in (2001, 2002, 2003)]
    return docs


def test_variants(spark, prose):
    df = spark.createDataFrame(prose, DOCS).select("*", *(F.lit("clash").alias(c) for c in ("word", "n", "id", "key", "form", "root", "run", "doc")))
    found = spelling.variants(df.repartition(5))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = sorted(map(tuple, found.collect())), spelled(prose)
    assert got == want
    assert any(r[2] != r[0] for r in got) and any("y" * 49_990 in r[0] for r in got) and any(r[4] > 3 for r in got)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "a bc def", "en"), (None, None, None)], DOCS)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_deletion_keys(seed):
    """Two words share a key just where they share a string among themselves and their single deletions."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aab\U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    keys, of = spelling.deletion_keys(words)
    own = defaultdict(list)
    for k, i in zip(keys.tolist(), of.tolist(), strict=True):
        own[i].append(k)
    texts = [{w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for w in words]
    assert all(len(own[i]) == len({*own[i]}) == len(texts[i]) for i in range(len(words)))
    assert all(len({*own[i]} & {*own[j]}) == len(texts[i] & texts[j]) for i in range(len(words)) for j in range(i))


def test_chains_lead_to_roots(spark):
    """A chain of forty steps, each form twice as frequent."""
    forms = spark.createDataFrame([(i, i + 1) for i in range(40)], "id long, root long")
    assert {(r["id"], r["root"]) for r in spelling._roots(forms).collect()} == {(i, 40) for i in range(40)}


# Line dedup.


def cleaned(docs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    lines = [(d, (t or "").split("\n")) for d, t, *_ in docs]
    held = Counter(k for _, own in lines for k in {*map(key, own)} if k)
    out = []
    for d, own in lines:
        kept = [x for x in own if held[key(x)] < least]
        out.append((d is None, d or 0, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(8)
    common = [f"Footer {k} É line" for k in range(12)]
    docs = []
    for i in range(240):
        own = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(6))]
        own += [rng.choice(["", " ", "\t"]) + rng.choice([c, c.upper(), c.lower()]) + rng.choice(["", "\r", " \x0b"]) for c in rng.sample(common, rng.randrange(5)) if rng.random() < 0.4]
        own += ["hot line"] * rng.randrange(3)
        rng.shuffle(own)
        docs.append((rng.choice([i, i // 3, None]), "\n".join(own), "en"))
    return [*docs, (900, None, "en"), (901, "", "en"), (902, "\n\n \n", "en"), (903, "\n".join(f"long {k}" for k in range(30_000)) + "\nhot line", "en"), (904, "x ", "en")]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, lined, batches):
    df = spark.createDataFrame(lined, DOCS).select("*", *(F.lit("clash").alias(c) for c in ("h", "n", "tag", "owner", "batch", "keys", "lines", "at", "lost", "dropped")))
    found = line_dedup.cleaned_lines(df, batches=batches)
    rows = found.select("doc_id", "n_lines", F.size("dropped").alias("n"), F.sha2("cleaned", 256).alias("s")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n"], r["s"]) for r in rows) == cleaned(lined)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_runs_are_levelled(spark):
    """Whatever batches and compactions there are, the same keys come out; keys with a verdict aren't stored again, and levels hold fewer runs than are merged."""
    rng = random.Random(1)
    docs = [[rng.randrange(60) for _ in range(8)] for _ in range(90)]
    want = {k for k, n in Counter(k for d in docs for k in {*d}).items() if n >= 10}
    frame = spark.createDataFrame([(i, [None, *d]) for i, d in enumerate(docs)], "i int, k array<int>").select("i", F.transform("k", lambda x: F.unhex(F.md5(x.cast("string")))).alias("keys"))
    names = {bytes.fromhex(hashlib.md5(str(k).encode()).hexdigest()): k for k in range(60)}
    for n, fan_in in ((1, 2), (5, 2), (9, 3)):
        runs = line_dedup.LineRuns(spark, 10, fan_in, 3)
        for b in range(n):
            runs.add(frame.where(F.col("i") % n == b))
            assert all(len(level) < fan_in for level in runs.levels)
            settled = [{r["h"] for r in run.where("n >= 10").collect()} for run in runs.runs()]
            assert sum(map(len, settled)) >= len(set().union(*settled))
        assert {names[bytes(r["h"])] for r in runs.frequent().collect()} == want
        stored = [run.groupBy("h").count().where("count > 1").count() for run in runs.runs()]
        assert not any(stored)
        runs.close()


def test_a_settled_key_is_not_stored_again(spark):
    runs = line_dedup.LineRuns(spark, 2, 3, 2)
    keys = lambda *ks: spark.createDataFrame([([k.encode()],) for k in ks], "keys array<binary>")
    runs.add(keys("a", "a", "b"))
    runs.add(keys("a", "b", "c"))
    first, second = runs.runs()
    assert {(bytes(r["h"]), r["n"]) for r in first.collect()} == {(b"a", 2), (b"b", 1)} and {(bytes(r["h"]), r["n"]) for r in second.collect()} == {(b"b", 1), (b"c", 1)}
    assert {bytes(r["h"]) for r in runs.frequent().collect()} == {b"a", b"b"}
    runs.close()


# Hard negatives.


def mined(rows, every=10, positives=5, negatives=10):
    good = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [math.floor(256 * x) for x in vec]
        if sum(float(x) * x for x in q) < 1 << 56:
            good[vec_id] = min(good.get(vec_id, (label, q)), (label, q))
    score = lambda a, b: sum(x * y for x, y in zip(good[a][1], good[b][1], strict=False))
    out = []
    for a in good:
        if a % every:
            continue
        order = sorted((-score(a, b), b) for b in good if b != a)
        for s, p in [x for x in order if good[x[1]][0] == good[a][0]][:positives]:
            inside = [x for x in order if good[x[1]][0] != good[a][0] and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, 6))
    return [(i, [float(x) for x in middle[i % 4] * 0.4 + rng.normal(size=6) * spread], int(i % 3)) for i in range(n)]


EMBEDDINGS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("case", ["plain", "ties", "awkward", "large numbers"])
def test_negatives(spark, monkeypatch, case):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK_BYTES", 600)  # many blocks
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK_BYTES", 100)
    rows = vectors(4, 160)
    if case == "ties":  # one vector in a third of all rows, in every label
        rows += [(i, rows[0][1], i % 3) for i in range(200, 300)] + [(i, [0.0] * 6, 1) for i in range(300, 310)]
    elif case == "awkward":
        rows += [(None, [1.0] * 6, 1), (401, None, 1), (402, [1.0, None], 1), (403, [math.nan] * 6, 1), (404, [math.inf] * 6, 2), (405, [1.0] * 6, None), (410, [], 1), (420, [0.5, 0.5], 2), (20, [0.0] * 6, 2), (430, [1e300] * 6, 0)]
    elif case == "large numbers":
        rows = [(i, [x * 2e5 for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, EMBEDDINGS).select("*", *(F.lit("clash").alias(c) for c in ("id", "q", "squares", "block", "anchor", "lo", "hi")))
    found = hard_negatives.hard_negatives(df.repartition(3), anchor_every=10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_no_vectors(spark):
    assert hard_negatives.negatives_report(spark.createDataFrame([], EMBEDDINGS)).collect() == []
    assert hard_negatives.negatives_report(spark.createDataFrame([(100, [1.0], 1)], EMBEDDINGS)).collect() == []


def test_labels_move_on(spark):
    df = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)], EMBEDDINGS)
    assert [r["label"] for r in hard_negatives.relabelled(df).orderBy("vec_id").collect()] == [0, 9, None]


def test_a_window_narrows_digit_by_digit(spark):
    """The range closes in on the k-th score; what is above is counted, and a window of fewer rows is left as it is."""
    windows = spark.createDataFrame([(1, 0, 0, 6399, 6399, 10, 0), (2, 0, 0, 6399, 6399, 10, 0)], "anchor long, positive long, lo long, hi long, top long, need long, above long")
    counts = [0] * 64
    counts[3], counts[5] = 4, 500
    rows = {r["anchor"]: r for r in hard_negatives._narrowed(windows, spark.createDataFrame([(1, 0, counts), (2, 0, [1] * 7 + [0] * 57)], "anchor long, positive long, counts array<int>"), 10).collect()}
    assert (rows[1]["hi"], rows[1]["lo"], rows[1]["need"], rows[1]["above"], rows[1]["done"]) == (6399 - 500, 6399 - 599, 6, 4, False)
    assert (rows[2]["hi"], rows[2]["lo"], rows[2]["done"]) == (6399, 0, True)
