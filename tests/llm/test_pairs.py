"""Near duplicates, fingerprints and repeated substrings against plain Python."""

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints, first_owner, minhash_dedup, substring_dedup, suffix_dedup
from weftline.llm.bucket_pointers import bucket_pointers
from weftline.llm.common import TAG, word_hashes
from weftline.llm.components import connected


def words(rng, n, vocabulary=400):
    return [f"word{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies of a few bases with random deletions, so that similarities lie on both sides of the threshold; passages; loners."""
    rng, docs = random.Random(5), []
    passage = words(rng, 40)
    for base in (words(rng, 150) for _ in range(3)):
        docs.append(base)
        for _ in range(40):
            rate = rng.choice([0.0, 0.01, 0.02, 0.04, 0.08])
            docs.append([w.upper() if rng.random() < 0.05 else w for w in base if rng.random() > rate])
    docs += [words(rng, 60) + passage + words(rng, rng.randrange(60)) for _ in range(30)]
    docs += [words(rng, rng.randrange(6)) for _ in range(20)]
    rng.shuffle(docs)
    return [(i, rng.choice([" ", "\n", "  "]).join(d)) for i, d in enumerate(docs)]


def sets_of(corpus, width):
    out = {}
    for i, text in corpus:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, corpus, width):
    sets = sets_of(corpus, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    found = minhash_dedup.near_duplicate_report(spark.createDataFrame(corpus, "doc_id long, text string"), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert len({find(i) for i in sets}) < len(sets)


def test_exact_join_of_the_rest_needs_no_leaders(spark, corpus):
    """Without any merging before, the prefix join finds every similar pair."""
    sets = sets_of(corpus, 5)
    nodes = [i for i, s in sets.items() if s]
    held = minhash_dedup._sets(5)
    df = spark.createDataFrame([(i, t) for i, t in corpus if sets[i]], "node long, text string")
    packed = df.mapInArrow(held, "node long, set binary")
    members = spark.createDataFrame([(1, i, len(sets[i]), i) for i in nodes], "bucket long, node long, size long, comp long")
    none = spark.createDataFrame([], "node long, leader long, linked boolean")
    pairs = {(r["leader"], r["node"]) for r in minhash_dedup._prefix_pairs(members, packed, none, 80).collect()}
    similar = {(b, a) for a in nodes for b in nodes if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar <= pairs and len(pairs) < len(nodes) * (len(nodes) - 1) / 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = base[:1000], base[200:]
    s = minhash_dedup.signatures([a, b], 216)
    assert (s[0] == s[1]).mean() == pytest.approx(800 / 1200, abs=0.12)
    assert (minhash_dedup.signatures([a], 216)[0] == s[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(1, 41), 100]} | {201: 200, 202: 200}


def test_repeated_windows(spark, corpus):
    docs = [(i, t) for i, t in corpus] + [(1000, " ".join(["again"] * 40)), (1001, " ".join(["again"] * 13)), (1002, None)]
    owner = {}
    for i, t in sorted(docs):
        w = (t or "").split()
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), i)
    found = {r["doc_id"]: r for r in substring_dedup.substring_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 12) if owner[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert found[1000]["n_removed"] == 0 and found[1001]["n_removed"] == 13


def test_repeated_bytes(spark, corpus):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))  # longer than a block
    docs = [*corpus, (500, long), (501, long[500_000:600_050] + "!" + long[1_100_000:]), (502, "ab" * 400), (503, None), (504, "é" * 120)]
    seen, expected = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        expected[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    found = suffix_dedup.suffix_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == expected


def winnow(text):
    """Hash and position of the chosen grams, gram by gram and window by window."""
    points = [ord(c) for c in text]
    hashes = []
    for k in range(max(len(points) - 7, 1) if points else 0):
        h = 0
        for j in range(8):
            h = (h * 1_000_003 + (points[k + j] if k + j < len(points) else 0)) % (2**31 - 1)
        hashes.append(h)
    out = []
    for k in range(max(len(hashes) - 47, 1) if hashes else 0):
        window = hashes[k : k + 48]
        at = k + max(j for j, v in enumerate(window) if v == min(window))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


EMOJI = "\U0001f6a6 signal \U0001f600\U0001f601 é 日本 " * 9


def test_winnowing_by_hand(spark, corpus):
    texts = [*(t for _, t in corpus[:40]), "short", "", "a" * 200, "\U0001f6a6" * 30 + "tail of the text", EMOJI, EMOJI[::-1], "\U0001f6a6", "x" * 55]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fingerprints.winnowed(F.col("text")).alias("found")).collect()
    for r in rows:
        assert [(x["hash"], x["pos"]) for x in r["found"]] == winnow(r["text"]), r["text"]
        assert all(x["pos"] < max(len(r["text"]), 1) for x in r["found"])


def test_edited_texts(spark, corpus):
    docs = [*corpus, (950, "tiny"), (951, ""), (952, None), (953, "x" * 55), (954, "y" * 90), (955, EMOJI), (956, "a" + EMOJI), (957, EMOJI * 3), (958, EMOJI * 3), (959, "")]
    ordered = sorted(docs, reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(found) == len(docs)
    for k, (i, t) in enumerate(ordered):
        text, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, new, following = ([h for h, _ in winnow(x)] for x in (text, edited, after))
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == " ".join(f"{h:X}" for h in own) and r["edited_fingerprint"] == " ".join(f"{h:X}" for h in new), i
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(alike(own, new)), pytest.approx(alike(own, following)))


def turned(n, flip):
    """n bytes of two letters in an order that polynomials modulo a power of two don't tell from its opposite."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, n):
    word, other = turned(n, 0), turned(n, 1)
    docs = [(k, " ".join([f"w{j}" for j in range(6)] + [w] + [f"v{j}" for j in range(6)])) for k, w in enumerate([word, other])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.substring_report(df).collect()] == [0, 0]
    assert {r["component_id"] for r in minhash_dedup.near_duplicate_report(df, 4).collect()} == {0, 1}
    assert sum(r["n_removed"] for r in substring_dedup.substring_report(spark.createDataFrame([docs[0], (5, docs[0][1])], "doc_id long, text string")).collect()) == 13


def test_word_hashes_go_by_content():
    rng = random.Random(11)
    made = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 30))).encode() for _ in range(3000)]
    texts = [b"\t".join(made[i : i + 60]) + b"\n" * (i % 3) for i in range(0, 3000, 60)] + [b"", b" ", b"\x0bA a"]
    hashes, counts = word_hashes(texts, ways=2)
    flat = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    for h in hashes:
        assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    lower, _ = word_hashes([b"ABC abc \xc3\x89 \xc3\xa9"], lower=True)
    assert lower[0][0] == lower[0][1] and lower[0][2] != lower[0][3]


@pytest.mark.parametrize("depth", [3, 8, 13, 40, 100])
def test_bucket_pointers(depth):
    rng = random.Random(depth)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(150))) for _ in range(8)]
    texts += [texts[0] * 3, texts[1] + texts[0]]
    data, ends = b"".join(texts), np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    pointer = bucket_pointers(np.frombuffer(data, np.uint8), ends, depth)
    found = {}
    for i in range(len(data)):
        if i + depth > ends[i]:
            assert pointer[i] == -1
        else:
            found.setdefault(data[i : i + depth], set()).add(int(pointer[i]))
    assert all(len(p) == 1 for p in found.values())
    ordered = [p for k in sorted(found) for p in found[k]]
    assert ordered == sorted(set(ordered))


@pytest.mark.parametrize("fan_out", [1, 3])
def test_exchange_in_two_levels(spark, corpus, fan_out, monkeypatch):
    """More buckets than a chunk deals to, a few entries at a time: the same results."""
    docs = spark.createDataFrame([(i, t) for i, t in corpus], "doc_id long, text string").repartition(3)
    expected = sorted(map(tuple, substring_dedup.substring_report(docs).collect())), sorted(map(tuple, suffix_dedup.suffix_report(docs).collect()))
    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "bucket_count", lambda *_: 7)
        monkeypatch.setattr(module, "Buckets", functools.partial(first_owner.Buckets, fan_out=fan_out, again_entries=300, slice_entries=100))
    assert (sorted(map(tuple, substring_dedup.substring_report(docs).collect())), sorted(map(tuple, suffix_dedup.suffix_report(docs).collect()))) == expected


@pytest.mark.parametrize("rule", ["earlier", "other"])
def test_hot_keys_are_settled_on_the_way(rule):
    """A passage in every document, a chunk for each: of what is dealt again a hot key goes on about once in so many entries, the rest is settled, and none is lost."""
    buckets = first_owner.Buckets(8, fan_out=2, again_entries=1000)
    rng, hot, rows = np.random.default_rng(3), np.arange(1, 6, dtype=np.uint64) << np.uint64(61), []
    for c in range(400):
        main = np.concatenate((hot, rng.integers(1 << 20, 1 << 63, 20, np.uint64)))
        none, doc = np.zeros(25, np.uint16), np.zeros(25, np.int64)
        for batch in first_owner.requests(buckets, main, none, doc, np.arange(25), np.array([c]), np.frombuffer(hashlib.md5(bytes([c % 256, c // 256])).digest(), TAG), rule=rule):
            rows += batch.to_pylist()
    rows.sort(key=lambda r: (r["kind"], r["bucket"]))
    schema = first_owner._REQUEST_SCHEMA
    gathered = [pa.RecordBatch.from_pylist(rows[i : i + 50], schema) for i in range(0, len(rows), 50)]
    out = [r for b in first_owner._deal_again(buckets, (rule,))(iter(gathered)) for r in b.to_pylist()]
    going = np.concatenate([np.frombuffer(r["main"], np.uint64) for r in out if not r["settled"]])
    settled = sum(int(first_owner._unpacked(r)[2].sum()) for r in out if r["settled"])
    passes = 400 * 25 // 1000 + 2
    assert 5 <= np.isin(going, hot).sum() <= 5 * passes * (2 if rule == "other" else 1)
    assert len(going) + settled == 400 * 25 if rule == "earlier" else settled == 400 * 5
    assert all(first_owner.bucket_of(np.frombuffer(r["main"], np.uint64), 8).tolist() == [r["bucket"]] * (len(r["main"]) // 8) for r in out if not r["settled"])


def test_hot_shingles_are_not_paired_within_a_component(spark):
    """Many sets with one common part: pairs are made across components only."""
    common = list(range(1000, 1090))
    sets = {i: np.array(sorted([*common, *range(i * 20, i * 20 + 10)]), "<u8") for i in range(40)}
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, set binary")
    members = spark.createDataFrame([(1, i, 100, 0 if i else 77) for i in sets], "bucket long, node long, size long, comp long")
    none = spark.createDataFrame([], "node long, leader long, linked boolean")
    pairs = {(r["leader"], r["node"]) for r in minhash_dedup._prefix_pairs(members, rows, none, 80).collect()}
    assert pairs == {(0, i) for i in sets if i}
