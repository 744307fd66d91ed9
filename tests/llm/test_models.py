"""Quality rules, mixing and the two classifiers: plain Python, exact properties, held-out accuracy."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import cotraining, language_id, mixing, quality_rules
from weftline.llm.linear import ngram_counts, scaled

COMMON = {"en": "the of and to a in is that it for", "de": "der die und in den von zu das mit sich", "fr": "de la le et les des en un du une", "es": "de la que el en y los se las del"}
SYLLABLES = {"en": "th er ing ed ou st", "de": "sch en ung keit ü ge", "fr": "eau ou ç é ment oi", "es": "ción ar ñ ado os í"}


def prose(rng, lang, n):
    made = lambda: "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(2, 5)))
    out = [rng.choice(COMMON[lang].split()) if rng.random() < 0.25 else made() for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", "", "", "", ",", ".\n"]) for w in out).capitalize()


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(COMMON)) for _ in range(40)]
    docs = [prose(rng, lang, rng.choice([10, 60, 300])) for lang in langs]
    docs += [None, "", "a a a a", "a b c a b c a b c", "one\n\n two \none\n", "x " * 200, " ".join(w + "***" for w in docs[0].split()) * 9]
    docs += [d.upper().replace(" ", "!! ") for d in docs[:10]] + [" | ".join(d.split()) for d in docs[10:20]] + [docs[20] + "\n" + docs[20]]
    found = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame([(i, t, langs[i] if i < 40 else None) for i, t in enumerate(docs)], "doc_id long, text string, lang string")).collect()}
    for i, text in enumerate(docs):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_rules(text), text
        assert not (r["base_failed"] and r["kept"])
    for i in range(40):
        assert found[i]["kept"] == (not found[i]["base_failed"])
    spoilt = [r for i, r in found.items() if 47 <= i < 67 and not r["base_failed"]]
    assert spoilt and not any(r["kept"] for r in spoilt)


def js_distance(p, q):
    p, q = np.array(p), np.array(q)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt(max((kl(p) + kl(q)) / 2, 0))


def class_shares(text):
    counts = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        counts[2 if kind == "Lu" else 0 if kind[0] == "L" else 1 if c in " \t\n\v\f\r" else 3 if c in ".,;:!?'\"()-" else 4 if kind[0] == "N" else 5] += 1
    return [c / max(len(text), 1) for c in counts]


def test_references_and_distances(spark):
    """References counted and distances taken in plain Python, whatever the text holds."""
    rng = random.Random(14)
    docs = [(i, prose(rng, lang, 150), lang) for i, lang in enumerate(rng.choices(list(COMMON), k=60))]
    df = spark.createDataFrame([*docs, (90, None, "en"), (91, "not in a reference", None), (92, "", "empty")], "doc_id long, text string, lang string")
    refs = quality_rules.references(df, top=12)
    for lang in COMMON:
        own = Counter(w.lower() for _, t, g in docs if g == lang for w in t.split())
        top = sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:12]
        assert list(refs.words[lang]) == [w for w, _ in top]
        assert list(refs.words[lang].values()) == pytest.approx([c / own.total() for _, c in top])
        assert refs.classes[lang] == pytest.approx(class_shares("".join(t for _, t, g in docs if g == lang)))
    assert set(refs.words) == set(COMMON)
    texts = [t for _, t, _ in docs[:20]] + ["the cat, and 3 dogs! #" * 30, "der der der la", "$$$ $$$", "xyz"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality_rules.class_distance(F.col("t"), refs).alias("c"), quality_rules.word_distance(F.regexp_extract_all(F.lower("t"), F.lit(r"\S+"), F.lit(0)), refs).alias("w")).collect()
    for r in found:
        words = Counter(r["t"].lower().split())
        near = []
        for q in refs.words.values():
            p = [words[w] / words.total() for w in q]
            near.append(js_distance([*p, max(1 - sum(p), 0)], [*q.values(), 1 - sum(q.values())]))
        assert r["w"] == pytest.approx(min(near), abs=1e-9), r["t"]
        assert r["c"] == pytest.approx(min(js_distance(class_shares(r["t"]), q) for q in refs.classes.values()), abs=1e-9), r["t"]
    nothing = quality_rules.references(df.where("doc_id = 91"))
    assert nothing.words == {} and quality_rules.quality(df.where("doc_id < 60"), refs=nothing).where("kept").count() == 60


@pytest.mark.parametrize("n", [1, 70])
def test_many_languages(spark, n):
    """Distances from the nearest of many languages that share words, in plain Python; the plan has as many steps for any number of them."""
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(60)]
    words, classes = {}, {}
    for k in range(n):
        counts = {w: rng.randrange(1, 30) for w in rng.sample(vocabulary, rng.randrange(1, 12))}
        words[f"l{k:02}"] = {w: c / (sum(counts.values()) + rng.randrange(60)) for w, c in counts.items()}
        shares = [rng.random() + 0.01 for _ in range(quality_rules.CLASSES)]
        classes[f"l{k:02}"] = [x / sum(shares) for x in shares]
    refs = quality_rules.References(classes, words)
    texts = [" ".join(rng.choices([*vocabulary, "x", "y"], k=rng.randrange(1, 60))) for _ in range(60)] + ["none of them", "w1", "W1 9 !"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality_rules.word_distance(F.split("t", " "), refs).alias("w"), quality_rules.class_distance(F.col("t"), refs).alias("c"))
    for r in df.collect():
        own = Counter(r["t"].split(" "))
        near = []
        for q in words.values():
            p = [own[w] / own.total() for w in q]
            near.append(js_distance([*p, max(1 - sum(p), 0)], [*q.values(), max(1 - sum(q.values()), 0)]))
        assert r["w"] == pytest.approx(min(near), abs=1e-7), r["t"]
        assert r["c"] == pytest.approx(min(js_distance(class_shares(r["t"]), q) for q in classes.values()), abs=1e-7), r["t"]
    steps = lambda refs: str(df.select(quality_rules.word_distance(F.split("t", " "), refs), quality_rules.class_distance(F.col("t"), refs))._jdf.queryExecution().analyzed()).count("lambdafunction")
    two = quality_rules.References({k: classes[k] for k in sorted(classes)[:2]}, {k: words[k] for k in sorted(words)[:2]})
    assert steps(refs) == steps(two)


def water_level(sizes):
    """Targets by the contract's words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in sizes if s not in stopped]
        target = {s: 3.0 * sizes[s] for s in stopped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        stopped |= above


@pytest.mark.parametrize("fan_in", [8192, 50])
def test_mixing(spark, fan_in, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rng = random.Random(6)
    sources = ["a", "b", "é", None, "z", "tiny"]
    docs = [(i, "w " * rng.randrange(1, 60), s) for i, s in enumerate(rng.choices(sources, [900, 300, 200, 100, 100, 3], k=1600))] + [(9000, None, "a"), (9001, "", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixing.mixture_report(df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    target = water_level(dict(sizes))
    for s, own in found.groupby("source", dropna=False):
        name = s if isinstance(s, str) else None
        assert own["source_size"].iloc[0] == sizes[name] and own["target"].iloc[0] == pytest.approx(target[name])
        assert abs(own["taken"].sum() - target[name]) <= own["size"].max()
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] == found["copies"] * found["size"]).all()
    again = mixing.mixture_report(df.repartition(7)).toPandas()
    assert dict(zip(again["doc_id"], again["taken"], strict=True)) == dict(zip(found["doc_id"], found["taken"], strict=True))


def test_pivots_keep_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, total = rng.integers(1, 50, 30).astype(float), np.zeros(30)
    for _ in range(3000):
        p, held = mixing.pivot(np.full(30, 0.3), size, rng.random(30))
        assert abs((p * size).sum() - 0.3 * size.sum()) < 1e-6 and sum(0 < x < 1 for x in p) == (held >= 0)
        total += p
    assert np.abs(total / 3000 - 0.3).max() < 0.06


def test_language_id(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(rng.choices(list(COMMON), k=600))] + [(9000, "123 !!", "en"), (9001, None, "en"), (9002, prose(rng, "en", 50), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = language_id.identify(df).toPandas().merge(df.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found["held_out"] & (found["doc_id"] < 9000)]
    assert len(held) > 50 and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all() and set(found[found["doc_id"].isin([9000, 9001])]["lang_pred"]) == {"und"}
    changed = language_id.identify(df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang"))))
    assert {r["doc_id"]: r["lang_pred"] for r in changed.collect()} == dict(zip(found["doc_id"], found["lang_pred"], strict=True))


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30, 201, 1500])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and all(0 < b.sum() < n for b in code.T)
    if n > language_id.EXHAUSTIVE:
        apart = language_id.least_distance(n, code.shape[1])
        assert apart >= 6 and min(np.abs(code[i] - code[:i]).sum(1).min() for i in range(1, n)) >= apart


def test_decoding_is_by_weighted_loss():
    """The chosen language, its score and its lead, bit by bit in plain Python."""
    rng = np.random.default_rng(2)
    code, trust = language_id.codewords(5), rng.uniform(0.1, 1, language_id.codewords(5).shape[1])
    weights = rng.normal(size=(9, code.shape[1])).astype(np.float32)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    best, score, lead = language_id.LanguageModel(list("abcde"), code, weights, trust).predict(x)
    for row, b, s, d in zip(x, best, score, lead, strict=True):
        loss = []
        for word in code:
            margin = [sum(float(v) * float(w) for v, w in zip(row, weights[:-1, k], strict=True)) + float(weights[-1, k]) for k in range(len(word))]
            loss.append(sum(t * np.log(1 + np.exp(-m if bit else m)) for t, m, bit in zip(trust, margin, word, strict=True)))
        share = sorted(np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum())
        assert b == int(np.argmin(loss)) and s == pytest.approx(share[-1], abs=1e-4) and d == pytest.approx(share[-1] - share[-2], abs=1e-4)


def test_features_of_a_text_are_its_own():
    texts = [b"first text", b"", b"second, longer text " * 5000, b"x"]
    assert all((ngram_counts(texts)[i] == ngram_counts([t])[0]).all() for i, t in enumerate(texts))
    assert ngram_counts([b"abc"]).sum() == 6  # two for each place, blanks after the end


def test_quality_classifier(spark):
    rng = random.Random(9)
    good = [prose(rng, "en", 80) for _ in range(300)]
    bad = [" ".join(w + rng.choice(["$$$", "***", "%%%"]) for w in prose(rng, "en", 80).split()) for _ in range(150)]
    docs = [(i, t, "en", f"s{i % 7}") for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450) if i % 3], "doc_id long, quality int")
    found = cotraining.classify(df, labels).toPandas()
    held = found[found["doc_id"] % 3 == 0]
    assert (held["kept"] == (held["doc_id"] < 300)).mean() > 0.97 and held["quality_score"].between(0, 1).all()


def test_views_teach_each_other(spark):
    """What the sure rows of one view teach the other, added up over all rows, against one sum in plain Python; and a view that learns from it."""
    rng = random.Random(10)
    docs = [(i, 0, prose(rng, "en", 30) if i % 2 else "$$ " * 40, "good" if i % 2 else "bad", "en", 100) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, tag int, text string, source string, lang string, n_chars long")
    text = scaled(ngram_counts([t.encode() for _, _, t, *_ in docs]))
    meta = cotraining.meta_features([d[3] for d in docs], [d[4] for d in docs], [d[5] for d in docs])
    label = np.arange(300) % 2.0
    back = np.arange(300) % 4 == 0
    first = [cotraining.fitted(x[:60], label[:60], np.arange(60) % 5 == 0, cotraining.class_sums(x[:60], label[:60])) for x in (text, meta)]
    model = cotraining.QualityModel(*first, 0.0)
    lessons = cotraining._lessons(rows.repartition(5), model, 0.7)
    p = model.scores(text, meta)
    for one, x, other in ((1, text, 0), (0, meta, 1)):
        sure = np.where(p[one] >= 0.7, 1, np.where(p[one] <= 0.3, 0, -1))
        assert (sure >= 0).sum() > 200
        assert np.allclose(lessons[other], cotraining.class_sums(x, sure), rtol=1e-5, atol=1e-4)
    taught = cotraining.fitted(text, label, back, lessons[0])
    assert ((taught.log_odds(text) > 0) == label).mean() > 0.99


def test_views_are_calibrated():
    """A view's probabilities are right on average where its margins are too bold."""
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.8).astype(float)
    x = np.stack([y + rng.normal(size=4000), rng.normal(size=4000)], 1).astype(np.float32)
    view = cotraining.fitted(x[:3000], y[:3000], np.arange(3000) % 4 == 0, cotraining.class_sums(x[:3000], y[:3000]))
    p = 1 / (1 + np.exp(-view.log_odds(x[3000:])))
    assert abs(p.mean() - y[3000:].mean()) < 0.03
    sure = p > 0.9
    assert sure.any() and abs(p[sure].mean() - y[3000:][sure].mean()) < 0.04


def test_every_language_is_learnt(spark):
    """A thousand languages of two texts each, and rows that repeat in everything."""
    letters = "bcdfghjklmnpqrstvwxz"
    words = {f"l{k:03d}": letters[k % 20] + "aeiouy"[k // 20 % 6] + letters[k // 120] + "u" for k in range(1000)}
    docs = [(i, " ".join([w] * 20), g) for i, (g, w) in enumerate(x for x in words.items() for _ in range(3))] + [(5, "bau " * 20, "l000")] * 50
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words) and len({tuple(c) for c in model.code}) == 1000
    best = model.predict(scaled(ngram_counts([(w + " ").encode() * 20 for w in words.values()])))[0]
    assert (best == np.arange(1000)).mean() > 0.5
    few = language_id.train(spark.createDataFrame([(i, f"text {i}", "en") for i in range(500)], "doc_id long, text string, lang string"), per_language=30)
    assert few.languages == ["en"]
