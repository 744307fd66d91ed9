"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing, token_counts
from weftline.llm.pieces import _SPLIT, default_path, pre_token_starts, vocabulary

TEXTS = [
    None, "", " ", "plain words, and more words.", "it's they'll I'M 's''s", "tabs\t\tand  \n\n newlines \r\n", "café naïve ½ ² µ ª", "\x1c\x1d \x85 \xa0 x",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "日本語のテキスト", "\U0001f6a6\U0001f6a6 ok", "1234567 12a34", "___ -- !!", "a" * 5000, " " * 5000 + "x", "ü" * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    prose = ["".join(rng.choice("abcdeé ,.\n'3") for _ in range(rng.randrange(9000))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(TEXTS + prose)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, docs, library):
    found = {r["doc_id"]: r for r in token_counts.token_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        n = len(ids_of(library, t))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdlre<|endoftext|>")), max_size=40))
def test_pre_tokens_and_ids(text):
    vocab, path = vocabulary(default_path()), default_path()
    raw = text.encode()
    pieces, special = vocab.pre_tokens(text, raw)
    expected = vocab.ids([text])[0]
    assert sum(map(len, vocab.ids(pieces))) + special == len(expected) if pieces else special == len(expected)
    assert packing.token_ids(raw, path).tolist() == expected


_LATIN = st.text(alphabet=st.one_of(st.characters(max_codepoint=0x23F), st.sampled_from(" \n\t\r\xa0\x85'sdtmlrevx!7é")), min_size=1, max_size=30)


@settings(max_examples=1000, deadline=None)
@given(st.lists(_LATIN, min_size=1, max_size=5))
def test_starts_of_pre_tokens_are_those_of_the_pattern(texts):
    """Texts that lie one after another split as each by itself."""
    raws = [t.encode() for t in texts]
    firsts = np.cumsum([0, *map(len, raws[:-1])])
    data = b"".join(raws)
    at = [*np.flatnonzero(pre_token_starts(np.frombuffer(data, np.uint8), firsts)).tolist(), len(data)]
    assert [data[s:e].decode() for s, e in zip(at[:-1], at[1:], strict=True)] == [p for t in texts for p in _SPLIT.findall(t)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([t or "" for t in TEXTS]), st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'slé")), max_size=20)), max_size=8))
def test_ids_of_many_texts(texts):
    """Texts tokenised together have the ids that the library gives each of them, special strings and wide characters included."""
    vocab = vocabulary(default_path())
    ids, ends = vocab.ids_of_texts([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, ends)[: len(texts)]] == (vocab.ids(texts) if texts else []) and len(ids) == (ends[-1] if texts else 0)


def test_a_pre_token_is_looked_up_once_for_many_texts(monkeypatch):
    """packing looks up what is distinct in a chunk of texts, not every occurrence."""

    class Known(dict):
        asked = 0

        def get(self, key, default=None):
            Known.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Known.asked += 1
            return super().__getitem__(key)

    monkeypatch.setattr(vocabulary(default_path()), "known", Known())
    texts = [f"some words that come again and again in number {k}" for k in range(500)]
    batch = pa.record_batch([pa.array(range(500)), pa.array([bytes(16)] * 500), pa.array(texts)], names=["doc_id", "tag", "text"])
    out = pa.Table.from_batches(packing._cut(default_path(), 2048, 256, 1)([batch]))
    assert sum(out.column("length").to_pylist()) == sum(map(len, vocabulary(default_path()).ids(texts))) + 500
    assert Known.asked <= 2 * (10 + 500)


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_chunks_of_texts_lose_no_row(limit, monkeypatch, library):
    monkeypatch.setattr(packing, "CHUNK_BYTES", limit)
    batch = pa.record_batch([pa.array([None, *range(1, len(TEXTS))], pa.int64()), pa.array([bytes(16)] * len(TEXTS)), pa.array(TEXTS)], names=["doc_id", "tag", "text"])
    rows = [r for b in packing._cut(default_path(), 2048, 256, 1)([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    expected = []
    for k, text in enumerate(TEXTS):
        ids = np.array([*ids_of(library, text), 1], "<u4")
        bounds = packing.piece_bounds(len(ids))
        expected += [(k or None, s, e - s, zlib.crc32(ids[s:e].tobytes()), len(ids)) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in rows] == expected


def test_packing(spark, docs, library):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.packed(df).collect()
    sequences, covered = {}, {}
    for r in rows:
        ids = [*ids_of(library, docs[r["doc_id"]][1]), 1]
        own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"], r["length"]) == (len(ids), zlib.crc32(own.tobytes()), len(own)) and r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts, most in [(p, 2048) for p in sequences.values()] + [(p, None) for p in covered.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert most is None or at <= most
    assert covered.keys() == {i for i, _ in docs}
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total / 2048 + 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.packed(df.repartition(5)).collect()))


@pytest.mark.parametrize("n", [1, 255, 256, 257, 2047, 2048, 2049, 2304, 5000])
def test_piece_bounds(n):
    bounds = packing.piece_bounds(n)
    assert bounds[0] == 0 and bounds[-1] == n and all(0 < b - a <= 2048 for a, b in zip(bounds, bounds[1:], strict=False))


def test_assignment_is_by_cost_and_room():
    sizes = np.array([2000, 1500, 700, 500, 300, 48])
    sequence, offset = packing.assign(sizes)
    assert sequence.tolist() == [0, 1, 2, 2, 2, 2] and offset.tolist() == [0, 0, 0, 700, 1200, 1500]
