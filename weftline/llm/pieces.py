"""Pre-tokens and token ids of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: A task has a core; the library's own threads would only get in each other's way.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"

# The splitting pattern of byte-level BPE, with its character
# classes spelled out for code points below U+0240.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ȿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LETTER, _NUMBER, _BLANK, _OTHER = range(4)
#: Class of each code point that UTF-8 writes in two bytes at most; those below U+0240 are the ones in use.
_CLASS = np.array([next((k for k, c in enumerate((_L, _N, _S)) if re.match(f"[{c}]", chr(p))), _OTHER) for p in range(0x800)], np.uint8)
#: The character that the vocabulary spells each byte with: itself if it shows, else the next one from U+0100 on.
_SHOWS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = np.zeros(256, "<u2")
_SPELLED[_SHOWS] = _SHOWS
_SPELLED[_SPELLED == 0] = 0x100 + np.arange(256 - len(_SHOWS))
#: The largest byte of a UTF-8 text whose code points are all below U+0240.
_LAST_BYTE = 0xC8

#: Pre-tokens whose ids a process keeps.
KNOWN_PIECES = 800_000


def pre_token_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each byte: what _SPLIT finds in texts that lie one after another and hold code points below U+0240 only.

    data: the texts' bytes; firsts: where each text starts, in ascending order, none of them empty."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC0)
    lead = lead[lead + 1 < len(data)]
    kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    start = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[firsts] = True
    begins = np.flatnonzero(start)  # of runs of one class
    ends = np.append(begins[1:], len(data))
    inner = np.ones(len(data) + 1, bool)  # not where a text ends
    inner[firsts] = inner[-1] = False

    quote = (data[begins] == 0x27) & (ends - begins == 1) & inner[ends]
    quote = begins[quote]
    quote = quote[~inner[quote] | (data[quote - 1] != 0x20)]
    one = data[quote + 1]
    two = np.where(inner[np.minimum(quote + 2, len(data))], data[np.minimum(quote + 2, len(data) - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = np.isin(one.astype(np.uint16) << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])

    before = ends[(kind[begins] == _BLANK) & inner[ends]]  # a blank before something else stands alone, or leads it if it is a space
    start[before - 1 - ((data[before - 1] & 0xC0) == 0x80)] = True
    start[before[data[before - 1] == 0x20]] = False

    start[quote[short | long] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long] + 3))
    start[after[after < len(data)]] = True
    return start


class Vocabulary:
    """A tokenizer file, read once per process."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_bytes = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        self.special_ids = {x.encode(): self.tokenizer.token_to_id(x) for x in special}
        self.known: dict[bytes, bytes] = {}

    def pre_tokens(self, text: str, raw: bytes) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings stand between them."""
        if self.special is None or (len(text) >= 1 and not self.special.search(text)):
            return self._split(text, raw), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self._split(part, part.encode())], len(parts) - 1

    def _split(self, text: str, raw: bytes) -> list[str]:
        if not raw:
            return []
        if np.frombuffer(raw, np.uint8).max() <= _LAST_BYTE:
            return _SPLIT.findall(text)
        return [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids_of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts, one after another, as the library gives them, and where each text's ids end.

        Each distinct pre-token is looked up once for all texts; those not met before are tokenised one by one."""
        flat = b"".join(texts)
        text_ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not flat:
            return np.empty(0, "<u4"), text_ends
        data, starts = np.frombuffer(flat, np.uint8), self._starts(flat, texts, text_ends)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            if len(self.known) > KNOWN_PIECES:
                self.known.clear()
            names = [distinct[k] for k in new]
            for k, name, ids in zip(new, names, self._tokenised(names), strict=True):
                found[k] = self.known[name] = ids
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = pieces.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - counts)
        upto = np.searchsorted(starts, text_ends)  # pre-tokens of this text and those before
        return ids[np.repeat(shift, counts) + np.arange(ends[-1])], np.concatenate(([0], ends))[upto]

    def _starts(self, flat: bytes, texts: list[bytes], text_ends: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of all texts start, special strings included as one each."""
        data = np.frombuffer(flat, np.uint8)
        marks = []  # of special strings, whole
        if self.special is not None:
            for end, text in zip(text_ends.tolist(), texts, strict=True):
                marks += [(end - len(text) + m.start(), end - len(text) + m.end()) for m in self.special_bytes.finditer(text)]
        bounds = np.unique(np.concatenate(([0], text_ends, np.array(marks, np.int64).ravel())))
        start = pre_token_starts(data, bounds[:-1])
        wide = np.unique(np.searchsorted(bounds, np.flatnonzero(data > _LAST_BYTE), "right") - 1)
        for s, e in zip(bounds[wide].tolist(), bounds[wide + 1].tolist(), strict=True):
            sizes = [len(p.encode()) for p in self._split(flat[s:e].decode(), flat[s:e])]
            start[s:e] = False
            start[s + np.cumsum(sizes) - sizes] = True
        for s, e in marks:
            start[s + 1 : e] = False
        return np.flatnonzero(start)

    def _tokenised(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, each spelled as the vocabulary spells it and tokenised by itself."""
        spelled = _SPELLED[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
        tokenize, flat, ends, at = self.model.tokenize, array("I"), [0], 0
        for p in pieces:
            to = at + len(p)
            if p in self.special_ids:
                flat.append(self.special_ids[p])
            else:
                flat.extend([t.id for t in tokenize(spelled[at:to])])
            ends.append(4 * len(flat))
            at = to
        data = flat.tobytes()
        return [data[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)
