"""Hashed byte n-grams and logistic regression, for classifiers that are trained here."""

from __future__ import annotations

import numpy as np

#: Number of hashed features.
DIMENSIONS = 4096
#: Rows whose features one Python step holds at a time.
ROWS = 256
#: Bytes whose n-grams are counted at once.
_BLOCK = 1 << 18
_GAP = b"   "


def letters_only() -> np.ndarray:
    """Byte table: A-Z as a-z, other ASCII but letters as blanks; bytes of other characters stay."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def ngram_counts(texts: list[bytes], table: np.ndarray | None = None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of bytes, a row per text; whole texts, each by itself."""
    flat = np.frombuffer(_GAP.join(texts) + _GAP, np.uint8)
    if table is not None:
        flat = table[flat]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + len(_GAP)) - sizes - len(_GAP)
    out = np.zeros(len(texts) * dimensions, np.float32)
    at = 0
    while at < len(texts):  # blocks of whole texts, or of a part of a long one
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK, "right")) - 1)
        for low in range(int(starts[at]), int(starts[to - 1] + sizes[to - 1]), _BLOCK * 4):
            high = min(low + _BLOCK * 4, int(starts[to - 1] + sizes[to - 1]))
            a = flat[low : high + 2].astype(np.int64)
            doc = np.searchsorted(starts, np.arange(low, high), "right") - 1 - at if to - at > 1 else np.zeros(high - low, np.int64)
            inside = np.arange(low, high) < (starts + sizes)[at + doc]
            two = a[:-1] * 0x9E3779B1 + a[1:] * 0x85EBCA77
            three = two[:-1] + a[2:] * 0xC2B2AE3D
            for gram in (two[: high - low], three[: high - low] + 0x27D4EB2F):
                slot = (gram ^ (gram >> 15)) * 0x2C1B3C6D >> 12 & (dimensions - 1)
                found = np.bincount((doc * dimensions + slot)[inside], minlength=(to - at) * dimensions)
                out[at * dimensions : to * dimensions] += found
        at = to
    return out.reshape(len(texts), dimensions)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, to length 1."""
    x = np.sqrt(counts)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, turns: int = 200, rate: float = 8.0, decay: float = 1e-4, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights (last row: intercepts) of one logistic regression per column of y (0 or 1); full gradients with momentum, so that reruns agree.

    prior: weights to start from and to decay to; zero if not given."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.reshape(len(x), -1).astype(np.float32)
    weight = np.full(len(x), 1 / max(len(x), 1), np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)
    start = np.zeros((x.shape[1], y.shape[1]), np.float32) if prior is None else prior.astype(np.float32)
    w, speed = start, 0.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * 0.1 * (x.T @ ((p - y) * weight[:, None]) + decay * (w - start))
        w = w + speed
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sparse(counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The places and values of each row that aren't 0."""
    slots = [np.flatnonzero(c).astype("<u2") for c in counts]
    return [s.tobytes() for s in slots], [c[s].astype("<f4").tobytes() for c, s in zip(counts, slots, strict=True)]


def dense(rows: list, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows with slots and counts, as made by sparse, back as an array."""
    x = np.zeros((len(rows), dimensions), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["slots"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return x


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
