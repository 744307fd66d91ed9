"""Bucket-pointer refinement of suffixes, to a fixed depth.

Suffixes are first put into buckets by their GRAM bytes, each bucket pointing to
where it starts in the order of all.  A bucket of several suffixes is then
refined by sorting them on the pointers of the suffixes some bytes on, which are
known to the same depth: that doubles the depth.  Pointers updated in one round
are what the next one sorts on.  Buckets of one suffix are done.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.common import runs

GRAM = 8


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, where its run of equal values starts."""
    starts = runs(ordered)
    return np.repeat(starts, np.diff(np.append(starts, len(ordered))))


def bucket_pointers(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For each byte's place the pointer of the bucket of the `depth` bytes from there on, or -1 where fewer are left.

    ends: for each place, the end of the text that it belongs to.  Strings of
    `depth` bytes have one pointer if they are equal, and only then; pointers are
    in the order of the strings."""
    n = len(data)
    pointer = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.arange(n) + min(GRAM, depth) <= ends)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    grams = np.ndarray((n,), ">u8", buffer=padded, strides=(1,))[at].astype(np.uint64) >> np.uint64(8 * (8 - min(GRAM, depth)))
    order = np.argsort(grams, kind="stable")
    pointer[at[order]] = _starts(grams[order])
    known = min(GRAM, depth)
    while known < depth:
        step = min(known, depth - known)
        at = np.flatnonzero(np.arange(n) + known + step <= ends)
        bucket = pointer[at]
        several = at[np.bincount(bucket, minlength=1)[bucket] > 1]
        own = pointer[several]
        order = np.lexsort((pointer[several + step], own))
        own, several = own[order], several[order]
        refined = own * n + pointer[several + step]
        updated = np.full(n, -1, np.int64)
        updated[at] = bucket
        updated[several] = own + _starts(refined) - _starts(own)
        pointer, known = updated, known + step
    return pointer
