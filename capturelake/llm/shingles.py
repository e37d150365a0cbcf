"""Hashed words and word shingles of many texts at once, for use inside Spark tasks.

Words are runs of ASCII letters and digits and of characters outside ASCII, in lower case. A text of fewer words than a
shingle has one shingle of all its words; a text without words has none."""

from __future__ import annotations

import numpy as np

from capturelake.llm.tokens import mix, spans_hash

WORDS = 5
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FACTORS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (one more at the end)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    doc = np.concatenate([[0], np.cumsum(size + 1)])
    return spans_hash(buf, starts, ends), np.searchsorted(starts, doc + 1)


def shingle(hashes: np.ndarray, begin: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's shingles begin."""
    size = np.diff(begin)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(start[-1], np.uint64)
    long = np.flatnonzero(size >= n)
    at = np.repeat(begin[:-1][long] - (np.cumsum(count[long]) - count[long]), count[long]) + np.arange(count[long].sum())
    value = np.zeros(len(at), np.uint64)
    for i in range(n):
        value += hashes[at + i] * _FACTORS[i]
    out[np.repeat(start[:-1][long] - (np.cumsum(count[long]) - count[long]), count[long]) + np.arange(count[long].sum())] = value
    for i in np.flatnonzero((size < n) & (size > 0)):
        own = hashes[begin[i] : begin[i + 1]]
        out[start[i]] = (own * _FACTORS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), start


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets (sorted arrays): common over united occurrences."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    value, first = np.unique(both, return_index=True)
    na = np.searchsorted(a, value, "right") - np.searchsorted(a, value, "left")
    nb = np.diff(np.append(first, len(both))) - na
    return float(np.minimum(na, nb).sum() / np.maximum(na, nb).sum())
