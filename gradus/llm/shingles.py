"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from .pretokens import _BASE, _Powers

WINDOW = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of every text, ascending.

    A-Z count as lower case; a text of fewer than five words is one shingle, a text without words has none.
    """
    data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    blank = _BLANK[data]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = change[::2], change[1::2]
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(limits, start, side="left")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    weights = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(WINDOW)]
    padded = np.concatenate((word, np.zeros(WINDOW, np.uint64)))
    h = np.zeros(len(word), np.uint64)
    for k, weight in enumerate(weights):
        whole = counts[owner] > k  # short texts: only their own words
        own = np.arange(len(word)) + k < (first + counts)[owner]
        h += np.where(whole & own, padded[k:k + len(word)] * weight, np.uint64(0))
    place = np.arange(len(word)) - first[owner]
    keep = (place + WINDOW <= counts[owner]) | ((place == 0) & (counts[owner] < WINDOW))
    h, owner = mix(h[keep]), owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [h[a:b] for a, b in zip(cuts, cuts[1:])]
