"""Fast similarity sketching of sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from courierlens.llm.words import mix

_EMPTY = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_VALUE_BITS = np.uint64(48)
_VALUE = np.uint64((1 << 48) - 1)


def sketch(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """A sketch of a set with at least one element, as 16-bit coordinates.

    Two sketches agree in a coordinate with the probability that is the sets' Jaccard similarity.
    In round i < t every element is thrown into one of the t bins by its i-th hash; in round
    t + i all elements are thrown into bin i, so no bin stays empty. A bin keeps the smallest
    value, and values of earlier rounds are smaller, so rounds end as soon as all bins are
    filled, after about t log t throws. Small sets do several rounds at a time.
    """
    bins = np.full(coordinates, _EMPTY, np.uint64)
    at_once = max(1, -(-2 * coordinates // len(hashes)))
    first = 0
    while first < 2 * coordinates and (bins == _EMPTY).any():
        rounds = np.arange(first, min(first + at_once, 2 * coordinates), dtype=np.uint64)[:, None]
        drawn = mix(hashes[None, :] + (rounds + np.uint64(1)) * _STEP)
        into = (drawn >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)
        if first + at_once > coordinates:
            into = np.where(rounds < coordinates, into, np.maximum(rounds, coordinates) - np.uint64(coordinates))
        np.minimum.at(bins, into.ravel().astype(np.int64), (rounds << _VALUE_BITS | drawn & _VALUE).ravel())
        first += at_once
    return (mix(bins) >> np.uint64(48)).astype(np.uint16)
