"""Hashes of words and of runs of words, for many texts at once.

A word is a run of characters other than ASCII white space, with A-Z in lower case. Its hash
is a polynomial in its bytes modulo 2**64, read off a running sum over all texts, and then
mixed; the hash of a run of words combines theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from courierlens.llm.pieces import slices

#: Bytes handled at once in a task.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240101)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for i, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in lower case and as they are, and where words begin and end."""
    joined = b"\n" + b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower(), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return data, np.frombuffer(joined, np.uint8), edges[::2], edges[1::2]


def _hashes(data: np.ndarray, begin: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the bytes from ``begin`` to each of ``ends``."""
    up, down = _tables(SLICE_BYTES if len(data) <= SLICE_BYTES else len(data))
    running = np.cumsum(_VALUES[data] * up[:len(data)], dtype=np.uint64)
    before, scale = running[begin - 1], down[begin]
    return [mix((running[end - 1] - before) * scale + (end - begin).astype(np.uint64)) for end in ends]


def _firsts(texts: list[bytes], begin: np.ndarray) -> np.ndarray:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]) + 1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, in order, and where each text's words begin (one entry more than texts)."""
    data, _, begin, end = _words(texts)
    return _hashes(data, begin, [end])[0], _firsts(texts, begin)


#: Kinds of bytes: 1 upper case, 2 digit, 3 other visible ASCII; 0 the rest, among them all of other alphabets.
_KINDS = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if 32 < b < 127 and not 97 <= b <= 122 else 0 for b in range(256)])


def word_forms(texts: list[bytes], heads: tuple[int, ...], window: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their first bytes, so many as ``heads`` say, shapes, and where each text's words begin;
    hashes of ``window`` bytes, where each text's begin, and which begin beyond ASCII.

    A shape, a number below 64, says if the word starts in upper case, if it has more than one
    capital and more than small letters, if it has digits, if it has no, one or several other
    characters, and if it repeats the word before it. Windows, of at most eight bytes, begin at
    every character but white space that has so many bytes of its text from there on.
    """
    data, plain, begin, end = _words(texts)
    firsts = _firsts(texts, begin)
    kinds = _KINDS[plain]
    upper, digit, other = (np.concatenate([[0], np.cumsum(kinds == k)]) for k in (1, 2, 3))
    n_upper, n_digit, n_other = (c[end] - c[begin] for c in (upper, digit, other))
    loud = (n_upper > 1) & (2 * n_upper > (end - begin) - n_digit - n_other)
    cut = _hashes(data, begin, [end, *[np.minimum(begin + n, end) for n in heads]])
    words = cut[0]
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[firsts[:-1][firsts[:-1] < len(words)]] = False
    shapes = (kinds[begin] == 1) * 1 + loud * 2 + (n_digit > 0) * 4 + np.minimum(n_other, 2) * 8 + again * 32
    edges = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))]) + 1
    starts = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    for back in range(1, window):
        starts[np.maximum(edges[1:] - 1 - back, 0)] = False
    at = np.flatnonzero(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))
    windows = mix(eight[at] & np.uint64((1 << 8 * window) - 1))
    return cut, shapes, firsts, windows, np.searchsorted(at, edges), data[at] >= 0x80


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the run of ``length`` words that starts at each word; shorter by length - 1."""
    n = max(len(words) - length + 1, 0)
    found = np.full(n, length, np.uint64)
    for j in range(length):
        found = mix(found * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n])
    return found


def shingle_sets(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``length`` words; of fewer words, of all of them."""
    words, firsts = word_hashes(texts)
    hashed = runs(words, length)
    found = []
    for first, behind in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        n = behind - first
        if n >= length:
            found.append(np.unique(hashed[first:behind - length + 1]))
        else:
            found.append(runs(words[first:behind], n) if n else np.empty(0, np.uint64))
    return found


def sliced(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Neighbouring texts as UTF-8, about ``most`` bytes at a time; a null text is empty."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for first, behind in slices(map(len, data), most - len(data) - 2):
        yield first, behind, data[first:behind]
