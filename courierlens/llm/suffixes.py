"""Suffix arrays of many sequences at once, their common prefixes, and tandem repeats from their intervals.

Sequences of whole numbers are laid one behind the other, each closed by a number of its own, and
no number occurs in two of them. So the suffixes of a sequence are neighbours in the order, and no
prefix is shared between sequences: one pass over the arrays treats each sequence by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Suffixes of smaller children that are looked at together.
PAIRS = 1 << 20


def laid_out(sequences: Sequence[Sequence[object]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for all items, those of a sequence behind the one that closes it in value, and where sequences begin."""
    numbers: list[int] = []
    begins, base = [0], 0
    for items in sequences:
        known: dict[object, int] = {}
        numbers += [known.setdefault(x, len(known) + base + 1) for x in items]
        numbers.append(base)
        base += len(known) + 1
        begins.append(len(numbers))
    return np.array(numbers, np.int64), np.array(begins, np.int64)


def sort_suffixes(numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The suffixes in order, each one's place in it, and the ranks by the first 1, 2, 4... numbers.

    Doubling ends when all suffixes differ, or when they are ordered by more than ``depth`` numbers;
    those that share more stand in any order. Only suffixes that are still alike are sorted again.
    """
    size = len(numbers)
    order = np.argsort(numbers, kind="stable")
    rank = _group_starts(numbers[order])
    place = np.empty(size, np.int64)
    place[order] = rank
    levels = [place.astype(np.int32 if size < 2**31 else np.int64)]
    open_ = order[_repeated(rank)]
    step = 1
    while len(open_) and step <= depth:
        key = place[open_] * size + place[open_ + step]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = place[open_]
        at = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        inner = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        place[open_] = group + inner - first
        levels.append(place.astype(levels[0].dtype))
        open_ = open_[_repeated(inner)]
        step *= 2
    order = np.argsort(place, kind="stable")
    place[order] = np.arange(size)
    return order, place, levels


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    at = np.arange(len(ordered))
    return np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), at, 0))


def _repeated(ordered: np.ndarray) -> np.ndarray:
    """Which of these ascending numbers occur more than once."""
    same = ordered[1:] == ordered[:-1]
    return np.append(same, False) | np.append(False, same)


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many numbers each suffix shares with the one before it; -1 ahead of the first and behind the last."""
    shared = np.zeros(len(order) + 1, np.int64)
    at = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[at], order[at + 1]
    for step in reversed(range(len(levels))):
        same = levels[step][a] == levels[step][b]
        shared[at[same] + 1] += 1 << step
        a, b = a + (same << step), b + (same << step)
    shared[[0, -1]] = -1
    return shared


def _nearest_smaller(values: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
    """For the places ``at`` the next one to the left (-1) or right (1) with a smaller value, by jumping along found ones."""
    found = np.arange(len(values)) + way
    while len(at):
        next_ = found[at]
        further = values[next_] >= values[at]
        at, next_ = at[further], next_[further]
        found[at] = found[next_]
    return found


def branching_tandems(numbers: np.ndarray, order: np.ndarray, place: np.ndarray, shared: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next number differs from the one a period earlier.

    ``most`` is the longest period looked for at each start. Each interval of suffixes that share
    ``depth`` numbers falls into children by the number that follows. A branching square of period
    ``depth`` is two suffixes of different children that start ``depth`` apart, so at least one of them
    is in a child other than the largest; only those look for their partner, by its place in the
    order. That makes n log n looks at most. Intervals are pairs of bounds; no tree is built.
    """
    at = np.flatnonzero(shared > 0)
    left, right = _nearest_smaller(shared, at, -1), _nearest_smaller(shared, at, 1)
    at = at[shared[at] <= most[order[at]]]
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none
    at = at[np.lexsort((at, shared[at], left[at]))]
    opens = np.append(True, (left[at][1:] != left[at][:-1]) | (shared[at][1:] != shared[at][:-1]))
    starts = np.flatnonzero(opens)
    number = np.cumsum(opens) - 1
    # An interval's children begin at its left bound and at each of its own places.
    begin = np.empty(len(at) + len(starts), np.int64)
    begin[np.arange(len(at)) + number + 1] = at
    heads = starts + np.arange(len(starts))
    begin[heads] = left[at[starts]]
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(heads, len(begin))))
    end = np.append(begin[1:], 0)
    end[np.append(heads[1:], len(begin)) - 1] = right[at[starts]]
    sizes = end - begin
    largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, heads)[of])
    smaller = np.ones(len(begin), bool)
    smaller[largest[np.append(True, of[largest][1:] != of[largest][:-1])]] = False
    begin, sizes, of = begin[smaller], sizes[smaller], of[smaller]
    low, high, depth = left[at[starts]][of], right[at[starts]][of], shared[at[starts]][of]

    found = []
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, sizes.sum() + PAIRS, PAIRS), side="left") + 1
    first = 0
    for cut in np.unique(np.minimum(cuts, len(sizes))).tolist():
        some, first = slice(first, cut), cut
        n = sizes[some]
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = order[np.repeat(begin[some], n) + offsets]
        lo, hi, d = (np.repeat(x[some], n) for x in (low, high, depth))
        for a, b in ((i, i + d), (i - d, i)):
            other = b if a is i else a
            near = place[np.maximum(other, 0)]
            inside = np.flatnonzero((other >= 0) & (near >= lo) & (near < hi))
            a, p = a[inside], d[inside]
            branching = numbers[a + p] != numbers[a + 2 * p]
            found.append(np.stack([a[branching], p[branching]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.stack([none, none])
    return pairs[0], pairs[1]
