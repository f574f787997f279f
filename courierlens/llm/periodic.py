"""Runs of words that repeat with a period, by the branching-tandem test on enhanced suffix arrays.

A run ends with exactly one branching square of its period; rotating that to the left, as long as
the word ahead equals the one a period later, gives the whole run. Squares of a multiple of the
period end at the same word and lie within the run that the smallest period gives, so they are
merged into it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.pieces import slices
from courierlens.llm.suffixes import branching_tandems, common_prefixes, laid_out, sort_suffixes

#: Words whose suffixes are sorted together; a longer text is sorted by itself.
SLICE_WORDS = 1 << 16

_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _reach_left(numbers: np.ndarray, start: int, period: int) -> int:
    """The start of the longest stretch of this period that goes on to the square at ``start``."""
    size = 64
    while start:
        n = min(size, start)
        differ = np.flatnonzero(numbers[start - n:start] != numbers[start - n + period:start + period])
        if len(differ):
            return start - n + int(differ[-1]) + 1
        start, size = start - n, size * 2
    return 0


def find_runs(sequences: Sequence[Sequence[object]], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Per sequence the (start, length, period) of its runs, by start and then by period."""
    numbers, begins = laid_out(sequences)
    lengths = np.diff(begins) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    longest = lengths // least_exponent
    if not len(numbers) or not longest.max():
        return found
    order, place, levels = sort_suffixes(numbers, int(longest.max()))
    shared = common_prefixes(order, levels)
    del levels
    starts, periods = branching_tandems(numbers, order, place, shared, np.repeat(longest, np.diff(begins)))
    # Squares that cannot be rotated far enough go before any is followed to its end.
    wanted = np.maximum(least_length, least_exponent * periods) - 2 * periods
    for step in range(1, 9):
        good = (wanted < step) | ((starts >= step) & (numbers[np.maximum(starts - step, 0)] == numbers[np.maximum(starts - step, 0) + periods]))
        starts, periods, wanted = starts[good], periods[good], wanted[good]
    ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in np.lexsort((starts, periods)).tolist():
        start, period, end = int(starts[at]), int(periods[at]), int(starts[at] + 2 * periods[at])
        if any(first <= start for first, _ in ends[end]):
            continue
        first = _reach_left(numbers, start, period)
        if end - first >= max(least_length, least_exponent * period):
            ends[end].append((first, period))
    runs = sorted((first, period, end - first) for end, of in ends.items() for first, period in of)
    owner = np.searchsorted(begins, [r[0] for r in runs], side="right") - 1
    for (first, period, length), text in zip(runs, owner.tolist()):
        found[text].append((first - int(begins[text]), length, period))
    return found


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(df: DataFrame, key: str, text: str, least_length: int = 6, least_exponent: int = 4, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per row of ``df``: ``key``, n_words, runs, collapsed.

    Words are runs of bytes other than ASCII white space. A run is a stretch of consecutive words
    with the smallest period q (words q apart are equal) and at least max(``least_length``,
    ``least_exponent`` * q) words that no word beside it extends; ``least_exponent`` is 2 or more.
    runs lists (start, length, period), counted in words from 0, by start and then by period.
    collapsed is the text's words joined by one space without those that any run holds behind its
    first q. A null or empty text has no words, no runs and an empty collapsed text. Texts are read
    whole, each by itself; rows that repeat a key or text are each answered, and keys of any type,
    null too, are passed through. Other columns are not read. Time grows with n log n, memory of
    a task with its longest text. An empty table gives none.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent must be 2 or more")
    rows = df.select(df[key].alias("key"), df[text].cast("string").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or b"").split() for t in batch.column(1).to_pylist()]
            for first, behind in slices([len(w) + 1 for w in words], slice_words):
                some = words[first:behind]
                runs = find_runs(some, least_length, least_exponent)
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in of] for of in runs]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, behind - first), pa.array([len(w) for w in some], pa.int64()), pa.array(listed, _RUN),
                    pa.array([collapse(w, of) for w, of in zip(some, runs)], pa.binary()),
                ], ["key", "n_words", "runs", "collapsed"])

    found = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
