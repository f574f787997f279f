"""Comparing the members of cells in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a cell that are compared in one task at a time, and rows that a task gets together.
BLOCK_ROWS, TASK_ROWS = 1024, 8192


def blocks(members: DataFrame, cells: DataFrame, cell: Sequence[str], node: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``members`` of the cells in ``cells`` (with their count ``held``), once for each block that compares them.

    A cell with more than ``block_rows`` members is cut into slices by a hash of the node, and every
    slice meets every slice, itself included, once. Adds work, low, high and slice: blocks of equal
    work go to one task, about TASK_ROWS rows, so many small cells cost no more than a few.
    """
    cut = cells.select(*cell, F.ceil(F.col("held") / block_rows).cast("int").alias("slices"), "held")
    total = cut.agg(F.sum(F.col("held") * F.col("slices")).alias("rows")).first()["rows"] or 0
    sliced = members.join(cut.drop("held"), list(cell)).withColumn("slice", F.pmod(F.xxhash64(node), F.col("slices")).cast("int"))
    met = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    named = met.withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other")).drop("slices", "other")
    return named.withColumn("work", F.pmod(F.xxhash64(*cell, "low", "high"), F.lit(max(1, math.ceil(total / TASK_ROWS)))))


def each_block(rows: pa.Table, cell: Sequence[str], node: str) -> Iterator[tuple[pa.Table, bool]]:
    """The blocks among the rows of a task, ordered by node, and whether a block joins two slices."""
    names = [*cell, "low", "high"]
    rows = rows.sort_by([(c, "ascending") for c in (*names, node)]).combine_chunks()
    keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in names], 1)
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        if end - start > 1:
            yield rows.slice(start, end - start), bool(keys[start, -1] != keys[start, -2])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def compared(rows: DataFrame, cell: Sequence[str], node: str, compare: Callable[[pa.Table, bool], list[np.ndarray] | None], names: Sequence[str]) -> DataFrame:
    """Applies ``compare`` to every block; it returns one array of whole numbers per name, or None."""

    def run(table: pa.Table) -> pa.Table:
        found = [f for block, across in each_block(table, cell, node) if (f := compare(block, across)) is not None]
        columns = [np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for i in range(len(names))]
        return pa.table(dict(zip(names, map(pa.array, columns))))

    return rows.groupBy("work").applyInArrow(run, ", ".join(f"{n} long" for n in names))
