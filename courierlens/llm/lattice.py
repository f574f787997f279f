"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors to a few blocks of eight dimensions and decodes each block to
the nearest point of the E8 lattice, the densest packing there; the points of all blocks are
the vector's home cell. A vector near the border of its cell is also put into the neighbouring
cells that it is closest to (probing). Vectors that share a cell in any of the tables are
compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.blocks import BLOCK_ROWS, blocks, each_block, local_roots
from courierlens.llm.components import components
from courierlens.llm.shared import saved, valid_vector

#: Members of a cell up to which its pairs are compared together with those of other cells, and pairs at a time.
SMALL_CELL, PAIRS = 64, 1 << 16


@dataclass(frozen=True)
class Grid:
    """How vectors are put into cells.

    ``tables`` projections to ``lattice_blocks`` blocks of eight dimensions, ``count`` cells per table and
    vector, and the projected length of a unit step (the lattice's points lie 1.41 apart).
    """

    tables: int
    lattice_blocks: int
    count: int
    scale: float


#: Grids for tables of up to so many vectors. A pair with a cosine of 0.95 shares a cell of one of a grid's tables with
#: probability 0.61, 0.61, 0.60, 0.49 and 0.43, so fewer than one in a thousand such pairs share none; unrelated
#: vectors do so seldom that a vector meets a few of them at the upper end of each range.
GRIDS = [(20_000, Grid(10, 2, 6, 0.65)), (60_000, Grid(10, 3, 8, 0.5)), (600_000, Grid(10, 3, 16, 0.6)),
         (2_500_000, Grid(14, 4, 16, 0.5)), (math.inf, Grid(16, 4, 32, 0.58))]


def grid_for(rows: int) -> Grid:
    """Smaller cells for larger tables."""
    return next(grid for most, grid in GRIDS if rows <= most)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    whole = np.rint(x)
    gap = x - whole
    worst = np.abs(gap).argmax(1)
    rows = np.arange(len(x))
    odd = whole.sum(1) % 2 != 0
    whole[rows[odd], worst[odd]] += np.where(gap[rows[odd], worst[odd]] >= 0, 1, -1)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8 or D8 shifted by a half in each coordinate."""
    plain, shifted = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - shifted) ** 2).sum(1) < ((x - plain) ** 2).sum(1)
    return np.where(closer[:, None], shifted, plain)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8, from the lattice's rule: the steps to a point's neighbours."""
    signs = np.array(np.meshgrid(*[[-1.0, 1.0]] * 8, indexing="ij")).reshape(8, -1).T
    halves = signs[(signs < 0).sum(1) % 2 == 0] / 2
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a in (-1, 1) for b in (-1, 1)]
    return np.vstack([halves, pairs])


def cells(units: np.ndarray, grid: Grid, seed: int = 11) -> np.ndarray:
    """Per row ``tables * count`` cell numbers, those of a table beside each other, its home first.

    Probes change one block: of all blocks' neighbouring points those closest to the vector.
    """
    tables, lattice_blocks, count, scale = grid.tables, grid.lattice_blocks, grid.count, grid.scale
    steps, dim = shortest_e8(), units.shape[1]
    rng = np.random.default_rng([seed, dim])
    projections = rng.standard_normal((tables, dim, 8 * lattice_blocks)) * scale
    weights = rng.integers(1, 2**62, (tables, lattice_blocks, 8), dtype=np.uint64) | np.uint64(1)
    found = np.empty((len(units), tables, count), np.uint64)
    for t in range(tables):
        x = (units @ projections[t]).reshape(-1, lattice_blocks, 8)
        home = np.stack([nearest_e8(x[:, b]) for b in range(lattice_blocks)], 1)
        number = np.stack([((home[:, b] * 2).astype(np.int64).view(np.uint64) * weights[t, b]).sum(1, dtype=np.uint64) for b in range(lattice_blocks)], 1)
        found[:, t, 0] = number.sum(1, dtype=np.uint64)
        if count > 1:
            # Distance to home + step is smaller the larger the step's part along the remainder is.
            gain = np.concatenate([(x[:, b] - home[:, b]) @ steps.T for b in range(lattice_blocks)], 1)
            best = np.argpartition(-gain, count - 1, axis=1)[:, :count - 1]
            moves = np.concatenate([((steps * 2).astype(np.int64).view(np.uint64) * weights[t, b]).sum(1, dtype=np.uint64) for b in range(lattice_blocks)])
            found[:, t, 1:] = found[:, t, :1] + moves[best]
    found = found.reshape(len(units), -1) + np.repeat(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), count)
    found ^= found >> np.uint64(29)
    return (found * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _own_pairs(a: np.ndarray, b: np.ndarray, cells_of: np.ndarray, table: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs that share no cell of an earlier table and no smaller cell of this one. ``table`` and ``cell`` are per pair."""
    for t in range(cells_of.shape[1]):
        kept = [np.empty(0, bool)]
        for at in range(0, len(a), PAIRS // 16):
            some = slice(at, at + PAIRS // 16)
            left, right = cells_of[a[some], t], cells_of[b[some], t]
            same = (left[:, :, None] == right[:, None, :]).any(2)
            same &= (t < table[some, None]) | ((t == table[some, None]) & (left < cell[some, None]))
            kept.append(~same.any(1))
        mine = np.concatenate(kept)
        a, b, table, cell = a[mine], b[mine], table[mine], cell[mine]
    return a, b


def _near_in_small_cells(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of the same cell with a cosine of the threshold or more. Cells hold all rows, from ``starts`` to ``ends``."""
    rows = np.arange(len(units))
    partners = np.repeat(ends, ends - starts) - rows - 1
    found = [(np.empty(0, np.int64),) * 2]
    total = np.cumsum(partners)
    first = 0
    while first < len(rows):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = partners[first:last]
        a = np.repeat(rows[first:last], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
        found.append((a[near], b[near]))
        first = last
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _unit_rows(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy().reshape(rows, -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _links(part: pa.Table, across: bool | None, threshold: float, count: int) -> pa.Table:
    """(node, links, to) of one dimension's rows: of a block that is compared by itself, or (None) of many small cells."""
    node, n, cell, table = (part.column(c).to_numpy() for c in ("node", "n", "cell", "table"))
    units = _unit_rows(part.column("x"), len(node))
    if across is None:
        low = part.column("low").to_numpy()
        starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (low[1:] != low[:-1])))
        a, b = _near_in_small_cells(units, starts, np.append(starts[1:], len(cell)), threshold)
    else:
        a, b = np.nonzero(np.triu(units @ units.T >= threshold, 1))
        if across:
            own = part.column("slice").to_numpy()
            a, b = a[own[a] != own[b]], b[own[a] != own[b]]
    root = local_roots(len(node), a, b)
    cells_of = part.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), -1, count)
    a, b = _own_pairs(a, b, cells_of, table[a], cell[a])
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
    return pa.table({"node": node[some], "links": links[some], "to": node[root[some]]})


def _compared(members: DataFrame, threshold: float, count: int) -> DataFrame:
    """(node, links, to) of all blocks: the number of links found there, and the smallest node connected to.

    Cells of up to SMALL_CELL members are compared together, larger ones block by block.
    """

    def run(rows: pa.Table) -> pa.Table:
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("dim", "cell", "low", "high")], 1)
        _, of, sizes = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
        small = (sizes[of.ravel()] <= SMALL_CELL) & (keys[:, 2] == keys[:, 3])
        found = [pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "to")})]
        few = rows.filter(pa.array(small)).sort_by([(c, "ascending") for c in ("dim", "cell", "low", "node")])
        for dim in pc.unique(few.column("dim")).to_pylist():
            found.append(_links(few.filter(pc.equal(few.column("dim"), dim)), None, threshold, count))
        many = rows.filter(pa.array(~small))
        if len(many):
            found += [_links(block, across, threshold, count) for block, across in each_block(many, ["dim", "cell"], "node")]
        return pa.concat_tables(found)

    return members.groupBy("work").applyInArrow(run, "node long, links long, to long")


def similar_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.95, grid: Grid | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``df``: ``key``, n_links, component_id, kept.

    Rows are linked if the cosine of their vectors in double precision is ``threshold`` or more.
    n_links counts the rows that a row is linked to; component_id is the smallest key reachable by
    links, itself included; kept says that it is the row's own. Vectors that are null, all zero or
    hold null or non-finite components are linked to nothing, vectors of different dimension are not
    compared. Rows without key have no links, a null component and are not kept. Rows that repeat a
    key and a vector are one row in the links and as many in the result.

    Equal vectors are counted once, with their number. The grid follows the number of vectors (see GRIDS),
    so cells hold about as many unrelated vectors in a large table as in a small one. Cells with more than ``block_rows`` vectors
    are compared in pairs of slices, so no task holds more than two slices. A pair that shares
    several cells belongs to the smallest of them, so each link is counted once without collecting
    links; a block gives two rows per vector at most, its links there and the smallest vector it
    is connected to.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("x"))
    usable = rows.filter(F.col("id").isNotNull() & valid_vector(F.col("x")))
    # Equal vectors make one node, named by its smallest key. A row that is repeated counts once.
    nodes = saved(usable.distinct().groupBy("x").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "vectors")
    grid = grid or grid_for(nodes.count())
    count = grid.count

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            for dim in pc.list_value_length(vectors).unique().to_pylist():
                part = batch.filter(pc.equal(pc.list_value_length(vectors), dim))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.abs(x).max(1)[:, None]
                found = cells(x / np.linalg.norm(x, axis=1)[:, None], grid)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(x), dim, np.int32)), lists], ["node", "x", "n", "dim", "cells"])

    placed = saved(nodes.select("node", "x", "n").mapInArrow(hashed, "node long, x array<double>, n long, dim int, cells array<long>"), "lattice-cells")
    each = placed.select("node", "dim", F.posexplode("cells").alias("place", "cell"))
    shared = saved(each.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "shared-cells")
    members = blocks(each.withColumn("table", F.floor(F.col("place") / count)), shared, ["dim", "cell"], "node", block_rows)
    with_vectors = members.join(placed.select("node", "x", "n", "cells"), "node")

    linked = saved(_compared(with_vectors, threshold, count), "vector-links")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(linked.select(F.col("node").alias("a"), F.col("to").alias("b")))
    found = (nodes.select("x", "node", "n").join(links, "node", "left").join(named, "node", "left")
             .select(F.col("x").alias("_x"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "node").alias("_component")))
    # Rows go to their vector's node by the vector itself; rows that are not usable find none.
    keyed = rows.withColumn("usable", F.col("id").isNotNull() & valid_vector(F.col("x")))
    joined = keyed.join(found, F.col("usable") & (F.col("x") == F.col("_x")), "left")
    component = F.coalesce("_component", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                         F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
