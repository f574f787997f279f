"""Nearest neighbours with an inverted multi-index.

Both halves of the vectors get a codebook of their own, and a row's cell is its pair of
centroids; the codebooks grow with the table, so that there are about as many cells as rows. A
query visits cells by the sum of the squared distances of its halves to the two centroids,
smallest first, until they hold the wanted number of entries. A heap over tiles of the two
sorted lists yields the tiles that come next, so only a part of all pairs is looked at. All
entries of the cells visited are measured exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierlens.llm.shared import saved, valid_vector

#: Centroids per half at most, vectors that the codebooks are fitted on (drawn by hash), and rounds of fitting.
MOST_CENTROIDS, FIT_ROWS, FIT_ROUNDS = 1024, 20_000, 10
#: Entries and queries that are compared in one task at a time, and queries in one matrix.
BLOCK_ENTRIES, BLOCK_QUERIES, SLICE_QUERIES = 4096, 8192, 256
#: Centroids of each half in a tile of the traversal.
TILE = 16


def centroids_for(rows: int) -> int:
    """Centroids per half: the first power of two whose square is the number of rows or more."""
    return min(MOST_CENTROIDS, max(TILE, 2 ** math.ceil(math.log2(max(rows, 1)) / 2)))


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def fit_codebook(x: np.ndarray, size: int, rounds: int, seed: int = 7) -> np.ndarray:
    """k-means on a sample; at most ``size`` different centroids."""
    rng = np.random.default_rng(seed)
    centroids = np.unique(x, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:size]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squares(x[at:at + 4096], centroids).argmin(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves, for vectors divided by ``scale``; of fixed size."""

    first: np.ndarray
    second: np.ndarray
    scale: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        x = x / self.scale
        second = x[:, cut:] if x.shape[1] > cut else np.zeros((len(x), 1))
        return _squares(x[:, :cut], self.first), _squares(second, self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(x)
        return d1.argmin(1) * len(self.second) + d2.argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: int, tile: int = TILE) -> tuple[np.ndarray, float]:
    """The cells by rising d1 + d2 until they hold ``wanted`` entries, and the last one's sum; empty cells are left out.

    A heap holds the tiles of the two sorted lists that may come next, each by its smallest sum. Cells whose
    sum is below that of the heap's first tile cannot be preceded by any that is still to come.
    """
    order1, order2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[order1], d2[order2]
    held = counts.reshape(len(d1), len(d2))
    wide, deep = -(-len(s1) // tile), -(-len(s2) // tile)
    heap, done = [(s1[0] + s2[0], 0, 0)], [-1] * wide
    sums: list[np.ndarray] = []
    cells: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    seen, looked = 0, 0
    while heap:
        _, i, j = heapq.heappop(heap)
        done[i] = j
        rows, columns = order1[i * tile:(i + 1) * tile], order2[j * tile:(j + 1) * tile]
        inner = held[np.ix_(rows, columns)]
        some = np.nonzero(inner)
        sums.append((s1[i * tile:(i + 1) * tile, None] + s2[None, j * tile:(j + 1) * tile])[some])
        cells.append(rows[some[0]] * len(d2) + columns[some[1]])
        sizes.append(inner[some])
        seen, looked = seen + int(sizes[-1].sum()), looked + 1
        # A tile enters the heap when both its smaller neighbours have been taken.
        if i + 1 < wide and done[i + 1] == j - 1:
            heapq.heappush(heap, (s1[(i + 1) * tile] + s2[j * tile], i + 1, j))
        if j + 1 < deep and (i == 0 or done[i - 1] >= j + 1):
            heapq.heappush(heap, (s1[i * tile] + s2[(j + 1) * tile], i, j + 1))
        if seen >= wanted and looked % 8 == 0 and heap:
            ripe = heap[0][0]
            if sum(int(n[s <= ripe].sum()) for s, n in zip(sums, sizes)) >= wanted:
                break
    if not seen:
        return np.empty(0, np.int64), -1.0
    sum_, cell, size = np.concatenate(sums), np.concatenate(cells), np.concatenate(sizes)
    by = np.lexsort((cell, sum_))
    enough = int(np.searchsorted(np.cumsum(size[by]), wanted)) + 1
    by = by[:enough]
    return cell[by], float(sum_[by[-1]])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; scaled where squares would leave the range of doubles."""
    gap = a - b
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt((gap * gap).sum(1))
        worst = np.abs(gap).max(1, initial=0)
        odd = (worst > 1e150) | ((worst < 1e-150) & (worst > 0))
        if odd.any():
            found[odd] = worst[odd] * np.sqrt(((gap[odd] / worst[odd, None]) ** 2).sum(1))
    return found


def _best(asks: np.ndarray, own: np.ndarray, limit: np.ndarray, books: Codebooks, ids: np.ndarray, cells: np.ndarray, x: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance) of the ``k`` nearest of a block's entries in cells that each query visits.

    A product of matrices tells which entries can be among them; these are measured, ties included.
    """
    first, second = books.halves(asks)
    visits = first[:, cells // len(books.second)] + second[:, cells % len(books.second)] <= limit[:, None]
    scale = max(np.abs(x).max(), np.abs(asks).max())
    y, z = asks / scale, x / scale
    about = (y * y).sum(1)[:, None] - 2 * y @ z.T + (z * z).sum(1)
    about[~visits | (own[:, None] == ids)] = np.inf
    least = np.partition(about, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    slack = 1e-12 * ((y * y).sum(1) + (z * z).sum(1).max())
    query, entry = np.nonzero((about <= (least + slack)[:, None]) & np.isfinite(about))
    score = distances(x[entry], asks[query])
    by = np.lexsort((ids[entry], score, query))
    query, entry, score = query[by], entry[by], score[by]
    starts = np.searchsorted(query, np.arange(len(asks)))
    top = np.arange(len(query)) - starts[query] < k
    return query[top], entry[top], score[top]


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, share: float = 0.35, least: int = 2000,
            centroids: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each query row: query_id, rank, vec_id, score (Euclidean distance).

    Candidates of a query are all rows but those with its own key; ties go to the smaller key. A
    query looks at the cells nearest to it that hold ``share`` of all rows, and ``least`` rows, at
    least, and as many more as have its own key, so it gets ``k`` rows wherever there are so many. Vectors
    that are null, all zero or hold null or non-finite components take no part, nor do rows without
    key or of another dimension than most. Rows that repeat a key and vector count once, as entries and
    as queries; different vectors of one key are entries of their own, and a list each as queries.

    Codebooks are fitted on at most ``fit_rows`` rows; all rows are indexed. Their size follows the
    number of rows up to MOST_CENTROIDS. Only they and one count per cell reach the driver. Rows are
    compared in blocks: neighbouring cells share one, a cell with many rows has several, and many
    queries make several chunks; both are dealt by row numbers, so repeated keys and vectors spread. A block
    gives at most ``k`` rows per query.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("x"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & valid_vector(F.col("x")))
    distinct = rows.groupBy("id", "x").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    rows = saved(distinct.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "x", "asks"), "vectors")
    largest = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), largest.alias("m"))
    usual = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return df.sparkSession.createDataFrame([], schema)
    dim, total, queries = usual["d"], usual["n"], usual["q"]
    rows, size = rows.filter(F.size("x") == dim), centroids or centroids_for(total)

    draw = F.pmod(F.xxhash64("id", "x"), F.lit(1_000_000))
    sample = _matrix(rows.filter(draw < min(1.0, 0.9 * fit_rows / total) * 1_000_000).select("x").limit(fit_rows).toArrow().combine_chunks().column("x").combine_chunks())
    if not len(sample):
        sample = _matrix(rows.select("x").limit(size).toArrow().combine_chunks().column("x").combine_chunks())
    sample, cut = sample / usual["m"], (dim + 1) // 2
    second = sample[:, cut:] if dim > 1 else np.zeros((len(sample), 1))
    books = Codebooks(fit_codebook(sample[:, :cut], size, FIT_ROUNDS), fit_codebook(second, size, FIT_ROUNDS), usual["m"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(books.cells(_matrix(batch.column(2))))], ["row", "id", "x", "asks", "cell"])

    placed = saved(rows.mapInArrow(place, "row long, id long, x array<double>, asks boolean, cell long"), "multi-index")
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]

    # Cells in order fill one block after the other; one that is larger than a block gets several of its own.
    first_block, blocks_of = np.zeros(len(counts), np.int64), np.maximum(-(-counts // BLOCK_ENTRIES), 1)
    block, room = 0, BLOCK_ENTRIES
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > room and room < BLOCK_ENTRIES:
            block, room = block + 1, BLOCK_ENTRIES
        first_block[cell] = block
        if n > BLOCK_ENTRIES:
            block += int(blocks_of[cell])
        else:
            room -= n
    chunks = max(1, math.ceil(queries / BLOCK_QUERIES))
    wanted = max(least, k, math.ceil(share * total))

    # How many rows have a query's own key: these are no candidates, so that many more are visited.
    asked = placed.filter("asks").select("row", "id", "x")
    mine = placed.join(asked.select("id").distinct(), "id", "left_semi").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("own"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = books.halves(_matrix(batch.column(2)))
            taken, into, limits = [], [], []
            for at, own in enumerate(batch.column(3).to_pylist()):
                cells, limit = traverse(d1[at], d2[at], counts, wanted + own)
                parts = blocks_of[cells]
                found = np.unique(np.repeat(first_block[cells], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                taken.append(np.full(len(found), at))
                into.append(found)
                limits.append(np.full(len(found), limit))
            at = pa.array(np.concatenate(taken))
            # Sums are computed anew in other batches, so the last cell's gets some room.
            limit = np.concatenate(limits)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], pa.array(limit + 1e-9 * (1 + limit)), pa.array(np.concatenate(into))],
                                             ["row", "id", "x", "reach", "block"])

    asks = asked.join(mine, F.col("id") == F.col("_id")).select("row", "id", "x", "own")
    asks = asks.mapInArrow(visit, "row long, id long, x array<double>, reach double, block long")
    asks = asks.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, number = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            at = first_block[cell] + (number % blocks_of[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at)], ["id", "x", "cell", "block"])

    entries = placed.select("id", "x", "cell", F.xxhash64("row")).mapInArrow(block_of, "id long, x array<double>, cell long, block long")
    entries = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def compare(asking: pa.Table, has: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(asking) and len(has):
            ids, cells = has.column("id").to_numpy(), has.column("cell").to_numpy()
            x, y = _matrix(has.column("x").combine_chunks()), _matrix(asking.column("x").combine_chunks())
            rows, own, reach = (asking.column(c).to_numpy() for c in ("row", "id", "reach"))
            for at in range(0, len(rows), SLICE_QUERIES):
                some = slice(at, at + SLICE_QUERIES)
                query, entry, score = _best(y[some], own[some], reach[some], books, ids, cells, x, k)
                found.append((rows[some][query], own[some][query], ids[entry], score))
        return pa.table(dict(zip(("ask", "query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    near = asks.groupBy("block", "chunk").cogroup(entries.groupBy("block", "chunk")).applyInArrow(compare, "ask long, query_id long, vec_id long, score double")
    return ranked(near, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query by score and key. A query has at most ``k`` rows per block."""
    place = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
