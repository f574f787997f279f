"""Search and near-duplicates of vectors against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from courierlens.llm import lattice, multi_index
from courierlens.llm.components import components
from courierlens.llm.queries import QUERIES

DATA = "/root/testdata/check_s/embeddings.parquet"


def given(path):
    table = pq.read_table(path)
    return table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)


def linked(ids, x, threshold=0.95):
    """vec_id -> (links, smallest id reachable), comparing all pairs."""
    units = x / np.linalg.norm(x, axis=1)[:, None]
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    names = ids.copy()
    for _ in range(len(ids)):
        smaller = np.minimum(names, np.where(near, names[None, :], np.iinfo(np.int64).max).min(1))
        if (smaller == names).all():
            break
        names = smaller
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), names)}


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")


def components_of(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def clusters(rng, sizes, dim=64, noise=0.02):
    centers = rng.standard_normal((len(sizes), dim))
    return np.concatenate([c + noise * np.linalg.norm(c) * rng.standard_normal((n, dim)) for c, n in zip(centers, sizes)])


def test_links_of_the_given_vectors(small):
    spark, sf_dir = small
    ids, x = given(f"{sf_dir}/embeddings.parquet")
    rows = QUERIES["op9_lattice_vectors"](spark, sf_dir)
    assert components_of(rows) == linked(ids, x)
    assert rows.filter("kept <> (vec_id = component_id)").isEmpty()


def test_groups_in_small_blocks(small):
    """A hot group that several blocks share, small groups, copies, and noise that makes some pairs just miss."""
    spark, _ = small
    rng = np.random.default_rng(4)
    x = np.concatenate([clusters(rng, [150, 20, 3], noise=0.02), rng.standard_normal((200, 64))])
    x = np.concatenate([x, x[:30], -x[:3]])
    ids = rng.permutation(len(x)) + 7
    want = linked(ids, x)
    assert len({c for _, c in want.values()}) > 150 and max(n for n, _ in want.values()) > 20
    got = components_of(lattice.similar_vectors(frame(spark, ids, x), "vec_id", "embedding", block_rows=32))
    total = sum(n for n, _ in want.values())
    missed = sum(abs(got[i][0] - want[i][0]) for i in want)
    assert missed <= 0.001 * total and all(got[i][0] <= want[i][0] for i in want)
    assert [got[i][1] for i in sorted(want)] == [want[i][1] for i in sorted(want)]


def test_nearest_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (400, 8))
    point = lattice.nearest_e8(x)
    assert ((point * 2).astype(int) % 2).std(1).max() == 0 and (point.sum(1) % 2 == 0).all()
    # The covering radius of E8 is 1, and no neighbour of the point may be closer.
    gap = ((x - point) ** 2).sum(1)
    around = ((x[:, None] - point[:, None] - lattice.shortest_e8()[None]) ** 2).sum(2)
    assert gap.max() <= 1 + 1e-9 and (around.min(1) >= gap - 1e-9).all()
    assert len(np.unique(lattice.shortest_e8(), axis=0)) == 240 and (lattice.shortest_e8() ** 2).sum(1).std() == 0


@pytest.mark.parametrize("grid", [grid for _, grid in lattice.GRIDS])
def test_pairs_at_the_threshold_share_a_cell(grid):
    rng = np.random.default_rng(2)
    a, other = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other -= (other * a).sum(1)[:, None] * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * other / np.linalg.norm(other, axis=1)[:, None]
    one, two = (lattice.cells(v, grid) for v in (a, b))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(one.tolist(), two.tolist())]) > 0.998


def test_unrelated_vectors_seldom_share_a_cell_of_their_grid():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for most, grid in lattice.GRIDS[:3]:
        cells, n = np.unique(lattice.cells(x, grid), return_counts=True)
        # Pairs per vector, carried to the upper end of the grid's range.
        assert (n * (n - 1.0)).sum() / 2 / len(x) * (most / len(x)) < 4
    assert lattice.grid_for(1) == lattice.GRIDS[0][1] and lattice.grid_for(10**12) == lattice.GRIDS[-1][1]


@pytest.mark.parametrize("grid", [grid for _, grid in lattice.GRIDS[1:3]])
def test_links_do_not_depend_on_the_grid(small, grid, monkeypatch):
    spark, _ = small
    monkeypatch.setattr(lattice, "PAIRS", 64)
    rng = np.random.default_rng(14)
    x = np.concatenate([clusters(rng, [90, 7, 3, 3], noise=0.015), rng.standard_normal((100, 64))])
    ids = rng.permutation(len(x)) + 3
    want = linked(ids, x)
    got = components_of(lattice.similar_vectors(frame(spark, ids, x), "vec_id", "embedding", grid=grid))
    assert [got[i][1] for i in sorted(want)] == [want[i][1] for i in sorted(want)]
    assert sum(abs(got[i][0] - want[i][0]) for i in want) <= 0.002 * sum(n for n, _ in want.values())


def test_odd_vectors(small):
    spark, _ = small
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []),
            (9, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e300, 1e290]), (12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "cell": F.lit(2), "n_links": F.lit(3)})
    got = sorted(lattice.similar_vectors(df, "vec_id", "embedding").collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *[(i, 0, i, True) for i in range(3, 10)],
        (10, 3, 1, False), (11, 3, 1, False), (12, 0, 12, True), (None, 0, None, False)]
    near = multi_index.nearest(df, "vec_id", "embedding", F.col("vec_id").isin(1, 3, 9), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in near] == [(1, 1, 2), (1, 2, 10), (1, 3, 12)]
    assert multi_index.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).collect() == []
    assert lattice.similar_vectors(df.limit(0), "vec_id", "embedding").collect() == []


def brute(ids, x, queries, k):
    found = {}
    for i in np.flatnonzero(np.isin(ids, queries)):
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, gap)) if ids[j] != ids[i]][:k]
        found[int(ids[i])] = [(int(ids[j]), gap[j]) for j in order]
    return found


def test_search_with_all_cells_is_exact(small):
    spark, sf_dir = small
    ids, x = given(f"{sf_dir}/embeddings.parquet")
    want = brute(ids, x, ids[ids % 100 == 0], 10)
    got = {}
    for r in QUERIES["op2_multi_index"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-12)))
    assert got == want


def test_recall_of_a_partial_search_and_ties_in_many_blocks(small, monkeypatch):
    spark, _ = small
    monkeypatch.setattr(multi_index, "BLOCK_ENTRIES", 256)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(9)
    x = np.concatenate([clusters(rng, [60] * 40, dim=32, noise=0.1), np.repeat(rng.standard_normal((1, 32)), 500, 0)])
    ids = rng.permutation(len(x))
    queries = [int(i) for i in ids if i % 50 == 0]
    want = brute(ids, x, queries, 10)
    df = frame(spark, ids, x)
    got = {}
    for r in multi_index.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, share=0.2, least=100, centroids=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(queries) and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.95 * 10 * len(queries)


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_cells_are_visited_by_rising_distance(tile):
    rng = np.random.default_rng(3)
    d1, d2 = rng.random(12), rng.random(9)
    counts = rng.integers(0, 3, 108)
    visited, last = multi_index.traverse(d1, d2, counts, 10**6, tile)
    sums = [d1[c // 9] + d2[c % 9] for c in visited]
    assert sums == sorted(sums) and sorted(visited) == np.flatnonzero(counts).tolist() and last == sums[-1]
    for wanted in (1, 20, 60):
        part, last = multi_index.traverse(d1, d2, counts, wanted, tile)
        assert part.tolist() == visited[:len(part)].tolist() and wanted <= counts[part].sum() < wanted + 3 and last == sums[len(part) - 1]
    assert len(multi_index.traverse(d1, d2, counts * 0, 5, tile)[0]) == 0


def lists(rows):
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_every_query_gets_its_neighbours_whatever_is_repeated(small, monkeypatch):
    """A third of the rows on one id, as copies and as different vectors, that is a query itself; the given parameters."""
    spark, _ = small
    monkeypatch.setattr(multi_index, "BLOCK_ENTRIES", 128)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 64)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1200, 16))
    ids = np.arange(1200)
    copies = np.repeat(x[100:101], 900, 0)
    many = np.concatenate([x, copies, x[100] + 0.01 * rng.standard_normal((60, 16)), x[:40], x[200:201]])
    names = np.concatenate([ids, np.full(900, 100), np.full(60, 300), np.arange(2000, 2040), [100]])
    df = frame(spark, names, many).repartition(6)
    got = lists(multi_index.nearest(df, "vec_id", "embedding", F.col("vec_id").isin(100, 200, 500), least=10))
    rows = {(int(i), tuple(v)) for i, v in zip(names, many)}
    distinct = np.array([v for _, v in sorted(rows)])
    of = np.array([i for i, _ in sorted(rows)])
    assert {q: len(v) for q, v in got.items()} == {100: 20, 200: 10, 500: 10}
    assert all(i != q for q, v in got.items() for i, _ in v)
    near = sorted(s for i, s in zip(of, np.sqrt(((distinct - x[100]) ** 2).sum(1))) if i != 100)[:10]
    assert [s for _, s in got[100]][:10] != [] and set(np.round(near, 9)) <= set(np.round([s for _, s in got[100]], 9))
    few = lists(multi_index.nearest(df.filter("vec_id in (100, 300)"), "vec_id", "embedding", F.col("vec_id") == 100))
    assert len(few[100]) == 20 and {i for i, _ in few[100]} == {300}


def test_distances_beyond_the_range_of_squares(small):
    spark, _ = small
    big = [[3e200, 0.0], [0.0, 4e200], [1e-200, 0.0], [0.0, 1e-200], [1.0, 1.0]]
    got = lists(multi_index.nearest(frame(spark, range(5), big), "vec_id", "embedding", F.lit(True)))
    assert got[0][-1] == (1, pytest.approx(5e200, rel=1e-12)) and got[2][0] == (3, pytest.approx(2**0.5 * 1e-200, rel=1e-12))
    assert all(len(v) == 4 and np.isfinite([s for _, s in v]).all() for v in got.values())


def test_recall_at_the_given_parameters(small):
    """Vectors that fill the sphere evenly, the hardest case; a query looks at 35 % of the rows."""
    spark, _ = small
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(8000)
    want = brute(ids, x, ids[ids % 100 == 0], 10)
    got = lists(multi_index.nearest(frame(spark, ids, x), "vec_id", "embedding", F.col("vec_id") % 100 == 0))
    assert all(len(got[q]) == 10 for q in want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_components_of_random_graphs(small):
    spark, _ = small
    rng = np.random.default_rng(8)
    path = [(i, i + 1) for i in range(300)]
    links = [*path, *itertools.islice(((int(a), int(b)) for a, b in rng.integers(1000, 1400, (10**4, 2))), 250), (5000, 5000), (None, 3)]
    names = {n: n for link in links if None not in link for n in link}
    for _ in range(400):
        for a, b in links:
            if a is not None:
                names[a] = names[b] = min(names[a], names[b])
    order = rng.permutation(len(links))
    df = spark.createDataFrame([links[i][::-1] if i % 2 else links[i] for i in order], "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == names
    assert components(df.limit(0)).collect() == []
