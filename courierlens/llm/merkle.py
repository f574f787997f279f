"""A Merkle manifest of a data set as an append log of nodes in postorder.

Rows become leaves, the leaves of a group in their order a tree, and the roots of all groups,
in their order, the tree above. While a level has several nodes, every ``ARITY`` consecutive
ones (the last run may be shorter) are hashed into one above. A tree's log lists its nodes in
the order in which they are complete, so a node's place follows from the number of leaves alone:

    place(level, index) = sum over j of floor((last leaf) / ARITY**j) + level

for a complete node, as all nodes complete before its last leaf lie ahead of it, and the
incomplete ones on the right edge follow at the end, the lowest first. Builders are aligned: each
takes ``ARITY**height`` neighbouring leaves, which make a subtree whose places it knows without
the others. The subtrees' roots are the next builders' leaves. Proofs are read from the log by
the siblings' places.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.llm.shared import global_rank, running_total, saved

#: Children of a node, and levels that a builder adds (2,187 leaves each).
ARITY, BUILDER_LEVELS = 3, 7
#: Rows that a task gets together.
TASK_ROWS = 16384

_NODE = "tree long, n long, tier int, block long, level int, index long, place long, digest binary"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256, in hexadecimal, over all fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def node_digest(parts: Sequence[str]) -> str:
    """The digest of the concatenation of digests in hexadecimal."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def place(level: np.ndarray | int, index: np.ndarray, n: int) -> np.ndarray:
    """Places (from 0) in the log of a tree with ``n`` leaves of the nodes at ``level`` with these indexes."""
    level, index = np.broadcast_arrays(np.asarray(level, np.int64), np.asarray(index, np.int64))
    behind = (index + 1) * ARITY ** level
    complete = behind <= n
    last = np.where(complete, behind - 1, n)
    before, power = np.zeros(last.shape, np.int64), 1
    while power <= n:
        before += last // power
        power *= ARITY
    # On the right edge the levels from the first one that n does not fill follow each other.
    first = 0
    while n % ARITY ** first == 0 and ARITY ** first <= n:
        first += 1
    return before + np.where(complete, level, level - first)


def append(digests: Sequence[str], at: int, levels: int, first: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of an aligned builder's nodes in the order in which they are complete.

    ``digests`` are the nodes from index ``first`` on at level ``at``; ``levels`` are added.
    """
    pending: list[list[str]] = [[] for _ in range(levels + 1)]
    taken = [first // ARITY ** j for j in range(levels + 1)]

    def done(step: int, digest: str) -> tuple[int, int, str]:
        pending[step].append(digest)
        taken[step] += 1
        return at + step, taken[step] - 1, digest

    for digest in digests:
        step = 0
        yield done(0, digest)
        while step < levels and len(pending[step]) == ARITY:
            above = node_digest(pending[step])
            pending[step], step = [], step + 1
            yield done(step, above)
    for step in range(levels):
        if pending[step]:
            yield done(step + 1, node_digest(pending[step]))


def _work(df: DataFrame, rows: int) -> DataFrame:
    """Adds work: blocks of equal work go to one task, about TASK_ROWS rows."""
    return df.withColumn("work", F.pmod(F.xxhash64("tree", "block"), F.lit(max(1, math.ceil(rows / TASK_ROWS)))))


def _runs(tree: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and behind the last of the neighbouring rows with the same tree and block."""
    starts = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1]))) if len(tree) else []
    yield from zip(starts, [*starts[1:], len(tree)])


def build_log(leaves: DataFrame, levels: int = BUILDER_LEVELS) -> list[DataFrame]:
    """The logs of all trees from (tree, n, index, digest), one table per tier of builders.

    Rows: tree, n (its leaves), tier, block (the builder), level, index, place in the tree's log, digest. A node
    that is the root of a builder's subtree and a leaf of the next tier's is listed once, by the former.
    """
    width = ARITY ** levels

    def builder(tier: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("tree", "ascending"), ("index", "ascending")]).combine_chunks()
            tree, n, index = (table.column(c).to_numpy() for c in ("tree", "n", "index"))
            digest, found = table.column("digest").to_pylist(), []
            for start, end in _runs(tree, index // width):
                count, first = int(n[start]), int(index[start])
                above = min(levels, height(count) - tier * levels)
                nodes = list(append([d.hex() for d in digest[start:end]], tier * levels, above, first))
                level, number = (np.array([node[i] for node in nodes], np.int64) for i in (0, 1))
                new = slice(None) if tier == 0 else level > tier * levels
                size = len(level[new])
                found.append((np.full(size, tree[start]), np.full(size, count), np.full(size, first // width), level[new], number[new],
                              place(level, number, count)[new], [bytes.fromhex(node[2]) for node in nodes if tier == 0 or node[0] > tier * levels]))
            columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(6)]
            rows = [d for f in found for d in f[6]]
            return pa.table({"tree": pa.array(columns[0]), "n": pa.array(columns[1]), "tier": pa.array(np.full(len(rows), tier, np.int32)),
                             "block": pa.array(columns[2]), "level": pa.array(columns[3].astype(np.int32)), "index": pa.array(columns[4]),
                             "place": pa.array(columns[5]), "digest": pa.array(rows, pa.binary())})
        return run

    tiers: list[DataFrame] = []
    while True:
        tier = len(tiers)
        size = leaves.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).first()
        given = _work(leaves.withColumn("block", F.floor(F.col("index") / width)), size["rows"])
        tiers.append(saved(given.groupBy("work").applyInArrow(builder(tier), _NODE), "merkle-log"))
        if not size["n"] or height(size["n"]) <= (tier + 1) * levels:
            return tiers
        # Trees that have one node left are complete.
        top = (tier + 1) * levels
        leaves = tiers[-1].filter((F.col("level") == top) & (F.col("n") > ARITY ** top)).select("tree", "n", "index", "digest")


def roots(tiers: Sequence[DataFrame]) -> DataFrame:
    """(tree, n, digest) of every tree's root, which is the last row of its log."""
    tops = [F.lit(False)]
    for levels in range(40):
        least = 0 if levels == 0 else ARITY ** (levels - 1)
        tops.append((F.col("level") == levels) & (F.col("n") > least) & (F.col("n") <= ARITY ** levels))
    is_root = tops[0]
    for top in tops[1:]:
        is_root = is_root | top
    found = [t.filter(is_root & (F.col("index") == 0)).select("tree", "n", "digest") for t in tiers]
    return _union(found)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found


def _siblings(index: np.ndarray, at: int, levels: int, n: int, places: np.ndarray, digests: list[str]) -> list[list[str]]:
    """For each node at level ``at``: per level the digests left and right of its ancestor, read by their places."""
    paths: list[list[str]] = [[] for _ in index]
    for level in range(at, at + levels):
        width = -(-n // ARITY ** level)
        mine = index // ARITY ** (level - at)
        first = mine // ARITY * ARITY
        sides = [[""] * len(index), [""] * len(index)]
        for step in range(ARITY):
            other = first + step
            has = np.flatnonzero((other != mine) & (other < width))
            rows = np.searchsorted(places, place(level, other[has], n))
            for i, row, right in zip(has.tolist(), rows.tolist(), (other[has] > mine[has]).tolist()):
                sides[right][i] += digests[row]
        for path, left, right in zip(paths, *sides):
            path += (left, right)
    return paths


def fold(digest: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path (digests to the left and right, level by level) lead to."""
    for left, right in zip(path[::2], path[1::2]):
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def _paths(nodes: DataFrame, uppers: DataFrame, tier: int, levels: int, asks: DataFrame | None, rows: int) -> DataFrame:
    """Paths of the leaves of one tier's builders, or with ``asks`` the proofs of the rows asked for.

    ``nodes`` are the blocks' nodes, their leaves included; ``uppers`` (tree, index, path, subroot, root) are
    the paths of the blocks' own roots. The builder's block is read as one slice of the log, in order of place.
    """
    at, width = tier * levels, ARITY ** levels
    none = [F.lit(None).cast(t).alias(c) for c, t in (("path", "array<string>"), ("subroot", "string"), ("root", "string"))]
    left = nodes.select("tree", "n", "block", "level", "index", "place", F.lower(F.hex("digest")).alias("digest"), *none).unionByName(
        uppers.select("tree", F.lit(0).cast("long").alias("n"), F.col("index").alias("block"), F.lit(-1).alias("level"), "index",
                      F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), "path", "subroot", "root"))
    left = _work(left, rows)

    def blocks(table: pa.Table) -> dict[tuple[int, int], tuple]:
        table = table.sort_by([("tree", "ascending"), ("block", "ascending"), ("place", "ascending")]).combine_chunks()
        tree, n, block, level, index, places = (table.column(c).to_numpy() for c in ("tree", "n", "block", "level", "index", "place"))
        digest, path, subroot, root = (table.column(c) for c in ("digest", "path", "subroot", "root"))
        found = {}
        for start, end in _runs(tree, block):
            # The block's own path has the place -1, so it comes first.
            upper = (path[start].as_py(), subroot[start].as_py(), root[start].as_py())
            inner = slice(start + 1, end)
            count = int(n[start + 1])
            found[int(tree[start]), int(block[start])] = (
                count, min(levels, height(count) - at), level[inner], index[inner], places[inner], digest.slice(start + 1, end - start - 1).to_pylist(), upper)
        return found

    if asks is None:
        def whole(table: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("tree", "index", "path", "subroot", "root")}
            for (tree, _), (n, above, level, index, places, digests, (path, subroot, root)) in blocks(table).items():
                mine = np.sort(index[level == at])
                for i, lower in zip(mine.tolist(), _siblings(mine, at, above, n, places, digests)):
                    for name, value in zip(out, (tree, i, lower + path, subroot, root)):
                        out[name].append(value)
            return pa.table(out, schema=pa.schema([("tree", pa.int64()), ("index", pa.int64()), ("path", pa.list_(pa.string())),
                                                   ("subroot", pa.string()), ("root", pa.string())]))

        return saved(left.groupBy("work").applyInArrow(whole, "tree long, index long, path array<string>, subroot string, root string"), "merkle-paths")

    asked = _work(asks.withColumn("block", F.floor(F.col("index") / width)), rows)
    names = ("subroot", "root", "proof_sha256", "folded_root")

    def proven(key: tuple, slices: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("block", "ascending")]).combine_chunks()
        tree, block, index = (table.column(c).to_numpy() for c in ("tree", "block", "index"))
        shown, held = table.column("shown").to_pylist(), blocks(slices)
        out: dict[str, list] = {c: [] for c in names}
        for start, end in _runs(tree, block):
            n, above, _, _, places, digests, (path, subroot, root) = held[int(tree[start]), int(block[start])]
            rest = "".join(path)
            for leaf, lower in zip(shown[start:end], _siblings(index[start:end], at, above, n, places, digests)):
                proof = hashlib.sha256(("".join(lower) + rest).encode()).hexdigest()
                for name, value in zip(names, (subroot, root, proof, fold(fold(leaf, lower), path))):
                    out[name].append(value)
        found = table.drop_columns(["block", "work"])
        for name in names:
            found = found.append_column(name, pa.array(out[name], pa.string()))
        return found

    kinds = ", ".join([f"`{c}` {kind}" for c, kind in asks.dtypes] + [f"{c} string" for c in names])
    return left.groupBy("work").cogroup(asked.groupBy("work")).applyInArrow(proven, kinds)


def _with_leaves(tiers: Sequence[DataFrame], tier: int, levels: int) -> DataFrame:
    """The nodes of a tier's blocks; above the first tier, the leaves of its builders are the roots of the tier below."""
    if tier == 0:
        return tiers[0]
    top, width = tier * levels, ARITY ** levels
    below = tiers[tier - 1].filter((F.col("level") == top) & (F.col("n") > ARITY ** top))
    return tiers[tier].unionByName(below.withColumn("tier", F.lit(tier)).withColumn("block", F.floor(F.col("index") / width)))


def _complete_at(levels: int, tier: int) -> Column:
    """Trees whose root is in this tier of builders."""
    enough = F.col("n") <= ARITY ** ((tier + 1) * levels)
    return enough & (F.col("n") > ARITY ** (tier * levels)) if tier else enough


@dataclass(frozen=True)
class Manifest:
    """A data set's leaves and the logs of its trees.

    ``leaves``: tree, n, index, digest, and the columns named to ``manifest``. ``trees``: tree, group, n.
    ``logs``: the groups' trees; ``top``: the tree of their roots, with the number of the group as index.
    """

    leaves: DataFrame
    trees: DataFrame
    logs: tuple[DataFrame, ...]
    top: tuple[DataFrame, ...]
    levels: int


def manifest(rows: DataFrame, group: str, order: str, leaf: str, levels: int = BUILDER_LEVELS) -> Manifest:
    """The manifest of ``rows`` (group, order, leaf in hexadecimal, and any others, which stay with the leaves).

    A group's leaves ascend by ``order``, nulls first, equal ones by their digest and then as they
    lie in the table; groups ascend bytewise, null first. Rows are range-partitioned, so a group of
    any size is dealt over many tasks, and one group's rows are counted before they are numbered.
    """
    given = [c for c in rows.columns if c != leaf]
    keys = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("_leaf"), F.col("_row")]
    plain = saved(rows.withColumnRenamed(leaf, "_leaf").withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    ranked = saved(global_rank(plain, keys, "_place").withColumn("_part", F.spark_partition_id()), "merkle-ranks")
    sizes = saved(ranked.groupBy(group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    trees = saved(global_rank(sizes, [F.col(group).asc_nulls_first()], "_number").select(
        F.col(group).alias("_group"), (F.col("_number") - 1).alias("tree"), "n", "_first"), "merkle-trees")
    # A group's row for each of its parts, so that rows of a large group need not meet in one task.
    parts = ranked.select("_part", group).distinct().join(trees, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col("_part").alias("_of"), "_group", "tree", "n", "_first")
    joined = ranked.join(parts, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    leaves = saved(joined.select(*given, "tree", "n", (F.col("_place") - F.col("_first")).alias("index"), F.unhex("_leaf").alias("digest")), "merkle-leaves")
    logs = build_log(leaves.select("tree", "n", "index", "digest"), levels)
    count = trees.count()
    subroots = roots(logs).select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("index"), "digest")
    top = build_log(saved(subroots, "merkle-subroots"), levels)
    return Manifest(leaves, trees.select("tree", F.col("_group").alias(group), "n"), tuple(logs), tuple(top), levels)


def proofs(held: Manifest, shown: DataFrame) -> DataFrame:
    """The rows of ``shown`` (tree, index, shown: a leaf in hexadecimal, and others) with subroot, root, proof_sha256, folded_root.

    A proof is the siblings' digests from the leaf's level up through the group's root to the
    root of all. folded_root is what the leaf that is shown leads to with it. Paths are read from
    the top down, each tier of builders adding its levels to those of the blocks below.
    """
    levels = held.levels
    root = roots(held.top).select(F.lower(F.hex("digest")).alias("root"))
    upper = root.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("index"), F.array().cast("array<string>").alias("path"),
                        F.lit(None).cast("string").alias("subroot"), "root")
    for tier in reversed(range(len(held.top))):
        nodes = _with_leaves(held.top, tier, levels)
        upper = _paths(nodes, upper, tier, levels, None, nodes.count())
    # The groups' trees are the leaves of the one above.
    subroots = roots(held.logs).select(F.col("tree").alias("_tree"), "n", F.lower(F.hex("digest")).alias("_digest"))
    tops = saved(upper.select(F.col("index").alias("_index"), "path", "root").join(subroots, F.col("_index") == F.col("_tree"))
                 .select(F.col("_tree").alias("tree"), "n", F.lit(0).cast("long").alias("index"), "path", F.col("_digest").alias("subroot"), "root"), "merkle-tops")
    below: DataFrame | None = None
    for tier in reversed(range(len(held.logs))):
        mine = tops.filter(_complete_at(levels, tier)).drop("n")
        upper = mine if below is None else mine.unionByName(below)
        nodes = _with_leaves(held.logs, tier, levels)
        below = _paths(nodes, upper, tier, levels, shown if tier == 0 else None, nodes.count())
    return below
