"""Near-duplicate texts by MinHash sketches, banding and exact verification.

Documents are sets of word shingles. Equal sets form a class, which is one node however many rows
hold it; nodes are numbered in the order of their smallest key. Nodes are sketched; those that
agree in all coordinates of a band share a bucket. Within buckets sketches are compared, and pairs
that may be similar enough are confirmed on their full sets. Since only connectedness is asked
for, this is done in two rounds: every node is first confirmed with the partner that its sketch
resembles most; then the pairs that the first round has not connected are confirmed within their
blocks, so that a large group of copies that just miss the threshold leaves no pairs behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from courierlens.llm.blocks import BLOCK_ROWS, blocks, compared, local_roots
from courierlens.llm.components import components
from courierlens.llm.shared import saved
from courierlens.llm.sketch import sketch
from courierlens.llm.words import shingle_sets, sliced

#: Bands and coordinates per band: of pairs with similarity 0.8 all but 6 in 100,000 share a bucket.
BANDS, BAND_ROWS = 32, 6
#: Sketches that agree less than the threshold by so many standard deviations are not confirmed.
DEVIATIONS = 5.0
#: Keys that may be broadcast (16 MB); beyond that they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def set_digests(sets: list[np.ndarray]) -> pa.Array:
    """A digest of each whole set, null for an empty one."""
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def sketched(df: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """Per row of (key, text): key, n_shingles, set_key (a digest of the whole set), coordinates."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, behind, texts in sliced(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, behind - first), pa.array([len(s) for s in sets], pa.int64()),
                    set_digests(sets),
                    pa.array([sketch(s, coordinates).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["key", "n_shingles", "set_key", "coordinates"])

    return df.mapInArrow(run, f"key {kind}, n_shingles long, set_key binary, coordinates binary")


def full_sets(df: DataFrame, shingle: int) -> DataFrame:
    """Per row of (key, text): key, set_key and its set as sorted 64-bit hashes."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, behind, texts in sliced(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, shingle)
                data = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, behind - first), set_digests(sets), data], ["key", "set_key", "hashes"])

    return df.mapInArrow(run, f"key {kind}, set_key binary, hashes binary")


def with_set_keys(df: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """``df`` with the digest of each text's whole set, null for one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for first, behind, texts in sliced(batch.column(place).to_pylist()):
                part = batch.slice(first, behind - first)
                yield pa.RecordBatch.from_arrays([*part.columns, set_digests(shingle_sets(texts, shingle))], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def _numbered(classes: DataFrame) -> DataFrame:
    """Adds node to rows of (key, set_key): a number of its own for each, in their order."""
    order = ["key", "set_key"]
    return saved(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")


def _sets_of(rows: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes), once per node of ``chosen`` (key, set_key, node), from rows of (key, text)."""
    whole = full_sets(rows_of(rows, saved(chosen.select("key").distinct(), "candidates")), shingle)
    found = saved(whole.join(chosen, ["key", "set_key"]).select("node", "hashes"), "sets")
    # Rows that repeat a key and its set; the partial aggregate leaves one of them per task.
    repeated = found.count() > chosen.count()
    return saved(found.distinct(), "sets") if repeated else found


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for of_a, of_b in zip(batch.column(2), batch.column(3)):
                one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (of_a, of_b))
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def rows_of(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` (key, ...) whose key is among ``keys`` (distinct). Few keys are broadcast, more are not."""
    few = keys.count() <= MOST_BROADCAST
    return df.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements a sorted set shares with each of some other non-empty sets."""
    joined = np.concatenate(others)
    at = np.searchsorted(one, joined)
    at[at == len(one)] = 0
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat((one[at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)


class _Block:
    """The members of a bucket, and which pairs of them have sizes and sketches that allow the threshold."""

    def __init__(self, rows: pa.Table, across: bool, percent: int):
        coordinates, share = BANDS * BAND_ROWS, percent / 100
        self.rows, self._across, self._percent = rows, across, percent
        self.node, self.n, self._part = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "slice"))
        self._own = np.frombuffer(b"".join(rows.column("coordinates").to_pylist()), np.uint16).reshape(len(self.node), coordinates)
        self._least = coordinates * share - DEVIATIONS * (coordinates * share * (1 - share)) ** 0.5

    def agreement(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some rows at a time: which, and in how many coordinates they agree with each row; -1 where that is too few."""
        node, n = self.node, self.n
        for at in range(0, len(node), 32):
            some = np.arange(at, min(at + 32, len(node)))
            agree = (self._own[some][:, None, :] == self._own[None, :, :]).sum(2)
            small, large = np.minimum(n[some][:, None], n), np.maximum(n[some][:, None], n)
            possible = (node[some][:, None] != node) & (100 * small >= self._percent * large) & (agree >= self._least)
            if self._across:
                possible &= self._part[some][:, None] != self._part
            yield some, np.where(possible, agree, -1)

    def open_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Possible pairs of different components that meet in no earlier band."""
        name, band = self.rows.column("component").to_numpy(), self.rows.column("band")[0].as_py()
        found = [(np.empty(0, np.int64),) * 2]
        for some, agree in self.agreement():
            a, b = np.nonzero((agree >= 0) & (name[some][:, None] != name) & (some[:, None] < np.arange(len(name))))
            a = some[a]
            mine = (self._own[a] == self._own[b]).reshape(len(a), BANDS, BAND_ROWS).all(2).argmax(1) == band
            found.append((a[mine], b[mine]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return a, b


def _best_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each node and the possible partner in each of its blocks that its sketch resembles most."""

    def compare(table: pa.Table, across: bool) -> list[np.ndarray] | None:
        block, found = _Block(table, across, percent), []
        for some, agree in block.agreement():
            partner = agree.argmax(1)
            has = agree[np.arange(len(some)), partner] >= 0
            found.append((block.node[some[has]], block.node[partner[has]]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return [np.minimum(a, b), np.maximum(a, b)]

    return compared(rows, ["bucket"], "node", compare, ["a", "b"]).distinct()


def _still_open(rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, node) of the nodes with possible pairs that are not connected yet."""

    def compare(table: pa.Table, across: bool) -> list[np.ndarray] | None:
        block = _Block(table, across, percent)
        some = np.unique(np.concatenate(block.open_pairs()))
        return [np.full(len(some), table.column("bucket")[0].as_py()), block.node[some]]

    return compared(rows, ["bucket"], "node", compare, ["bucket", "node"]).distinct()


def _links_within(rows: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs that are not connected yet, by their full sets: (a, b) from each node to one it is linked with."""

    def compare(table: pa.Table, across: bool) -> list[np.ndarray] | None:
        block = _Block(table, across, percent)
        a, b = block.open_pairs()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        linked = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
            both = overlaps(sets[a[some[0]]], [sets[i] for i in b[some]])
            linked[some] = 100 * both >= percent * (block.n[a[some]] + block.n[b[some]] - both)
        root = local_roots(len(block.node), a[linked], b[linked])
        some = np.flatnonzero(root != np.arange(len(root)))
        return [block.node[root[some]], block.node[some]]

    return compared(rows, ["bucket"], "node", compare, ["a", "b"])


def similar_texts(df: DataFrame, key: str, text: str, shingle: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``df``: ``key``, n_shingles, component_id, kept.

    Words are runs other than ASCII white space with A-Z in lower case. A document's set has its
    distinct runs of ``shingle`` words; with fewer words the whole sequence is the one element, and
    without words the set is empty and linked with nothing. Documents are linked if 100 *
    intersection >= percent * union. component_id is the smallest key reachable by links, itself
    included; kept says that it is the row's own. Keys must be whole numbers. A row without key is
    linked with nothing, has no component and is kept. Rows that repeat a key are each judged by
    their own text. Whole texts count, however long. Other columns are not read.

    Equal sets are reduced to one node with partial aggregates before anything is compared, so
    rows that repeat a document are one node, too. Buckets larger than ``block_rows`` are compared
    in slices, and what leaves a bucket is one row per document in either round.
    """
    return judged(df, key, text, shingle, percent, block_rows).drop("set_key", "first")


def judged(df: DataFrame, key: str, text: str, shingle: int, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of ``similar_texts``, set_key, and first: whether the row holds its component's first set and key.

    Of a component's sets that belong to its smallest key, the one with the smallest digest is first.
    Rows that are linked with nothing for want of a key or of words are first.
    """
    coordinates = BANDS * BAND_ROWS
    rows = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    found = saved(sketched(rows, shingle, coordinates), "sketches")
    usable = found.filter("key is not null and n_shingles > 0")
    classes = _numbered(usable.groupBy("set_key").agg(F.min("key").alias("key")))
    # Equal rows have equal sketches, so one of them is left per task before the join.
    nodes = saved(usable.distinct().join(classes, ["set_key", "key"]).select("node", "n_shingles", "coordinates"), "nodes")

    width = 2 * BAND_ROWS
    buckets = F.array(*[F.xxhash64(F.substring("coordinates", i * width + 1, width), F.lit(i)) for i in range(BANDS)])
    each = nodes.select("node", F.posexplode(buckets).alias("band", "bucket"))
    held = [F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("held")]
    shared = saved(each.groupBy("bucket").agg(*held).filter("a < b"), "buckets")
    # A bucket of two is a pair. Those of more are compared.
    two = shared.filter("held = 2").select("a", "b").distinct()
    more = saved(each.join(shared.filter("held > 2").select("bucket"), "bucket"), "bucket-members")
    members = blocks(more, shared.filter("held > 2"), ["bucket"], "node", block_rows)

    among = more.select("node").union(two.select("a")).union(two.select("b")).distinct()
    chosen = saved(classes.join(among, "node"), "candidate-classes")
    sets = _sets_of(rows, chosen, shingle)
    compact = saved(rows_of(nodes.withColumnRenamed("node", "key"), chosen.select(F.col("node").alias("key"))).withColumnRenamed("key", "node"), "candidate-sketches")

    first = saved(_best_pairs(members.join(compact, "node"), percent).union(two).distinct(), "pairs")
    links = saved(confirmed(first, sets, percent), "text-links")
    names = components(links).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    named = saved(compact.join(names, F.col("node") == F.col("_node"), "left")
                  .select(*compact.columns, F.coalesce("_component", "node").alias("component")), "named-sketches")
    still = saved(_still_open(members.join(named, "node"), percent), "open-members")
    # Blocks that hold full sets count a member once per thousand elements.
    weights = still.join(named.select("node", "n_shingles"), "node").groupBy("bucket").agg(
        F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_shingles") / 1000)).alias("held"))
    again = blocks(more.join(still, ["bucket", "node"], "left_semi"), saved(weights, "open-buckets"), ["bucket"], "node", block_rows)
    whole = again.join(named, "node").join(sets.select(F.col("node").alias("_node"), "hashes"), F.col("node") == F.col("_node")).drop("_node")
    more_links = saved(_links_within(whole, percent), "text-links")
    names = components(links.union(more_links)).select(F.col("node").alias("_node"), "component")

    roots = classes.select(F.col("node").alias("_root"), F.col("key").alias("_name"))
    named = (classes.join(names, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
             .join(roots, F.col("component") == F.col("_root"))
             .select(F.col("set_key").alias("_set"), "_name", (F.col("component") == F.col("node")).alias("_is_root")))
    joined = found.join(named, F.col("key").isNotNull() & (F.col("set_key") == F.col("_set")), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("_name", "key"))
    kept = F.coalesce(component == F.col("key"), F.lit(True))
    return joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"), "set_key",
                         (kept & F.coalesce("_is_root", F.lit(True))).alias("first"))
