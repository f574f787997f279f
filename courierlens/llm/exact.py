"""Exact duplicates by Patricia tries whose terminal nodes own their copies.

Every task first puts its own texts into a trie and sends each distinct one on once, with its
best owner so far and the number of copies, so a text that fills the table is a row per task.
These are partitioned by length and content hash, and each partition inserts the full byte
strings into one trie. A trie that outgrows its budget gives a subtree away: those strings are
dealt anew over more partitions, round by round, until every string has an owner.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.shared import saved
from courierlens.llm.trie import Trie

#: Bytes that a trie may take in a task, and bytes of strings meant for a partition.
TRIE_BYTES, PART_BYTES = 128 << 20, 64 << 20
#: Rows and bytes of a batch that a task gives out.
OUT_ROWS, OUT_BYTES = 1000, 1 << 20

_TERMINALS = "length long, digest binary, owner long, owner_row long, copies long, text binary"
_ENTRIES = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("owner", pa.int64()), ("owner_row", pa.int64()),
                      ("copies", pa.int64()), ("text", pa.binary())])
_MEMBERS = pa.schema([("key", pa.int64()), ("row", pa.int64()), *_ENTRIES])


def _rank(key: int | None, row: int, largest: bool) -> tuple:
    """Owners by key, smallest or largest first, rows without key last, then by row."""
    return (1, 0, row) if key is None else (0, -key if largest else key, row)


def _owner(rank: tuple, largest: bool) -> int | None:
    return None if rank[0] else -rank[1] if largest else rank[1]


def _batches(entries: Iterator[tuple[bytes | None, list]], largest: bool) -> Iterator[dict[str, list]]:
    """Terminals as columns, a bounded number of bytes at a time."""
    columns: dict[str, list] = {name: [] for name in _ENTRIES.names}
    size = 0
    for text, (rank, copies, (length, digest)) in entries:
        for name, value in zip(columns, (length, digest, _owner(rank, largest), rank[2], copies, text)):
            columns[name].append(value)
        size += len(text or b"")
        if len(columns["length"]) >= OUT_ROWS or size >= OUT_BYTES:
            yield columns
            columns, size = {name: [] for name in columns}, 0
    if columns["length"]:
        yield columns


def _local(df: DataFrame, largest: bool, budget: int) -> DataFrame:
    """From (key, row, text): a row (key, row, length, digest) for each, and rows with the distinct texts of each task."""

    def terminals(trie: Trie) -> Iterator[pa.RecordBatch]:
        for columns in _batches(trie.terminals(), largest):
            none = [None] * len(columns["length"])
            yield pa.RecordBatch.from_pydict({"key": none, "row": none, **columns}, _MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths, digests = [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                digest = hashlib.sha256(text).digest()
                lengths.append(len(text))
                digests.append(digest)
                trie.insert(text, _rank(keys[at], rows[at], largest), 1, (len(text), digest))
                if trie.held > budget:
                    yield from terminals(trie)
                    trie = Trie()
            none = [None] * len(keys)
            yield pa.RecordBatch.from_pydict({"key": keys, "row": rows, "length": lengths, "digest": digests, "owner": none,
                                              "owner_row": none, "copies": none, "text": none}, _MEMBERS)
        yield from terminals(trie)

    return df.mapInArrow(run, f"key long, row long, {_TERMINALS}")


def _unlike(trie: Trie) -> Iterator[tuple[None, list]]:
    """A trie's terminals without their strings, none of which may share a digest."""
    seen = set()
    for entry in trie.entries():
        digest = entry[2][1]
        if digest in seen:
            raise ValueError(f"different texts with the SHA-256 {digest.hex()}")
        seen.add(digest)
        yield None, entry


def _owners(df: DataFrame, largest: bool, budget: int) -> DataFrame:
    """One trie per task over its terminals: those that stay without their text, those of subtrees given away with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def out(entries: Iterator[tuple[bytes | None, list]]) -> Iterator[pa.RecordBatch]:
            for columns in _batches(entries, largest):
                yield pa.RecordBatch.from_pydict(columns, _ENTRIES)

        for batch in batches:
            refused = []
            lengths, digests, owners, rows, copies = (batch.column(i).to_pylist() for i in range(5))
            for at, text in enumerate(batch.column(5).to_pylist()):
                mark = (lengths[at], digests[at])
                rank = _rank(owners[at], rows[at], largest)
                if not trie.insert(text, rank, copies[at], mark):
                    refused.append((text, [rank, copies[at], mark]))
                while trie.held > budget and (taken := trie.take_largest()) is not None:
                    yield from out(taken)
            yield from out(iter(refused))
        yield from out(_unlike(trie))

    return df.mapInArrow(run, _TERMINALS)


def exact_owners(df: DataFrame, key: str, text: str, keep: str = "smallest", trie_bytes: int = TRIE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``df``: ``key``, keep_id, group_size, kept, n_bytes, text_sha256.

    Texts are equal if all of their bytes are; a null text is an empty one. Of equal texts the row
    with the smallest (or ``keep="largest"``) key stays: keep_id is its key, group_size the number
    of rows of that text, kept true for exactly one row. Rows without key stay only where no equal
    text has one; of rows that repeat the key as well, one stays. Keys must be whole numbers. Texts
    of any length are read whole. Other columns are not read. An empty table gives none.

    Rows find their text's terminal by its length and SHA-256. A trie compares all bytes, and two
    texts with the same SHA-256 raise an error instead of sharing an owner.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    largest = keep == "largest"
    rows = df.select(df[key].cast("long").alias("key"), F.monotonically_increasing_id().alias("row"),
                     F.coalesce(df[text].cast("string").cast("binary"), F.lit(b"")).alias("text"))
    found = saved(_local(rows, largest, trie_bytes), "exact-texts")
    left, rounds, closed = found.filter("row is null").drop("key", "row"), 0, None
    while True:
        total = left.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
        if rounds and not total["rows"]:
            break
        parts = max(1, math.ceil((total["bytes"] or 0) / part_bytes), math.ceil(total["rows"] / 500_000))
        # Another round deals the strings anew, for its number is part of the hash.
        dealt = left.repartition(parts, "length", "digest", F.lit(rounds))
        done = saved(_owners(dealt, largest, trie_bytes), "exact-owners")
        owners = done.filter("text is null").drop("text")
        closed = owners if closed is None else closed.unionByName(owners)
        left, rounds = done.filter("text is not null"), rounds + 1

    owners = closed.select(F.col("length").alias("_length"), F.col("digest").alias("_digest"), F.col("owner").alias("keep_id"),
                           F.col("owner_row").alias("_row"), F.col("copies").alias("group_size"))
    members = found.filter("row is not null").select("key", "row", "length", "digest")
    joined = members.join(owners, (F.col("length") == F.col("_length")) & (F.col("digest") == F.col("_digest")))
    return joined.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"),
                         F.col("length").alias("n_bytes"), F.lower(F.hex("digest")).alias("text_sha256"))
