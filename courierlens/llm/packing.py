"""Best-fit packing into bins of several permitted lengths.

``pack_texts`` makes sequences of token ids: each task encodes its texts, packs a few thousand
pieces at a time and gives out whole sequences, so nothing is shuffled and a group is what a task
holds. ``pack_documents`` packs documents of any kind by their sizes: they are dealt at random
into groups of a few thousand pieces.

A group is packed by itself, longest pieces first. A piece goes into the open bin, of whatever
length, that it leaves with the least room. If none has room, a bin is opened whose length costs
least for the tokens it can be expected to hold: its cost divided by its length, or by what is
left to pack if that is less. When the group is packed, every bin is exchanged for the cheapest
permitted length that holds its contents.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.llm.pieces import PATTERN
from courierlens.llm.shared import saved

#: Pieces per group. Enough for bins to close with little room left; one group is one task's work at a time.
GROUP_PIECES = 4096
#: Equal pieces are dealt in slices of this part of a group.
SLICES = 16


def attention_cost(capacity: int, per_token: int = 4096, fixed: int = 64) -> float:
    """Cost of a sequence: a fixed part, a part per token and a part that grows with the square."""
    return fixed + capacity + capacity * capacity / per_token


def pack(sizes: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int]]:
    """Bin of each piece, and the final capacity of each bin. Bins are numbered as they are opened.

    Sizes must lie between 0 and the largest capacity. Pieces of equal size go in their order.
    """
    capacities = sorted(costs)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has room for r tokens
    room: list[int] = []
    used: list[int] = []
    bins = [0] * len(sizes)
    left = sum(sizes)
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            best = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[best].pop()
            if not open_by_room[best]:
                rooms &= ~(1 << best)
        else:
            permitted = [c for c in capacities if c >= size]
            best = min(permitted, key=lambda c: (costs[c] / max(min(c, left), 1), c))
            chosen = len(room)
            room.append(best)
            used.append(0)
        bins[i] = chosen
        room[chosen] -= size
        used[chosen] += size
        left -= size
        open_by_room.setdefault(room[chosen], []).append(chosen)
        rooms |= 1 << room[chosen]
    return bins, [min((c for c in capacities if c >= u), key=lambda c: (costs[c], c)) for u in used]


def pack_documents(df: DataFrame, key: str, size: Column, costs: Mapping[int, float], group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs all documents: ``key``, piece, start, size, pack_group, bin, capacity, used, offset.

    ``costs`` maps each permitted length to its cost. A document longer than the largest length is
    cut into pieces of that length and a rest, all of which are packed; one of size 0 (or null) is
    one empty piece. ``start`` is where the piece begins in its document, ``offset`` where it lies in
    its bin. Null keys and repeated rows are documents of their own. No documents, no bins.

    Groups are drawn by a hash of key, piece and size, so copies, a hot source or long documents
    spread over all of them; rows equal in all of these are counted by a partial aggregate and dealt
    in slices of a sixteenth of a group. A slice is one row until its group is packed. The number of groups grows with the number of pieces, so a group and
    the memory of its task do not. Only keys and sizes are shuffled, twice.
    """
    largest = max(costs)
    rows = df.select(df[key].alias("key"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    cut = F.greatest(F.ceil(F.col("total") / largest), F.lit(1))
    alike = saved(rows.groupBy("key", "total").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counted = alike.agg(F.sum(cut * F.col("n")).alias("n")).first()["n"] or 0
    groups, most = max(1, math.ceil(counted / group_pieces)), max(1, group_pieces // SLICES)
    slices = alike.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most) - 1)))
    pieces = slices.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    own = F.least(F.col("total") - F.col("piece") * largest, F.lit(largest))
    dealt = pieces.select("key", "piece", (F.col("piece") * largest).alias("start"), own.alias("size"),
                          F.pmod(F.xxhash64("key", "piece", "total", "slice"), F.lit(groups)).alias("pack_group"),
                          F.least(F.col("n") - F.col("slice") * most, F.lit(most)).alias("copies"))
    kind = df.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.loc[group.index.repeat(group.pop("copies"))]
        group = group.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = group["size"].tolist()
        bins, capacities = pack(sizes, costs)
        used = [0] * len(capacities)
        offset = []
        for b, s in zip(bins, sizes):
            offset.append(used[b])
            used[b] += s
        group["bin"], group["offset"] = bins, offset
        group["capacity"], group["used"] = [capacities[b] for b in bins], [used[b] for b in bins]
        return group

    packed = dealt.groupBy("pack_group").applyInPandas(
        run, f"key {kind}, piece long, start long, size long, pack_group long, bin long, offset long, capacity long, used long")
    return packed.withColumnRenamed("key", key)


_encodings: dict[str, Any] = {}


def encoding(path: str) -> Any:
    """The library's tokenizer for a file of base64 tokens and ranks, one per worker process. Without special tokens."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: Ids in a batch of sequences that a task gives out.
OUT_IDS = 1 << 19


def _packed(keys: list, ids: list[np.ndarray], costs: Mapping[int, float], key_type: pa.DataType, number: int) -> Iterator[pa.RecordBatch]:
    """The sequences of one group of documents."""
    largest = max(costs)
    cuts = [(d, at) for d, x in enumerate(ids) for at in range(0, max(len(x), 1), largest)]
    sizes = [min(len(ids[d]) - at, largest) for d, at in cuts]
    bins, capacities = pack(sizes, costs)
    of: list[list[int]] = [[] for _ in capacities]
    for i in sorted(range(len(cuts)), key=lambda i: (-sizes[i], i)):
        of[bins[i]].append(i)
    first = 0
    while first < len(of):
        last, held = first + 1, capacities[first]
        while last < len(of) and held + capacities[last] <= OUT_IDS:
            held, last = held + capacities[last], last + 1
        out, mask = np.zeros(held, np.int32), np.zeros(held, bool)
        at, used, pieces = 0, [], []
        for b in range(first, last):
            offset = 0
            for i in of[b]:
                d, start = cuts[i]
                out[at + offset:at + offset + sizes[i]] = ids[d][start:start + sizes[i]]
                pieces.append((d, start // largest, start, sizes[i], offset))
                offset += sizes[i]
            mask[at:at + offset] = True
            used.append(offset)
            at += capacities[b]
        ends = pa.array(np.cumsum([0, *capacities[first:last]]), pa.int32())
        rows = pa.StructArray.from_arrays(
            [pa.array([keys[p[0]] for p in pieces], key_type), *[pa.array([p[i] for p in pieces], pa.int64()) for i in (1, 2, 3, 4)]], ["key", "piece", "start", "size", "offset"])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(last - first, number)), pa.array(np.arange(first, last)), pa.array(capacities[first:last], pa.int64()), pa.array(used, pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(out)), pa.ListArray.from_arrays(ends, pa.array(mask)),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(of[b]) for b in range(first, last)]]), pa.int32()), rows),
        ], ["pack_group", "bin", "capacity", "used", "ids", "mask", "pieces"])
        first = last


def pack_texts(df: DataFrame, key: str, text: str, vocabulary: str, costs: Mapping[int, float], end_id: int | None = None,
               group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs whole texts into sequences of token ids, written to the shared folder and read back.

    One row per sequence: pack_group, bin, capacity, used, ids (as many as the capacity, 0 behind what is
    used), mask (true up to ``used``), pieces (key, piece, start in the document, size, offset in the
    sequence), which are the boundaries. ``vocabulary`` is the path of a file of base64 tokens and ranks that
    every executor has; each document ends with ``end_id``, the first id beyond the vocabulary if none is
    given. ``costs`` maps each permitted length to its cost. A document longer than the largest length is
    cut into pieces of that length and a rest. A null or empty text is its end id. Null keys and repeated
    rows are documents of their own. Other columns are not read. No rows, no sequences.

    A group is what a task has read when it holds ``group_pieces`` pieces, so its memory is
    bounded, whatever keys or sizes the rows have. No shuffle.
    """
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kind, largest = rows.schema["key"].dataType.simpleString(), max(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        end = tokens.n_vocab if end_id is None else end_id
        number = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        pieces = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(name)
                ids.append(np.array([*tokens.encode_ordinary(value or ""), end], np.int32))
                pieces += -(-len(ids[-1]) // largest)
                if pieces >= group_pieces:
                    yield from _packed(keys, ids, costs, batch.schema.field(0).type, number)
                    keys, ids, pieces, number = [], [], 0, number + 1
        if keys:
            yield from _packed(keys, ids, costs, batch.schema.field(0).type, number)

    schema = (f"pack_group long, bin long, capacity long, used long, ids array<int>, mask array<boolean>, "
              f"pieces array<struct<key: {kind}, piece: long, start: long, size: long, offset: long>>")
    return saved(rows.mapInArrow(run, schema), "packed-sequences")


def packed_pieces(sequences: DataFrame, key: str) -> DataFrame:
    """Where each piece lies: ``key``, piece, start, size, pack_group, bin, offset, capacity, used, and a hash of its ids there."""
    each = sequences.select("pack_group", "bin", "capacity", "used", "ids", F.explode("pieces").alias("p"))
    own = F.slice("ids", (F.col("p.offset") + 1).cast("int"), F.col("p.size").cast("int"))
    return each.select(F.col("p.key").alias(key), "p.piece", "p.start", "p.size", "pack_group", "bin", "p.offset", "capacity", "used",
                       F.xxhash64(own).alias("ids_hash"))


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
