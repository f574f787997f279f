"""Weighted rendezvous hashing of record keys over shards. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courierlens.llm.shared import saved

#: Hexadecimal digits of a digest that make up a number; 52 bits, which a double holds exactly.
DIGITS = 13
#: Rows that one task numbers.
SLOT_ROWS = 50_000


def unit(of: Column) -> Column:
    """A number in (0, 1) that depends on a text alone."""
    return (F.conv(F.substring(F.md5(of), 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the one with the smallest -ln(u) / weight, u from key and shard number.

    A shard's number for a key never changes, so a further shard takes over those keys for which
    its own number is the smallest, and no key moves between the others. A shard of weight 0 gets
    nothing. Ties go to the smaller shard. A null key is the empty text.
    """
    if not weights or min(weights) < 0 or not max(weights):
        raise ValueError("weights must be 0 or more, and one above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    drawn = [
        F.struct((-F.ln(unit(F.concat(name, F.lit(f"/{shard}")))) / F.lit(float(weight))).alias("at"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights) if weight
    ]
    return F.array_min(F.array(*drawn))["shard"]


def number_slots(df: DataFrame, shard: str, order: Sequence[str], position: str, rows: int) -> DataFrame:
    """Adds slot: 0, 1, 2 ... within each shard, along ``position`` (a number in (0, 1)) and then ``order``.

    A shard is cut into ranges of ``position`` that one task can number; where a range starts
    follows from the row counts of the ranges before it. Rows equal in all columns, ``position``
    among them, are counted before they are shuffled and get neighbouring slots. ``rows`` is the number of rows.
    """
    ranges = max(1, math.ceil(rows / SLOT_ROWS))
    keys = df.columns
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_range", F.floor(F.col(position) * ranges))
    counts = copies.groupBy(shard, "_range").agg(F.sum("_copies").alias("_rows"))
    before = W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(shard, "_range").orderBy(position, *order).rowsBetween(W.unboundedPreceding, -1)
    numbered = copies.withColumn("_ahead", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    joined = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_range") == F.col("_r")))
    first = F.col("_start") + F.col("_ahead")
    return joined.select(*keys, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"))


def assign_shards(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """One row per record: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    ``grown`` are the weights with one shard more; grown_shard differs from shard only where it is
    that shard. A null text has no bytes: size 1, checksum 0. A null key is placed as the empty
    text. Equal keys share a shard. Repeated rows get a slot each. Other columns are not read, and
    texts are reduced to their size and checksum before anything is shuffled. Slots follow a hash
    of the whole row and of the part of the table that it lies in, so a key or row that fills the table is
    numbered by many tasks, as that many counts.
    """
    if len(grown) != len(weights) + 1 or list(grown[:-1]) != list(weights):
        raise ValueError("grown must add one shard to weights")
    value = F.coalesce(df[text].cast("string"), F.lit(""))
    rows = df.select(
        df[key].alias("key"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        rendezvous(df[key], weights).alias("shard"), rendezvous(df[key], grown).alias("grown_shard"), F.spark_partition_id().alias("part"))
    place = F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "text_crc32", "part")
    rows = saved(rows, "shard-rows").withColumn("position", unit(place)).drop("part")
    slots = number_slots(rows, "shard", ["key", "size", "text_crc32"], "position", rows.count())
    return slots.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
