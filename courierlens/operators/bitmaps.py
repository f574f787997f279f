"""Exact distinct counts at several grains, as bitmaps that merge.

Every distinct id gets a number, and a count is the number of bits set in the bitmaps of its grain.
Bitmaps of a fine grain merge into those of a coarser one, so the events are shuffled once, whatever
the number of grains and counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_ids(df: DataFrame, ident: str, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """One row per id and combination of ``keys`` it occurs in: number, the keys, and a flag per count.

    The events are reduced to one row per id, with its distinct combinations; of these rows, ranges
    by smallest combination and id are numbered without gaps, each range from an offset of its own. So
    ids that occur together get numbers that are close together, and few bitmaps hold a combination.
    """
    seen = F.struct(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[F.coalesce(c, F.lit(False)).alias(f"_is_{n}") for n, c in counts.items()])
    per_id = df.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.collect_set(seen).alias("_seen"))
    order = [F.array_min("_seen"), F.col("_id")]
    numbered = per_id.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id())
    return numbered.select("_number", F.explode("_seen").alias("_seen")).select(
        "_number", *[F.col(f"_seen._{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"_seen._is_{n}").alias(n) for n in counts])


def distinct_counts(df: DataFrame, ident: str, grains: Sequence[Sequence[str]], counts: Mapping[str, Column], grain: str = "grain") -> DataFrame:
    """Distinct ids that meet each condition, per combination of the keys of every grain.

    ``counts`` maps a result column to its condition. ``grain`` names a row's grain by its keys, joined by
    commas; keys that a grain leaves out are NULL. NULL ids are not counted, NULL keys are a
    combination like any other. A combination in which no id occurs has no row.
    """
    keys = list(dict.fromkeys(k for g in grains for k in g))
    rows = numbered_ids(df, ident, keys, counts)
    bucket = F.bitmap_bucket_number(F.col("_number"))
    bits = rows.groupBy(*keys, bucket.alias("_bucket")).agg(*[
        F.bitmap_construct_agg(F.when(F.col(n), F.bitmap_bit_position(F.col("_number")))).alias(n) for n in counts])
    sets = [[*[F.col(k) for k in g], F.col("_bucket")] for g in grains]
    left_out = [F.grouping(k).alias(f"_no_{i}") for i, k in enumerate(keys)]
    merged = bits.groupingSets(sets, *[F.col(k) for k in keys], F.col("_bucket")).agg(*left_out, *[F.bitmap_or_agg(n).alias(n) for n in counts])
    names = F.lit(None).cast("string")
    for g in grains:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & (F.col(f"_no_{i}") == F.lit(0 if k in g else 1))
        names = F.coalesce(names, F.when(same, F.lit(",".join(g))))
    return (merged.withColumn(grain, names).groupBy(grain, *keys)
            .agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in counts]))
