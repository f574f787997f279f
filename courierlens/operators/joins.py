"""Membership tests, band joins and joins of two aggregates.

No side is hinted as broadcast: Spark broadcasts what its size statistics (static or
measured at run time) allow, and otherwise sort-merges with hot keys split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.operators.dyadic import TOP_LEVEL, point_cells, span_cells, spread


def semi_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """Rows whose value is IN the other column."""
    members = _members(sub, sub_column)
    return df.filter(F.col(column).isNotNull()).join(members, F.col(column).eqNullSafe(F.col("_member")), "left_semi")


def exists_flag(df: DataFrame, column: str, sub: DataFrame, sub_column: str, name: str) -> DataFrame:
    """Adds whether the value is IN the other column; a NULL value is not."""
    members = _members(sub, sub_column).withColumn("_hit", F.lit(True))
    joined = df.join(members, F.col(column).eqNullSafe(F.col("_member")), "left")
    return joined.select(*df.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def _members(sub: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values to test membership against.

    Repeats vanish before the shuffle, so a value that fills the list is one row. The
    joins compare null-safe although no NULL is left: that gives them an exchange of
    their own behind the distinct, and only a join that sits right on its exchanges lets
    the adaptive planner split a value that fills the other side.
    """
    return sub.select(F.col(column).alias("_member")).filter(F.col("_member").isNotNull()).distinct()


def not_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """SQL ``NOT IN``, NULLs included, for a list too large to broadcast.

    An empty list keeps every row; a list with a NULL keeps none; otherwise rows with
    a NULL value go. One scalar subquery over the distinct members decides which case
    applies, and a plain anti join does the matching.
    """
    members = sub.select(F.col(sub_column).alias("_member")).distinct()
    case = (F.when(F.count(F.lit(1)) == 0, 2)
            .when(F.count_if(F.col("_member").isNull()) == 0, 1)
            .otherwise(0))
    needed = F.when(F.col(column).isNull(), 2).otherwise(1)
    kept = df.filter(members.agg(case.alias("_case")).scalar() >= needed)
    # Null-safe equality leaves the members' plan as in the subquery, so its shuffle is reused.
    return kept.join(members, F.col(column).eqNullSafe(F.col("_member")), "left_anti")


def band_join(df: DataFrame, bands: DataFrame, on: Mapping[str, str], value: str, low: str, high: str,
              carry: Sequence[str]) -> DataFrame:
    """Left join on equal keys and ``low <= value <= high`` (both ends inclusive)."""
    theirs = bands.select(*[F.col(c).alias(f"_on_{c}") for c in on.values()],
                          F.col(low).alias("_low"), F.col(high).alias("_high"), *carry)
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return df.join(theirs, _equal(on) & inside, "left").select(*df.columns, *carry)


def spread_band_join(df: DataFrame, bands: DataFrame, on: Mapping[str, str], value: str, low: str, high: str,
                     carry: Sequence[str], per_bucket: int = 64) -> DataFrame:
    """``band_join`` for keys with many bands: the same rows, joined by equality of buckets.

    A key's value axis is cut into buckets, as many as leave ``per_bucket`` bands to each, so their
    width adapts to the key. A band is listed by the few aligned cells that make up its buckets, a
    value looks up one cell per level, and only bands of its cells are compared with it. Values are
    looked up once per key, however many rows repeat them. A key with few bands has one bucket.
    """
    names = [f"_on_{i}" for i in range(len(on))]
    theirs = bands.filter(F.col(low) <= F.col(high)).select(
        *[F.col(c).alias(n) for c, n in zip(on.values(), names)], F.col(low).alias("_low"), F.col(high).alias("_high"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry])
    axis = theirs.groupBy(*[F.col(n).alias(f"{n}_axis") for n in names]).agg(
        F.min("_low").alias("_base"), F.max("_high").alias("_top"), F.ceil(F.count(F.lit(1)) / per_bucket).alias("_buckets"))

    def bucket(at: str) -> Column:
        base, top = F.col("_base").cast("double"), F.col("_top").cast("double")
        # Rises with the value, infinite bounds included, so a value within a band is within its buckets.
        share = F.nanvl((F.col(at).cast("double") - base) / (top - base), F.lit(0.0))
        last = F.col("_buckets") - 1
        return (F.when(F.col(at) <= F.col("_base"), 0).when(F.col(at) >= F.col("_top"), last)
                .otherwise(F.least(F.floor(share * F.col("_buckets")), last)).cast("long"))

    def with_axis(rows: DataFrame) -> DataFrame:
        return rows.join(axis, _all_equal({n: f"{n}_axis" for n in names}))

    cells = with_axis(theirs).select(*[F.col(n).alias(f"{n}_of") for n in names], "_low", "_high", *[f"_carry_{c}" for c in carry],
                                     F.inline(span_cells(bucket("_low"), bucket("_high"))).alias("_level", "_cell"))
    points = df.select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.col(value).alias("_value"))
    points = points.filter(reduce(and_, [F.col(n).isNotNull() for n in (*names, "_value")])).distinct()
    levels = F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(F.col("_buckets")))).cast("int")
    probes = with_axis(points).select(*names, "_value", F.inline(point_cells(bucket("_value"), levels)))
    same = _all_equal({n: f"{n}_of" for n in names} | {"level": "_level", "cell": "_cell"})
    hits = spread(probes, [*names, "level", "cell"]).join(spread(cells, [*[f"{n}_of" for n in names], "_level", "_cell"]), same & F.col("_value").between(F.col("_low"), F.col("_high")))
    hits = hits.select(*names, "_value", *[f"_carry_{c}" for c in carry])
    meet = _all_equal(dict(zip(on, names)) | {value: "_value"})
    return df.join(hits, meet, "left").select(*df.columns, *[F.col(f"_carry_{c}").alias(c) for c in carry])


def clamped_band_label(df: DataFrame, bands: DataFrame, on: Mapping[str, str], value: str, low: str,
                       high: str, fee: str, label: str, below: float) -> DataFrame:
    """Label(s) of the band a value falls in, clamped at both ends.

    Values under ``below`` take the label of the cheapest band of the key, values over
    the highest band end the label of the dearest; ties give one row per label, a hole
    gives NULL. Each row first learns which of the three applies, then one join
    fetches the labels.
    """
    keys = list(on.values())
    limits = bands.groupBy(*[F.col(c).alias(f"_on_{c}") for c in keys]).agg(
        F.min(fee).alias("_cheapest"), F.max(fee).alias("_dearest"), F.max(high).alias("_top"))
    case = F.when(F.col(value) < below, "low").when(F.col(value) > F.col("_top"), "high").otherwise("in")
    routed = (df.join(limits, _equal(on), "left").withColumn("_case", case)
              .select(*df.columns, "_cheapest", "_dearest", "_case"))
    theirs = bands.select(*[F.col(c).alias(f"_on_{c}") for c in keys],
                          F.col(low).alias("_low"), F.col(high).alias("_high"),
                          F.col(fee).alias("_fee"), F.col(label))
    hit = (F.when(F.col("_case") == "low", F.col("_fee") == F.col("_cheapest"))
           .when(F.col("_case") == "high", F.col("_fee") == F.col("_dearest"))
           .otherwise(F.col(value).between(F.col("_low"), F.col("_high"))))
    return routed.join(theirs, _equal(on) & hit, "left").select(*df.columns, label).distinct()


def stats_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two aggregates on a shared grain with plain equality, keys taken from the left.

    A NULL key matches nothing, and under ``full`` a right-only row shows NULL keys.
    """
    renamed = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    measures = [c for c in right.columns if c not in keys]
    return left.join(renamed, _equal({k: k for k in keys}), how).select(*left.columns, *measures)


def _equal(on: Mapping[str, str]) -> Column:
    return _all_equal({mine: f"_on_{theirs}" for mine, theirs in on.items()})


def _all_equal(pairs: Mapping[str, str]) -> Column:
    return reduce(and_, [F.col(mine) == F.col(theirs) for mine, theirs in pairs.items()])
