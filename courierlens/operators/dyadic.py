"""Spans on the minute axis as few aligned cells, and facts that look them up by equality.

A cell of level ``l`` holds ``2**l`` minutes and starts at a multiple of that. A span of n minutes is
the union of at most two cells per level, so of fewer than ``2 * log2(n) + 2``, however long
it is, and a minute lies in exactly one cell of each level. Spans may overlap, and nothing is
listed per minute, hour or day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import at, minute_of

#: Level of the largest cells, of 127 years; longer spans take several of them.
TOP_LEVEL = 26


def minute_number(ts: Column) -> Column:
    """Whole minutes since 1970 of a wall-clock timestamp, rounded down."""
    return F.timestamp_diff("MINUTE", at(date(1970, 1, 1)), minute_of(ts))


def span_cells(first: Column, last: Column, top: int = TOP_LEVEL) -> Column:
    """Array of (level, cell) structs that make up the whole numbers from ``first`` to ``last``, both included.

    NULL for reversed or NULL bounds. Seen from level ``l``, the part that larger cells have to
    cover reaches from ``first`` rounded up to ``last + 1`` rounded down; an odd bound there is a cell
    that no larger one can take.
    """
    low, high = first.cast("long"), last.cast("long") + 1

    def pieces(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        start = F.call_function("shiftright", low + size - 1, level)
        end = F.call_function("shiftright", high, level)
        odd_start, odd_end = start.bitwiseAND(F.lit(1)) == 1, end.bitwiseAND(F.lit(1)) == 1
        after = start + F.when(odd_start, 1).otherwise(0)
        return F.array(
            F.when((start < end) & odd_start, F.struct(level.alias("level"), start.alias("cell"))),
            F.when((after < end) & odd_end, F.struct(level.alias("level"), (end - 1).alias("cell"))))

    size = F.lit(1 << top).cast("long")
    start, end = F.call_function("shiftright", low + size - 1, F.lit(top)), F.call_function("shiftright", high, F.lit(top)) - 1
    largest = F.when(start <= end, F.transform(F.sequence(start, end), lambda c: F.struct(F.lit(top).alias("level"), c.alias("cell"))))
    smaller = [F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), pieces))] if top else []
    return F.when(low < high, F.array_compact(F.concat(*smaller, F.coalesce(largest, F.array()))))


def point_cells(point: Column, top: int | Column = TOP_LEVEL) -> Column:
    """Array of the (level, cell) structs that hold a whole number, one per level."""
    number = point.cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: F.struct(
        level.alias("level"), F.call_function("shiftright", number, level).alias("cell")))


def attribute_cells(facts: DataFrame, spans: DataFrame, on: Mapping[str, str], ts: Column, start: str, end: str,
                    carry: Sequence[str], top: int = TOP_LEVEL, covering: str | None = None) -> DataFrame:
    """Left join of facts to the spans that hold their minute, once per span.

    ``on`` maps fact columns to span columns. ``start`` and ``end`` are whole minutes, both included;
    reversed or open spans hold nothing, and spans of any length may overlap. Facts are reduced to
    their distinct (key, minute) before they are listed once per level, so the lookup grows with
    keys and minutes, not with the facts; these only join its result by equality. Spans with the same
    values of ``carry`` are counted per cell and per minute, however many pile up. With ``covering`` a fact comes
    once per such values, with the number of spans in that column (NULL without any). ``top`` may be lowered
    where spans are short; it changes the cost, not the result.
    """
    names = [f"_on_{i}" for i in range(len(on))]
    carried = [f"_carry_{c}" for c in carry]
    mine = facts.withColumn("_minute", minute_number(ts))
    points = mine.select(*[F.col(c).alias(n) for c, n in zip(on, names)], "_minute").na.drop().distinct()
    probes = points.select("*", F.inline(point_cells(F.col("_minute"), top)))
    pieces = spans.select(*[F.col(c).alias(f"{n}_of") for c, n in zip(on.values(), names)], *[F.col(c).alias(k) for c, k in zip(carry, carried)],
                          F.inline(span_cells(minute_number(F.col(start)), minute_number(F.col(end)), top)).alias("_level", "_cell"))
    place = [*[f"{n}_of" for n in names], "_level", "_cell"]
    cells = pieces.groupBy(*place, *carried).agg(F.count(F.lit(1)).alias("_spans"))
    same = (F.col("level") == F.col("_level")) & (F.col("cell") == F.col("_cell"))
    for n in names:
        same = same & (F.col(n) == F.col(f"{n}_of"))
    looked_up = spread(probes, [*names, "level", "cell"]).join(spread(cells, place), same)
    hits = looked_up.groupBy(*[F.col(n).alias(f"{n}_at") for n in names], F.col("_minute").alias("_at"), *carried).agg(F.sum("_spans").alias("_spans"))
    meet = F.col("_minute") == F.col("_at")
    for c, n in zip(on, names):
        meet = meet & (F.col(c) == F.col(f"{n}_at"))
    labelled = mine.join(hits, meet, "left")
    found = [*facts.columns, *[F.col(k).alias(c) for c, k in zip(carry, carried)]]
    if covering is not None:
        return labelled.select(*found, F.col("_spans").alias(covering))
    copies = F.sequence(F.lit(1).cast("long"), F.coalesce("_spans", F.lit(1)))
    return labelled.select(*found, F.explode(copies).alias("_copy")).drop("_copy")


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that were listed several times, shuffled by the keys of a join that follows.

    The planner takes a listing to be as small as what was listed, and would broadcast it. Behind an
    exchange its size is measured, and the join goes by that; both sides need one, for the
    adaptive planner gives up a broadcast only where that costs no further exchange.
    """
    return rows.repartition(*keys)
