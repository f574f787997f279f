"""Values carried forward over ranges of rows, however many rows one key, day or minute has.

Rows are cut into ranges by key, time, falling value and place, so a key, or a minute of it, that holds a
large share of the rows is spread over as many tasks as its share. Each task carries values forward
within its range in one pass over its sorted rows. What a range needs from the ones before it is a single
value, which follows from a summary of a row per range by a scan over these.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from courierlens.sources.session import shared_folder


def _same(column: pa.Array, ahead: pa.Array | None) -> np.ndarray:
    """Whether each row's value is that of the row before it, NULL like any other; ``ahead`` is the one before the first."""
    before = pa.concat_arrays([column[:1] if ahead is None else ahead, column[:-1]])
    equal = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(column.is_null(), before.is_null()))
    same = np.array(equal.to_numpy(zero_copy_only=False), bool)
    if ahead is None:
        same[0] = False
    return same


class _Range:
    """One pass over a range's rows (key, ts, value), sorted: the value carried to each, and whether it is open.

    Open rows stand on the range's first group of peers, or on what comes before it: until another known
    value of their key is met, that first group's value cannot be told without the ranges before.
    """

    def __init__(self) -> None:
        self._key: pa.Array | None = None
        self._ts: pa.Array | None = None
        self._held: pa.Array | None = None
        self._open, self._first_group = True, True

    def carry(self, key: pa.Array, ts: pa.Array, value: pa.Array) -> tuple[pa.Array, np.ndarray]:
        n = len(key)
        same_key = _same(key, self._key)
        new_group = ~(same_key & _same(ts, self._ts))
        beginning = self._key is None
        # The groups from the second one of the range on.
        later = np.cumsum(new_group) > (1 if beginning else 0)
        if not beginning and not self._first_group:
            later[:] = True
        # A group's largest value is its first row's. Another key starts with nothing.
        starts = new_group & later & (value.is_valid().to_numpy(zero_copy_only=False) | ~same_key)
        last = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        is_open = (last < 0) & self._open
        if beginning:
            self._held = value[:1]
        taken = pa.concat_arrays([self._held, value]).take(pa.array(last + 1))
        self._key, self._ts, self._held = key[-1:], ts[-1:], taken[-1:]
        self._open, self._first_group = bool(is_open[-1]), self._first_group and not bool(later[-1])
        return taken, is_open


def scan_bases(ranges: list[dict[str, Any]]) -> dict[int, Any]:
    """What the open rows of each range (in order) take.

    A range says its first key and ts, the largest value of that first group there, its last key and ts, and
    the value carried to its last row unless that row is open.
    """
    bases: dict[int, Any] = {}
    before: dict[str, Any] | None = None
    out = None
    for r in ranges:
        inherited = out if before is not None and before["last_key"] == r["first_key"] else None
        goes_on = before is not None and (before["last_key"], before["last_ts"]) == (r["first_key"], r["first_ts"])
        base = r["first_value"] if r["first_value"] is not None and not goes_on else inherited
        bases[r["part"]] = base
        out, before = (base if r["last_open"] else r["last_value"]), r
    return bases


def fill_forward_scan(df: DataFrame, key: str, ts: str, value: str, name: str | None = None) -> DataFrame:
    """``fill_forward`` over ranges: the last non-NULL ``value`` of a key at or before each row.

    Rows that share a timestamp share the largest of their values; NULL keys are a key, NULL timestamps come first.
    The ranges are written to the shared folder once and read again, which takes one shuffle of
    the rows and is an action of its own; a row per range comes to the driver. No task holds more than
    its range, and a range is as large as any other, whatever the rows repeat.
    """
    name = name or value
    kept = [c for c in df.columns if c != name]
    order = [F.col("_key").asc_nulls_first(), F.col("_ts").asc_nulls_first(), F.col("_value").desc_nulls_last(), F.col("_row")]
    keyed = df.select(*kept, F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(value).alias("_value"), F.monotonically_increasing_id().alias("_row"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields[:-1], StructField("_filled", ranged.schema["_value"].dataType),
                         StructField("_open", BooleanType()), StructField("_place", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place = _Range(), 0
        for batch in batches:
            if batch.num_rows:
                columns = batch.columns[:-1]
                filled, is_open = rows.carry(*columns[-3:])
                places = pa.array(np.arange(place, place + batch.num_rows))
                place += batch.num_rows
                yield pa.RecordBatch.from_arrays([*columns, filled, pa.array(is_open), places], schema.names)

    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "ranges")
    ranged.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id().cast("long")).write.parquet(folder)
    stored = spark.read.schema(StructType([*schema.fields, StructField("_part", LongType())])).parquet(folder)

    first = F.min(F.struct("_place", "_key", "_ts", "_value")).alias("f")
    last = F.max(F.struct("_place", "_key", "_ts", "_filled", "_open")).alias("l")
    found = stored.groupBy("_part").agg(first, last).orderBy("_part").collect()
    bases = scan_bases([{"part": r["_part"], "first_key": r["f"]["_key"], "first_ts": r["f"]["_ts"], "first_value": r["f"]["_value"],
                         "last_key": r["l"]["_key"], "last_ts": r["l"]["_ts"], "last_value": r["l"]["_filled"], "last_open": r["l"]["_open"]} for r in found])
    kinds = StructType([StructField("_of", LongType()), StructField("_base", schema["_value"].dataType)])
    # A row per range.
    joined = stored.join(F.broadcast(spark.createDataFrame(list(bases.items()), kinds)), F.col("_part") == F.col("_of"))
    return joined.select(*kept, F.when(F.col("_open"), F.col("_base")).otherwise(F.col("_filled")).alias(name))
