"""Binds input table names to DataFrames and checks the columns they must have."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    FloatType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from courierlens.sources.schemas import SCHEMAS


def _problems(name: str, want: DataType, have: DataType) -> list[str]:
    if isinstance(want, StructType):
        if not isinstance(have, StructType):
            return [f"{name}: expected a struct, found {have.simpleString()}"]
        fields = {f.name: f.dataType for f in have.fields}
        found = []
        for f in want.fields:
            if f.name not in fields:
                found.append(f"{name}.{f.name}: missing")
            else:
                found += _problems(f"{name}.{f.name}", f.dataType, fields[f.name])
        return found
    if isinstance(want, ArrayType):
        if not isinstance(have, ArrayType):
            return [f"{name}: expected an array, found {have.simpleString()}"]
        return _problems(f"{name}[]", want.elementType, have.elementType)
    if isinstance(have, FloatType):
        return [f"{name}: float32 makes fee comparisons such as = 0.99 false; use double or decimal"]
    return []


def _wall_clock(kind: DataType) -> DataType:
    """The type with every instant replaced by a wall-clock timestamp."""
    if isinstance(kind, TimestampType):
        return TimestampNTZType()
    if isinstance(kind, ArrayType):
        return ArrayType(_wall_clock(kind.elementType), kind.containsNull)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _wall_clock(f.dataType), f.nullable) for f in kind.fields])
    return kind


def _normalised(frame: DataFrame) -> DataFrame:
    changed = {f.name: _wall_clock(f.dataType) for f in frame.schema.fields
               if _wall_clock(f.dataType) != f.dataType}
    return frame.withColumns({name: F.col(name).cast(kind) for name, kind in changed.items()}) if changed else frame


class Catalog:
    """Lazy, checked lookup: ``catalog["sessions"]``.

    A table is resolved on first use, so a plan only needs the tables it reads.
    Tables may hold more columns than the schema names; Catalyst prunes them. TIMESTAMP
    columns are read as wall clock in the session zone (UTC, see ``session.py``); tables
    that store TIMESTAMP_NTZ need no cast and so keep time filters in the scan.
    """

    def __init__(self, resolve: Callable[[str], DataFrame]):
        self._resolve = resolve
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Catalog:
        return cls(lambda name: frames[name])

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Catalog:
        return cls(lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}"))

    @classmethod
    def from_tables(cls, spark: SparkSession, names: Mapping[str, str]) -> Catalog:
        """``names`` maps the neutral table name to the one in the metastore."""
        return cls(lambda name: spark.table(names.get(name, name)))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"unknown input table {name!r}")
        if name not in self._frames:
            frame = self._resolve(name)
            problems = _problems(name, StructType.fromDDL(SCHEMAS[name]), frame.schema)
            if problems:
                raise ValueError("input table does not fit: " + "; ".join(problems))
            self._frames[name] = _normalised(frame)
        return self._frames[name]
