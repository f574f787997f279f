"""Partial results kept by day, of which a refresh replaces whole days."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Partition columns of a state table.
DAY, VERSION = "_day", "_version"
_LIST = f"table string, number long, {VERSION} string, {DAY} date"


class DayStates:
    """Tables below a folder that all executors share, each partitioned by version and day.

    A refresh writes the new states of some days as a version of its own and then lists it. What is
    read is each day's latest listed version, so a refresh that fails halfway, or whose tasks are run
    twice, leaves no trace, and a day that has lost all its rows is empty. One refresh may run at
    a time. Only the list, with a row per refreshed day, comes to the driver.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> DayStates:
        """States in a new folder."""
        states = cls(spark, folder)
        spark.createDataFrame([], _LIST).write.parquet(states._path("_refreshes"))
        return states

    def _path(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def _refreshes(self) -> DataFrame:
        return self._spark.read.schema(_LIST).parquet(self._path("_refreshes"))

    def days(self, table: str) -> dict[date, str]:
        """The current version of every day of a table."""
        latest = (self._refreshes().filter(F.col("table") == table)
                  .groupBy(DAY).agg(F.max_by(VERSION, "number").alias(VERSION)))
        return {r[DAY]: r[VERSION] for r in latest.collect()}

    def refresh(self, states: dict[str, DataFrame], days: Iterable[date]) -> None:
        """Replaces these days in every given table. A state has a column ``_day``, with these days alone.

        All tables change together, when the refresh is listed.
        """
        days, version = sorted(set(days)), uuid.uuid4().hex
        for table, state in states.items():
            state.withColumn(VERSION, F.lit(version)).write.partitionBy(VERSION, DAY).mode("append").parquet(self._path(table))
        number = self._refreshes().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        listed = [(table, number, version, day) for table in states for day in days]
        self._spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("append").parquet(self._path("_refreshes"))

    def read(self, table: str, schema: StructType, first: date, last: date) -> DataFrame:
        """The current states of the days from ``first`` to ``last``; other partitions are not read.

        ``schema`` is that of the states as they were given to ``refresh``.
        """
        versions: dict[str, list[date]] = {}
        for day, version in self.days(table).items():
            if first <= day <= last:
                versions.setdefault(version, []).append(day)
        plain = StructType([f for f in schema.fields if f.name != DAY]).add(VERSION, "string").add(DAY, "date")
        stored = self._spark.read.schema(plain).parquet(self._path(table))
        current = reduce(or_, [(F.col(VERSION) == v) & F.col(DAY).isin(days) for v, days in versions.items()], F.lit(False))
        return stored.filter(current).drop(VERSION)
