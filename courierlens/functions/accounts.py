"""What each condition of a filter turns away, counted in the pass that filters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Account:
    """Collects, per table and condition, how many rows did not meet it and for how many it was NULL.

    The counts are metrics of the query that the filtered rows are part of: there is no scan of their own,
    and they are known when that query has run. A row that several conditions turn away is
    counted by each. Conditions of an account are not pushed into the scan, since rows are counted ahead of
    them; so an account is asked for, not always kept.
    """

    SCHEMA = "input string, condition string, rows long, refused long, unknown long"

    def __init__(self) -> None:
        self._parts: list[tuple[str, list[str], Observation]] = []

    def keep(self, df: DataFrame, name: str, conditions: Mapping[str, Column]) -> DataFrame:
        observed = Observation(f"{name}-{len(self._parts)}")
        metrics = [F.count(F.lit(1)).alias("rows")]
        for i, condition in enumerate(conditions.values()):
            metrics += [F.count_if(~condition).alias(f"refused_{i}"), F.count_if(condition.isNull()).alias(f"unknown_{i}")]
        self._parts.append((name, list(conditions), observed))
        return df.observe(observed, *metrics).filter(reduce(and_, conditions.values()))

    def rows(self) -> list[tuple[str, str, int, int, int]]:
        """(input, condition, rows, refused, unknown); waits until the query has run."""
        found = []
        for name, conditions, observed in self._parts:
            got = observed.get
            found += [(name, c, got["rows"], got[f"refused_{i}"], got[f"unknown_{i}"]) for i, c in enumerate(conditions)]
        return found


def keep(df: DataFrame, name: str, conditions: Mapping[str, Column], account: Account | None = None) -> DataFrame:
    """Rows that meet all conditions, with an account of the others if one is given."""
    return account.keep(df, name, conditions) if account else df.filter(reduce(and_, conditions.values()))
