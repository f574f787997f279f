"""Putting finished results together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_tagged(parts: Sequence[tuple[str, DataFrame]], tag: str) -> DataFrame:
    """All rows of all parts under the same columns, each part marked with its tag."""
    marked = [df.select(F.lit(value).alias(tag), *df.columns) for value, df in parts]
    return reduce(DataFrame.unionByName, marked)
