"""Flattening of arrays of structs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_structs(df: DataFrame, array: str, fields: Mapping[str, str], keep: Sequence[str] = (),
                    keep_empty: bool = False) -> DataFrame:
    """One row per array element.

    ``fields`` maps output names to fields of the element; ``keep`` names the
    columns carried along. ``keep_empty`` keeps one row with NULL fields for a NULL
    or empty array.
    """
    unnest = F.explode_outer if keep_empty else F.explode
    items = df.select(*keep, unnest(array).alias("_item"))
    return items.select(*keep, *[F.col(f"_item.{source}").alias(name) for name, source in fields.items()])
