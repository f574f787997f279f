"""Facts laid out so that the joins of the results need no shuffle.

Orders, vouchers and discounts meet by ``uuid``, sessions and their verticals by ``ga_session_id``. Tables
that are joined are partitioned by their day, cut into the same number of buckets by the join key and sorted
by it within a bucket. Reduced to a row per key, and joined, a bucket then needs no other bucket, and a
look-up by key reads one bucket of each day.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.sources.catalog import Catalog


@dataclass(frozen=True)
class Placement:
    """The day column that partitions a table, and the key that buckets and sorts it."""

    day: str
    key: str


PLACEMENTS: dict[str, Placement] = {
    "shop_orders": Placement("created_date_utc", "uuid"),
    "order_vouchers": Placement("created_date_utc", "uuid"),
    "order_discounts": Placement("created_date_utc", "uuid"),
    "sessions": Placement("partition_date", "ga_session_id"),
    "session_verticals": Placement("partition_date", "ga_session_id"),
    "order_profit": Placement("date_local", "order_code"),
}


def write_table(df: DataFrame, table: str, placement: Placement, buckets: int, folder: str | None = None) -> None:
    """Writes ``df`` as the metastore's ``table``, below ``folder`` if one is given.

    Rows are brought to their bucket ahead of the write, so a day and bucket is one file, and a key that
    holds a large share of the rows is spread by day. Give tables that are joined the same ``buckets``:
    enough that one of them, all days together, fits a task.
    """
    # Spark's own rule for a row's bucket.
    bucket = F.pmod(F.hash(placement.key), F.lit(buckets))
    placed = df.repartition(F.col(placement.day), bucket)
    writer = placed.write.partitionBy(placement.day).bucketBy(buckets, placement.key).sortBy(placement.key)
    if folder:
        writer = writer.option("path", f"{folder.rstrip('/')}/{table}")
    writer.mode("overwrite").format("parquet").saveAsTable(table)


def write_layout(catalog: Catalog, names: Mapping[str, str], buckets: int, folder: str | None = None) -> None:
    """Writes the input tables of ``names`` (neutral name -> table) by their placements."""
    for name, table in names.items():
        write_table(catalog[name], table, PLACEMENTS[name], buckets, folder)


def laid_out(spark: SparkSession, names: Mapping[str, str], others: Catalog) -> Catalog:
    """A catalog of the tables that were laid out, the rest taken from another one."""
    return Catalog(lambda name: spark.table(names[name]) if name in names else others[name])
