"""Best row per key and extremes with their ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key by ``order`` (give a total order for a repeatable pick).

    Spark limits each key to one row before the shuffle, so a key that holds a large
    share of the rows, NULL for instance, sends one row per input task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def extreme_with_ties(df: DataFrame, keys: Sequence[str], measure: str, label: str, how: str,
                      name: str) -> DataFrame:
    """Smallest or largest ``measure`` per key with every label that attains it.

    Distinct labels are ranked in one scan, and Spark limits each key to its first rank before the
    shuffle, so a key that holds a large share of the rows sends its best labels per task. A key
    without any measure, or with a NULL part, keeps one NULL label.
    """
    known = F.col(measure).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    labels = df.select(*keys, F.when(known, F.col(label)).alias(label), F.col(measure).alias(name)).distinct()
    order = F.col(name).asc_nulls_last() if how == "min" else F.col(name).desc_nulls_last()
    best = labels.withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_rank") == 1)
    return best.select(*keys, label, name)
