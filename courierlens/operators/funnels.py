"""Session funnels: which steps a session reached, then how many sessions reached them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.measures import ever


def session_flags(df: DataFrame, keys: Sequence[str], session: str, steps: Mapping[str, Column],
                  extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key and session with a boolean per step (and any extra aggregates)."""
    flags = [ever(hit).alias(name) for name, hit in steps.items()]
    return df.groupBy(*keys, session).agg(*flags, *extra)


def step_counts(flags: DataFrame, keys: Sequence[str], session: str, counts: Mapping[str, Sequence[str]],
                extra: Sequence[Column] = ()) -> DataFrame:
    """Sessions per key that reached all steps named for a count (none named: every session).

    The input has one row per session, so counting rows counts distinct sessions and no
    distinct aggregate is needed. Rows without a session id keep their key but count 0.
    """
    columns = []
    for name, steps in counts.items():
        reached = F.col(session).isNotNull()
        for step in steps:
            reached = reached & F.col(step)
        columns.append(F.count_if(reached).alias(name))
    return flags.groupBy(*keys).agg(*columns, *extra)
