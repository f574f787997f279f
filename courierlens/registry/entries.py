"""What a registered query is, and rounding shared by both sides of the comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.params import Params
from courierlens.registry.relations import compose
from courierlens.sources.catalog import Catalog
from courierlens.sources.sample import given_table, sample_catalog
from courierlens.sources.session import apply_settings

DIGITS = 4


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to four places: two engines add floats in different orders."""
    return df.select(*[
        (F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


@dataclass(frozen=True)
class Entry:
    """A query over the derived input tables, and the relation that must equal it."""

    build: Callable[[Catalog, Params], DataFrame]
    params: Params
    edition: str
    select: str
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(sample_catalog(spark, sf_dir, self.edition), self.params))

    def sql(self) -> str:
        select = self.select if " " in self.select else f"SELECT * FROM {self.select}"
        return compose(_rounded(select, self.doubles), self.params, self.edition)


@dataclass(frozen=True)
class Direct:
    """A query straight over the given tables with its own SQL."""

    build: Callable[..., DataFrame]
    select: str
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        return tidy(self.build(lambda name: given_table(spark, sf_dir, name)))

    def sql(self) -> str:
        return _rounded(self.select, self.doubles)


def _rounded(select: str, doubles: tuple[str, ...]) -> str:
    if not doubles:
        return select
    replaced = ", ".join(f"CAST(round({c}, {DIGITS}) + 0e0 AS DOUBLE) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM ({select})"
