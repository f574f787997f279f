"""Rainfall per zone, date and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.params import Params
from courierlens.sources.catalog import Catalog


def daily_rainfall(catalog: Catalog, params: Params) -> DataFrame:
    r = catalog["rain"]
    return (r.groupBy(r.zone.alias("zone_name"), F.to_date(r.ts).alias("date_local"),
                      F.hour(r.ts).alias("hour_"))
            .agg(F.sum(r.rainfall_mm).alias("total_rainfall")))
